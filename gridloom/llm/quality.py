"""Quality rules: base counts and a hashed n-gram logistic regression.

Base counts are exact. The verdict comes from a logistic regression over
relative frequencies of hashed words, word pairs and character n-grams, trained
on a bounded sample of labelled rows (``SAMPLE`` rows, the first by a hash of
doc_id, and no more of them than have ``MOST_ENTRIES`` features in all, so that
the driver holds 8 bytes for each of these at most), calibrated on a part of it
that training did not see (Platt), and scored in Arrow batches against the fixed
``THRESHOLD``.

Null and empty texts have no words and fail the base rule. Very long texts are
counted whole. Ties of the sample's hash go by doc_id; repeated rows are scored each; an empty table gives no rows;
without labels of both classes the regression abstains (probability 1), so only
the base rule decides. Other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASE, arrow_schema, code_points, flat, give_back, mix, per_row, settle, slices, span_hashes, window_hashes, windows, word_spans

#: Most labelled rows that training takes.
SAMPLE = 1500
#: Most features (different slots of a row) that the sampled rows have in all.
MOST_ENTRIES = 32 << 20
THRESHOLD = 0.3
TABLE_BITS = 16
KINDS = 5  # words, word pairs, character 2-, 3- and 4-grams

#: The symbols of the base rule.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_words(rows: np.ndarray, hashes: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    """Per row: words inside windows of ``size`` words that the row holds twice or more."""
    first = windows(rows, size)
    if not len(first):
        return np.zeros(n, np.int64)
    keys = mix(window_hashes(hashes, first, size) + rows[first].astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    covered = np.zeros(len(rows) + 1, np.int64)
    np.add.at(covered, first[again], 1)
    np.add.at(covered, first[again] + size, -1)
    return per_row(rows[np.cumsum(covered[:-1]) > 0], n)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines that hold a word and equal an earlier line, and lines that hold a word."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    rows = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    rows = rows[np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")]
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, offsets[rows[:-1] + 1])
    if len(ends):
        ends[-1] = offsets[-1]
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, rows = starts[worded], ends[worded], rows[worded]
    keys = mix(span_hashes(data, starts, ends) + rows.astype(np.uint64) * np.uint64(BASE))
    unique, at = np.unique(keys, return_index=True)
    return per_row(rows, n) - per_row(rows[at], n), per_row(rows, n)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for each text, and what they were made from."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    points = code_points(data)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    dup_lines, lines = duplicate_lines(data, offsets, starts)
    return {
        "n_words": per_row(rows, n),
        "word_chars": per_row(rows, n, points[ends] - points[starts]),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(rows, hashes, n),
        "lines": lines,
        "starts": starts,
        "ends": ends,
        "rows": rows,
        "hashes": hashes,
    }


def ngram_slots(data: np.ndarray, offsets: np.ndarray, base: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the table slot of every occurrence and its row."""
    shift = np.uint64(64 - TABLE_BITS)
    yield (base["hashes"] >> shift).astype(np.int64), base["rows"]
    pairs = windows(base["rows"], 2)
    yield (window_hashes(base["hashes"], pairs, 2) >> shift).astype(np.int64), base["rows"][pairs]
    # Characters are code points; where all are ASCII they are the bytes.
    wide = len(data) and data.max() >= 0x80
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32) if wide else data.astype(np.uint32)
    ends = code_points(data)[offsets] if wide else offsets
    char_rows = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    for size in (2, 3, 4):
        if len(code) < size:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        gram = np.zeros(len(code) - size + 1, np.uint32)
        for k in range(size):
            gram = gram * np.uint32(0x01000193) + code[k : len(code) - size + 1 + k]
        slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
        inside = char_rows[: len(slot)] == char_rows[size - 1 :]
        yield slot[inside], char_rows[: len(slot)][inside]


def _sample_features(docs: DataFrame) -> list:
    """doc_id, slots and relative frequencies of each sampled row, the first ones that have MOST_ENTRIES slots in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                base = base_counts(data, offsets)
                slots, values = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for kind, (slot, row) in enumerate(ngram_slots(data, offsets, base)):
                    unique, count = np.unique(slot + (row << TABLE_BITS), return_counts=True)
                    cut = np.searchsorted(unique, np.arange(part.num_rows + 1) << TABLE_BITS)
                    for i in range(part.num_rows):
                        c = count[cut[i] : cut[i + 1]]
                        slots[i].append((unique[cut[i] : cut[i + 1]] & ((1 << TABLE_BITS) - 1)) + (kind << TABLE_BITS))
                        values[i].append(c / max(1, c.sum()))
                pack = lambda x, t: np.concatenate(x).astype(t).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([pack(x, np.int32) for x in slots]), pa.array([pack(x, np.float32) for x in values])], ["id", "y", "slots", "vals"])

    made = settle(docs.mapInArrow(run, "id long, y int, slots binary, vals binary"))
    # A row each of the sample: its running size says where to stop.
    sizes = made.select("id", (F.octet_length("slots") / 4).alias("n"), F.xxhash64("id").alias("order"))
    used = sizes.withColumn("total", F.sum("n").over(W.orderBy("order", "id"))).where(F.col("total") <= MOST_ENTRIES)
    return made.join(F.broadcast(used.select("id")), "id").collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, learn: str = "true") -> DataFrame:
    """id, text, y of at most ``rows`` labelled documents, chosen by a hash of doc_id.

    The chosen ids are bounded by ``rows``, so they may be broadcast. Of several
    texts of one doc_id the one with the least hash is taken, whatever the order of rows.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(learn)
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen.select(F.col("doc_id").alias("id"), "y")), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "t.text", "y")


class NgramModel:
    """Weights by feature kind and slot, an intercept, and the calibration line."""

    def __init__(self, weights: np.ndarray, intercept: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.intercept, self.slope, self.offset = weights.astype(np.float32), intercept, slope, offset

    def probabilities(self, data: np.ndarray, offsets: np.ndarray, base: dict[str, np.ndarray]) -> np.ndarray:
        n = len(offsets) - 1
        z = np.full(n, self.intercept)
        for kind, (slot, row) in enumerate(ngram_slots(data, offsets, base)):
            total = np.bincount(row, minlength=n)
            z += np.bincount(row, weights=self.weights[kind][slot], minlength=n) / np.maximum(1, total)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, steps: int = 100, penalty: float = 1e-4) -> NgramModel | None:
    """None where the labels do not hold both classes."""
    got = sorted(_sample_features(labelled_sample(docs, labels, rows)), key=lambda r: r["id"])
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return None
    sizes = np.array([len(r["slots"]) // 4 for r in got])
    slot = np.frombuffer(b"".join(r["slots"] for r in got), np.int32)
    x = np.frombuffer(b"".join(r["vals"] for r in got), np.float32).copy()
    del got
    give_back()
    begins, size = np.concatenate([[0], np.cumsum(sizes)]), KINDS << TABLE_BITS
    # Blocks of rows bound what a pass over the sample holds at once.
    blocks = [(a, min(a + 100, len(y))) for a in range(0, len(y), 100)]
    aside = (np.arange(len(y)) % 5 == 0) if min(y.sum(), len(y) - y.sum()) >= 20 else np.zeros(len(y), bool)
    share = np.where(y == 1, 0.5 / max(1, (y[~aside] == 1).sum()), 0.5 / max(1, (y[~aside] == 0).sum())) * ~aside
    # Rare slots carry small values; dividing by their root mean square lets one step size serve all.
    scale = np.zeros(size)
    for a, b in blocks:
        part = slice(begins[a], begins[b])
        scale += np.bincount(slot[part], weights=x[part] * x[part], minlength=size)
    scale = 1 / (np.sqrt(scale / len(y)) + 1e-3)
    for a, b in blocks:
        part = slice(begins[a], begins[b])
        x[part] *= scale[slot[part]]
    w, bias, gw, gb, z = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8, np.zeros(len(y))
    for step in range(steps + 1):  # full-batch AdaGrad: deterministic; the last pass only scores
        g, total = penalty * w, 0.0
        for a, b in blocks:
            part = slice(begins[a], begins[b])
            row = np.repeat(np.arange(b - a), sizes[a:b])
            z[a:b] = np.bincount(row, weights=w[slot[part]] * x[part], minlength=b - a) + bias
            err = share[a:b] * (1 / (1 + np.exp(-np.clip(z[a:b], -30, 30))) - y[a:b])
            if step < steps:
                g += np.bincount(slot[part], weights=err[row] * x[part], minlength=size)
                total += err.sum()
        if step < steps:
            gw += g * g
            gb += total**2
            w -= 0.05 * g / np.sqrt(gw)
            bias -= 0.05 * total / np.sqrt(gb)
    slope, offset = platt(z[aside], y[aside]) if aside.any() else (1.0, 0.0)
    return NgramModel((w * scale).reshape(KINDS, -1), bias, slope, offset)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic calibration, by damped Newton steps."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, a, c = np.where(y == 1, high, low), 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, c = max(1e-3, a - step[0]), c - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(c)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, quality_probability and kept for each row."""
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                base = base_counts(data, offsets)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                p = model.probabilities(data, offsets, base) if model else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(base[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], schema=out)

    out = arrow_schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("quality_probability", pa.float64()), ("kept", pa.bool_())])
    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    names = docs.columns
    model = train(docs, labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                base = base_counts(data, offsets)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                p = model.probabilities(data, offsets, base) if model else np.ones(part.num_rows)
                yield part.filter(pa.array(~failed & (p >= THRESHOLD)))

    return docs.select(*names).mapInArrow(run, schema)
