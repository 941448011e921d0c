"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned by quantiles of a bounded training sample
(``SAMPLE`` labelled rows). Cyclic boosting visits the features in turn, fits a
shallow tree (three leaves) to each and adds it to that feature's lookup table;
then the pairs of features that explain most of what is left get
two-dimensional tables of four-leaf trees. A score is a sum of table entries.

Only the text is an input. Rows whose crc32(doc_id as text) mod 5 is 0 are held
out and never learned from; rows without a doc_id are neither held out nor
learned from. Null and empty texts get a score as any other (all counts zero);
very long texts are counted whole. Without labels of both classes every score is the prior. Ties
in the sample go by doc_id; repeated rows are scored each; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, per_row, slices
from .quality import SYMBOLS, base_counts, labelled_sample

#: Most labelled rows that training takes.
SAMPLE = 8000
CUT = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"

NAMES = ["chars", "words", "word_length", "longest", "symbols", "upper", "digits", "marks", "wide", "lines", "line_words", "dup_lines", "repeats", "distinct", "top_word", "symbol_words", "sentence_words", "stray"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGITS, MARKS, STOPS, STRAY = _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b",;:'\"()-"), _class(b".!?"), _class(b"{}[]\\/^~=+_`@")
WIDE = np.arange(256) >= 0x80


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    base = base_counts(data, offsets)
    rows, starts, ends = base["rows"], base["starts"], base["ends"]
    size, words = np.diff(offsets), base["n_words"]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    keys = np.sort(mix(base["hashes"]) >> np.uint64(24) | (rows.astype(np.uint64) << np.uint64(40)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    key_rows = (keys[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, key_rows, np.diff(np.append(first, len(keys))))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, rows, ends - starts)
    marked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marked[1:])
    with_symbol = per_row(rows[marked[ends] > marked[starts]], n)
    per_byte, per_word = 1 / np.maximum(1, size), 1 / np.maximum(1, words)
    return np.column_stack([
        np.log1p(size), np.log1p(words), base["word_chars"] * per_word, longest, base["n_symbols"] * per_byte, count(UPPER) * per_byte, count(DIGITS) * per_byte, count(MARKS) * per_byte, count(WIDE) * per_byte,
        np.log1p(base["lines"]), words / np.maximum(1, base["lines"]), base["n_dup_lines"] / np.maximum(1, base["lines"]), base["n_repeat_words"] * per_word, per_row(key_rows, n) * per_word, top * per_word, with_symbol * per_word,
        words / np.maximum(1, count(STOPS)), count(STRAY) * per_byte,
    ]).astype(np.float64)


class Additive:
    """Bin edges, one table per feature, tables of pairs, an intercept."""

    def __init__(self, edges: list, tables: list, pairs: list, intercept: float):
        self.edges, self.tables, self.pairs, self.intercept = edges, tables, pairs, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        z = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[coarse(bins[i]), coarse(bins[j])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Three leaves over ordered bins: the best cut, then the best cut of either side."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            c = int(np.argmax(gain))
            if gain[c] > best[0]:
                best = (gain[c], k, a + c + 1)
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-leaf tree (one cut on either axis) of a grid, and its gain."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, out = 0.0, np.zeros_like(g)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            parts = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            sums = [(cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c], ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]) for a, b, c, d in parts]
            gain = sum(_gain(*s) for s in sums)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for (a, b, c, d), s in zip(parts, sums, strict=True):
                    out[a:b, c:d] = _leaf(*s)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15) -> Additive:
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(NAMES))]
    model = Additive(edges, [np.zeros(BINS) for _ in edges], [], float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            g, h = slopes()
            tree = rate * shallow_tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS))
            model.tables[k] += tree
            z += tree[b]
    flat_pair = lambda i, j: coarse(bins[i]) * PAIR_BINS + coarse(bins[j])
    grid = lambda i, j, v: np.bincount(flat_pair(i, j), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    ranked = sorted(((quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            g, h = slopes()
            tree = rate * quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += tree
            z += tree.ravel()[flat_pair(i, j)]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Additive:
    """Fit on at most ``rows`` labelled rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    sample = labelled_sample(docs, labels, rows, f"not ({HELD_OUT})")
    got = sorted(sample.mapInArrow(run, "id long, y int, x array<double>").collect(), key=lambda r: r["id"])
    return fit(np.array([r["x"] for r in got], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in got], float))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(*flat(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
