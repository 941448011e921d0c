"""Phrase collocation mining by hashed passes (PCY and DHP) with Apriori pruning before exact counts.

Pass k counts phrases of k words exactly and, in the same reading of the texts,
counts phrases of k + 1 words in hash buckets. A phrase of pass k + 1 is counted
exactly only if its bucket reached the threshold and both phrases of k words in it
did. Buckets and frequent phrases are broadcast as bitmaps of a fixed number of
bits, so what a task holds and receives does not grow with the input; false
positives cost a count, and never change a result.

A task keeps bucket counts in a byte each that stops at the threshold: the sum of
such bytes reaches the threshold exactly where the sum of true counts does. So a
task sends at most one byte a bucket. Exact counts leave a task grouped by slices
of text and are summed before and after the shuffle; a phrase that is a third of
all text arrives as one row a task.

Edge cases: a null text is empty, a null language is ``und`` (and joins rows that
say ``und``); texts without words give nothing; repeated rows count again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, flat, join_unique, mix, settle, slices, span_hashes

#: Least count of a candidate, most words, share (percent) of a phrase that a longer one takes over, rows a language.
LEAST, MOST_WORDS, TAKEN, KEPT = 10, 3, 50, 2000
#: log2 of the number of hash buckets; a bitmap is an eighth of so many bytes.
BUCKET_BITS = 24
CHUNK = 1 << 12
SLICE = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a piece, and those that end a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True


class Tokens:
    """The words of some texts: exact numbers for (language, word), hashes, and which words follow each other in a piece."""

    def __init__(self, batch: pa.RecordBatch):
        raw, offsets = flat(batch.column("text"))
        data = LOWER[raw]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~BREAK[data]
        # A text's end breaks words as a byte between texts would.
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(~inside[1:] & inside[:-1])
        cut = inner[inside[inner] & inside[inner + 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        row = np.searchsorted(offsets, starts, side="right") - 1
        pieces = np.zeros(len(data) + 1, np.int64)
        np.cumsum(PIECE[data], out=pieces[1:])
        self.follows = (row[1:] == row[:-1]) & (pieces[starts[1:]] == pieces[starts[:-1]]) if len(starts) else np.zeros(0, bool)
        size = ends - starts
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        body = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
        texts = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body.tobytes())])
        coded = texts.dictionary_encode()
        languages = batch.column("lang").dictionary_encode()
        lang = languages.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        n_langs = max(1, len(languages.dictionary))
        both, self.number = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_langs + lang, return_inverse=True)
        self.words, self.langs = coded.dictionary.take(pa.array(both // n_langs)), languages.dictionary.take(pa.array(both % n_langs))
        hashes = [span_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*flat(c))) for c in (self.words, self.langs.cast(pa.large_string()))]
        self.hash = mix(hashes[0] + mix(hashes[1] * np.uint64(BASE)))  # of each number

    def __len__(self) -> int:
        return len(self.number)


def _longer(exists: np.ndarray, h: np.ndarray, t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From phrases of n words at each word to those of n + 1: which are inside a piece, and their hashes."""
    out, grown = np.zeros(len(t), bool), np.zeros(len(t), np.uint64)
    at = np.flatnonzero(exists[: len(t) - n])
    at = at[t.follows[at + n - 1]]
    out[at] = True
    grown[at] = mix(h[at] * np.uint64(BASE) + t.hash[t.number[at + n]])
    return out, grown


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _holds(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def _both(ok: np.ndarray) -> np.ndarray:
    """Where a phrase and the one a word later are ok."""
    return ok & np.append(ok[1:], False)


def _phrases(t: Tokens, at: np.ndarray, size: int) -> pa.RecordBatch:
    """Language, phrase and count of the phrases that start at some words; phrases are told apart by their words' numbers."""
    code = t.number[at]
    for k in range(1, size):
        code = np.unique(code, return_inverse=True)[1] * len(t.words) + t.number[at + k]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    words = [t.words.take(pa.array(t.number[at[first] + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if size > 1 else words[0]
    return _rows("g", t.langs.take(pa.array(t.number[at[first]])), phrase, pa.array(n))


NAMES = ["kind", "lang", "phrase", "n", "chunk", "held"]
DDL = "kind string, lang string, phrase string, n long, chunk int, held binary"


def _rows(kind: str, lang: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), lang.cast(pa.string()), phrase.cast(pa.string()), n.cast(pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], NAMES)


def _chunks(table: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a table that hold anything."""
    cells = table.reshape(-1, width)
    used = np.flatnonzero(cells.any(axis=1))
    for k in range(0, len(used), 256):
        at = used[k : k + 256]
        size = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(["b"] * size, pa.string()), *(pa.nulls(size, x) for x in (pa.string(), pa.string(), pa.int64())), pa.array(at.astype(np.int32)), pa.array([cells[c].tobytes() for c in at], pa.binary())], NAMES)


def _pass(docs: DataFrame, size: int, bits: int, least: int, last: bool, frequent: np.ndarray | None, buckets: np.ndarray | None) -> DataFrame:
    """Partial counts of phrases of ``size`` words (kind g) and, but for the last pass, bucket counts of those of one word more (kind b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0 if last else 1 << bits, np.uint8)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                t = Tokens(part)
                if not len(t):
                    continue
                ok, h = np.ones(len(t), bool), t.hash[t.number]
                for n in range(1, size):
                    if n == size - 1:
                        frequent_before = ok & _holds(frequent, _bucket(h, bits))
                    ok, h = _longer(ok, h, t, n)
                if size > 1:
                    ok &= _both(frequent_before) & _holds(buckets, _bucket(h, bits))
                yield _phrases(t, np.flatnonzero(ok), size)
                if not last:
                    more, h = _longer(ok, h, t, size)
                    at, n = np.unique(_bucket(h[more & _both(ok)], bits), return_counts=True)
                    counts[at] = np.minimum(counts[at] + n, least)
        if not last:
            yield from _chunks(counts, CHUNK)

    return docs.mapInArrow(run, DDL)


def _merged(rows: DataFrame, least: int, bits: int, width: int) -> np.ndarray:
    """The bitmap that chunks of counts (width CHUNK) or of bits give together: 2**bits / 8 bytes, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most all chunks: 2**bits bytes
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("held").to_pylist(), strict=True):
                new = np.frombuffer(body, np.uint8)
                old = held.get(chunk, 0)
                held[chunk] = np.minimum(old + new, least) if width == CHUNK else old | new
        made = [(np.packbits(v >= least) if width == CHUNK else v).tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made, pa.binary())], ["chunk", "held"])

    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, CHUNK // 8)
    for r in rows.where("kind = 'b'").select("chunk", "held").repartition("chunk").mapInArrow(run, "chunk int, held binary").collect():
        out[r["chunk"]] = np.frombuffer(r["held"], np.uint8)
    return out.ravel()


def _bitmap(known: DataFrame, size: int, bits: int) -> np.ndarray:
    """The buckets of frequent phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                t = Tokens(part)
                ok, h = np.ones(len(t), bool), t.hash[t.number]
                for n in range(1, size):
                    ok, h = _longer(ok, h, t, n)
                at = _bucket(h[ok], bits)
                np.bitwise_or.at(held, at >> 3, (np.uint8(128) >> (at & 7).astype(np.uint8)))
        yield from _chunks(held, CHUNK // 8)

    return _merged(known.select(F.col("phrase").alias("text"), "lang").mapInArrow(run, DDL), 0, bits, CHUNK // 8)


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, bits: int = BUCKET_BITS) -> tuple[list[DataFrame], DataFrame]:
    """(lang, phrase, a) with a >= least for phrases of 1, 2, ... words, and (lang, n): all words of each language."""
    if not 1 <= least <= 127:
        raise ValueError("the threshold is kept in a byte: 1 to 127")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    out, total, frequent, buckets = [], None, None, None
    for size in range(1, most_words + 1):
        rows = settle(_pass(texts, size, bits, least, size == most_words, frequent, buckets))
        exact = rows.where("kind = 'g'")
        if size == 1:
            total = exact.groupBy("lang").agg(F.sum("n").alias("n"))
        out.append(settle(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)))
        if size < most_words:
            frequent, buckets = _bitmap(out[-1], size, bits), _merged(rows, least, bits, CHUNK)
    return out, total


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, taken: int = TAKEN, kept: int = KEPT, bits: int = BUCKET_BITS) -> DataFrame:
    """The first ``kept`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least, over its cuts in two, of 1000000 a**2 / (l r)
    rounded down; it is dropped where a longer candidate that holds it has at least
    ``taken`` percent of its occurrences. Products are decimals of 38 digits:
    exact for phrases found less than 10**16 times.
    """
    frequent, total = frequent_phrases(docs, least, most_words, bits)
    candidates = frequent[1]
    for more in frequent[2:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.withColumn("words", F.split("phrase", " "))
    inside = candidates.select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, greatest(2, size(words) - 1)), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))")).alias("inner"), "phrase").where("inner <> phrase")
    longest = inside.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longest"))
    left = candidates.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < taken * F.col("a"), F.lit(True)))
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)  # noqa: E731 - a phrase holds no line break
    cuts = left.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> named_struct('k', k, 'first', array_join(slice(words, 1, k), ' '), 'rest', array_join(slice(words, k + 1, size(words)), ' ')))")).alias("cut"))
    asks = cuts.select("lang", "phrase", "a", F.col("cut.k").alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("cut.first").alias("part")), F.struct(F.lit(1).alias("side"), F.col("cut.rest").alias("part")))).alias("ask")).select("lang", "phrase", "a", "k", "ask.side", key(F.col("ask.part")).alias("key"))
    asks = settle(asks)
    known = frequent[0]
    for more in frequent[1:-1]:
        known = known.unionByName(more)
    known = asks.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(known.select(key(F.col("phrase")).alias("key"), F.col("a").alias("f")), "key")
    answers = join_unique(asks, known, "key").repartition("lang", "phrase")
    parts = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # First within shares of a language, so that no task ranks a whole one.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= kept).drop("share", "rank")
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= kept)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
