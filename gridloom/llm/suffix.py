"""Repeated-passage removal by suffix arrays.

Every byte of a document goes that is covered by a 50-byte string which also
starts in a document with a smaller doc_id (judged on the input).

1. Exact copies of a text (by SHA-256) are settled at once: of each text only
   the document with the smallest id goes on.
2. Texts are written in chunks of a few MB, bucketed, so that the passes over
   them shuffle nothing but short answers.
3. The least hash of the 27 24-byte strings inside a 50-byte string is its
   anchor: equal strings have equal anchors. Chunks send their distinct
   anchors to buckets; a bucket answers a bit for each: found in two documents.
4. Runs of strings with a shared anchor go, as text, to the anchor's bucket.
   There a suffix array is built by two-stage sorting: only suffixes smaller
   than their successors are sorted directly, the others are induced by a scan
   over the character buckets; adjacent common prefixes of 50 bytes or more
   then give the groups of equal strings, and the smallest doc_id of each.
5. An anchor with more than ``HOT_RUNS`` different runs (a phrase of 24 to 49
   bytes in ever new surroundings, say) is hot. Its strings are keyed by their
   own 50 bytes instead: repeats inside a chunk are settled there, the hashes of
   the rest are asked about like anchors, and only strings that two chunks hold
   are sent, to as many buckets as there are different strings.
6. The spans found go back to their chunks, which cut them out.

Anchors only save work: every string is compared as bytes in step 4. What keeps
the pieces small at any input: the numbers of buckets follow the bytes of text,
with no ceiling on those that are held in memory; anchors are mixed again before
they are dealt, as minima crowd near zero; a run that the chunks read together hold
in several documents is sent once; an anchor brings at most 4 * HOT_RUNS
different runs to one array, and a hot string, as 50 equal bytes, at most one for
each chunk that holds it (16 MB of text: 6 million at 100 TB); runs are cut at ``MOST_RUN`` starts, so that texts of one short period,
whatever their lengths, give equal pieces. The buckets of chunks, which are read
as a stream, grow to 256 MB where the input is beyond 100,000 of them; from
``LARGE`` on chunks are four times as large, so that a chunk's message to a bucket
of anchors still holds several, and joins sort (and spill) instead of hashing.

Null texts are empty; texts under 50 bytes lose nothing; very long texts make
chunks of their own; a null doc_id counts as larger than any other; documents of
equal doc_id don't cut each other (the largest long and null count as equal);
repeated rows give one row each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, BYTE_CODES, delete, flat, give_back, join_unique, mix, powers, settle, shared_dir, span_hashes

LENGTH, GRAM = 50, 24
CHUNK_BYTES = 4 << 20
#: Text whose shared runs are sent together.
TOGETHER = 32 << 20
#: Text whose anchors are made at once: what the arrays for it fill fits the processor's cache.
BLOCK_BYTES = 1 << 17
#: Starts of one run at most; equal strings meet by their anchors wherever runs are cut.
MOST_RUN = 1024
#: Different runs of an anchor, counted down to a power of four in each chunk, beyond which its strings are keyed by themselves.
HOT_RUNS = 2048
#: Bits of an anchor that carry what a chunk says about it: held by two documents, and the power of four.
TOLD = np.uint64(15)
#: Strings of hot runs that are settled at once.
HOT_BLOCK = 1 << 20
#: Text that one suffix array holds, unless the runs of a single anchor are more.
PIECE_BYTES = 1 << 19
#: Bytes of text that one bucket of chunks, of anchors and of runs stands for.
CHUNK_BUCKET, ANCHOR_BUCKET, RUN_BUCKET = 16 << 20, 8 << 20, 4 << 20
#: Where there is very much text, buckets of anchors grow up to this, so that a chunk has several anchors for each.
WIDEST_ANCHOR_BUCKET, MANY = 256 << 20, 20_000
#: Buckets of chunks beyond which they grow, up to this size.
MOST_BUCKETS, WIDEST_CHUNK_BUCKET = 100_000, 256 << 20
#: Bytes of text from which on chunks are larger and joins sort.
LARGE = 4 << 40
LARGEST = (1 << 63) - 1
#: Repeated rows that are given out from one list.
REPEATS = 10_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all LENGTH-byte strings inside one text, and each one's anchor."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(BASE, n), powers(BASE_INVERSE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=total[1:])
    low = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    span, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    inside = np.ones(len(low), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(inside)
    return starts, low[starts]


def chunk_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, and anchor, of the runs of a whole chunk, made block by block."""
    found = []
    for a in range(0, max(1, len(data) - LENGTH + 1), BLOCK_BYTES):
        b = min(len(data), a + BLOCK_BYTES + LENGTH - 1)
        inner = offsets[(offsets > a) & (offsets < b)]
        first, last, low = runs(*anchors(data[a:b], np.concatenate([[0], inner - a, [b - a]])))
        found.append((first + a, last + a, mix(low) | TOLD))  # minima crowd near zero: spread anew
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(starts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring strings with one anchor, at most MOST_RUN of them to a run."""
    if not len(starts):
        return starts, starts, low
    cut = np.flatnonzero((np.diff(starts) != 1) | (low[1:] != low[:-1])) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.append(first, len(starts)))
    if size.max() > MOST_RUN:
        pieces = -(-size // MOST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * MOST_RUN
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], low[first]


def run_hashes(data: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[first:end], made block by block; ``first`` ascends."""
    out = np.zeros(len(first), np.uint64)
    if not len(first):
        return out
    for a in range(int(first[0]), int(first[-1]) + 1, BLOCK_BYTES):
        i, j = np.searchsorted(first, [a, a + BLOCK_BYTES])
        if j > i:
            out[i:j] = span_hashes(data[a : int(ends[i:j].max())], first[i:j] - a, ends[i:j] - a)
    return out


def equal_strings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the LENGTH-byte strings at a and at b are the same."""
    strings, out = np.lib.stride_tricks.sliding_window_view(data, LENGTH), a == b
    rest = np.flatnonzero(~out)
    for i in range(0, len(rest), 1 << 16):
        k = rest[i : i + (1 << 16)]
        out[k] = (strings[a[k]] == strings[b[k]]).all(axis=1)
    return out


def hot_strings(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """By blocks of hot runs: hash and start of each different string, and the spans that a larger document repeats.

    A string comes once for its smallest document: at its first start in each of that document's texts.
    """
    done = np.concatenate([[0], np.cumsum(last - first + 1)])
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(done, done[a] + HOT_BLOCK, side="right")) - 1)
        size = last[a:b] - first[a:b] + 1
        starts = np.repeat(first[a:b] - (done[a:b] - done[a]), size) + np.arange(size.sum())
        hashes, owners = run_hashes(data, starts, starts + LENGTH), np.repeat(owner[a:b], size)
        order = np.lexsort((starts, owners, hashes))
        hashes, starts, owners = hashes[order], starts[order], owners[order]
        texts = np.searchsorted(offsets, starts, side="right")
        head = np.append(True, hashes[1:] != hashes[:-1])
        least = np.flatnonzero(head)[np.cumsum(head) - 1]
        same = equal_strings(data, starts, starts[least])
        gone = same & (owners > owners[least])
        again = same & (owners == owners[least]) & np.append(False, texts[1:] == texts[:-1]) & ~head
        ask = ~gone & ~again
        yield hashes[ask], starts[ask], *joined(starts[gone], starts[gone] + LENGTH)
        a = b


def echoes(data: np.ndarray, offsets: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """All starts, in the same texts, of the strings that start at ``hits`` (ascending)."""
    found, text = [hits], np.searchsorted(offsets, hits, side="right") - 1
    for t in np.unique(text):
        mine, a, b = hits[text == t], int(offsets[t]), int(offsets[t + 1])
        known = run_hashes(data, mine, mine + LENGTH)
        order = np.argsort(known, kind="stable")
        known, mine = known[order], mine[order]
        for s in range(a, b - LENGTH + 1, BLOCK_BYTES):
            starts = np.arange(s, min(s + BLOCK_BYTES, b - LENGTH + 1))
            hashes = run_hashes(data, starts, starts + LENGTH)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            like = np.flatnonzero(known[at] == hashes)
            found.append(starts[like][equal_strings(data, starts[like], mine[at[like]])])
    return np.unique(np.concatenate(found))


def words_of(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number."""
    n = len(text) - 7
    out = text[:n].astype(np.uint64)
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= text[k : n + k]
    return out


def suffix_order(text: np.ndarray, keys: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The needed positions in the order of their suffixes, exact for LENGTH bytes.

    ``keys`` are words_of(text); ``text`` ends in LENGTH + 16 zero bytes, which
    are never needed. A needed
    position whose suffix is larger than the next one's is induced from it, so
    the next position must be needed too.
    """
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])  # over 0: a smaller suffix than its successor
    turn = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = np.ones(n, bool)  # the zero tail counts as smaller: sorted directly
    known = turn < n - 1
    smaller[:-1][known] = step[turn[known]] > 0
    direct = np.flatnonzero(needed & smaller)
    order = direct[np.argsort(keys[direct], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    for depth in range(8, LENGTH, 8):  # only what is still tied is compared further
        if not same.any():
            break
        group = np.cumsum(np.append(True, ~same))
        tied = np.append(same, False) | np.append(False, same)
        at, g = order[tied], group[tied]
        k = keys[np.minimum(at + depth, n - 8)]
        by = np.lexsort((k, g))
        order[tied] = at[by]
        fresh = keys[np.minimum(order + depth, n - 8)]
        same = same & (fresh[1:] == fresh[:-1])
    # Character buckets: larger suffixes stand before the directly sorted ones.
    larger = needed & ~smaller
    count_larger = np.bincount(text[larger], minlength=256)
    count_direct = np.bincount(text[direct], minlength=256)
    base = np.concatenate([[0], np.cumsum(count_larger + count_direct)])[:-1]
    out = np.full(int(count_larger.sum() + count_direct.sum()), -1, np.int64)
    head = base.copy()
    chars = text[order]
    out[np.arange(len(order)) - np.concatenate([[0], np.cumsum(count_direct)])[:-1][chars] + (base + count_larger)[chars]] = order

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return
        c = text[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by].astype(np.int64)
        counts = np.bincount(c, minlength=256)
        out[head[c] + np.arange(len(c)) - np.concatenate([[0], np.cumsum(counts)])[:-1][c]] = before
        np.add(head, counts, out=head)

    for c in range(256):
        done, end = base[c], base[c] + count_larger[c]
        while done < head[c]:
            stop = head[c]
            induce(out[done:stop])
            done = stop
        if count_direct[c]:
            induce(out[end : end + count_direct[c]])
    return out


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each position with the one before it, up to LENGTH."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for depth in range(0, LENGTH, 8):
        if not len(alive):
            break
        x = keys[order[alive] + depth] ^ keys[order[alive - 1] + depth]
        same = x == 0
        out[alive[same]] += 8
        rest = x[~same]
        zero_bytes = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            zero_bytes += (rest >> np.uint64(64 - 8 * k)) == 0
        out[alive[~same]] += zero_bytes
        alive = alive[same]
    return np.minimum(out, LENGTH)


def repeats(pieces: list[np.ndarray], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of every LENGTH-byte string that a piece of a smaller owner holds too."""
    sizes = np.array(list(map(len, pieces)), np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(begins[-1]) + LENGTH + 16, np.uint8)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(pieces)), sizes)
    text[at] = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(int(begins[-1])) - begins[:-1][piece]
    wanted = np.zeros(len(text), bool)
    wanted[: len(offset)] = offset + LENGTH <= sizes[piece]
    # What an induced suffix leans on: on from a wanted start to the first suffix smaller than its successor.
    needed = wanted.copy()
    falls = text[:-1] >= text[1:]
    edge = np.flatnonzero(wanted[:-1] & ~wanted[1:])
    while len(edge):
        edge = edge[falls[edge]] + 1
        edge = edge[~needed[edge]]
        needed[edge] = True
        edge = edge[edge < len(text) - LENGTH - 8]
    keys = words_of(text)
    order = suffix_order(text, keys, needed)
    order = order[wanted[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group_first = np.flatnonzero(common_prefixes(keys, order) < LENGTH)
    owner = owners[piece[order]]
    least = np.repeat(np.minimum.reduceat(owner, group_first), np.diff(np.append(group_first, len(order))))
    hit = np.sort(order[owner > least])
    return piece[hit], offset[hit]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as sorted spans that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)]


@contextlib.contextmanager
def _by_bucket(spark: SparkSession, n_buckets: int):
    """While texts lie by bucket, joins on the bucket and more need no new dealing; tables may have so many buckets."""
    buckets = "spark.sql.sources.bucketing.maxBuckets"
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", buckets: str(max(n_buckets, int(spark.conf.get(buckets))))}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextlib.contextmanager
def _dropped(spark: SparkSession, name: str, folder: str):
    """The table and its folder go in the end, whatever happens."""
    try:
        yield
    finally:
        spark.sql(f"drop table if exists {name}")
        delete(spark, folder)


def _parts(lists: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (and kept_bytes on demand)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("doc"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = texts.select("doc", "none", F.sha2(F.col("text"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), *([F.when(F.octet_length("text") < LENGTH, F.col("text").cast("binary")).alias("short")] if with_text else []))
    rows = settle(marks.groupBy("doc", "none", "sha", "n_bytes").agg(F.count(F.lit(1)).alias("times"), *([F.first("short").alias("short")] if with_text else [])))
    firsts = settle(rows.groupBy("sha").agg(F.min("doc").alias("first"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies")))
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = lambda each: int(max(least, -(-total // each)))
    n_buckets = share(min(max(CHUNK_BUCKET, total // MOST_BUCKETS), WIDEST_CHUNK_BUCKET))
    chunk_bytes, how = (4 * CHUNK_BYTES, "merge") if total >= LARGE else (CHUNK_BYTES, "shuffle_hash")
    n_anchor, n_run = share(min(max(ANCHOR_BUCKET, total // MANY), WIDEST_ANCHOR_BUCKET)), share(RUN_BUCKET)
    # What texts are dealt by takes many values, so that the partitions come out even.
    bucket_of = F.hash("doc", "sha").alias("bucket")

    # Chunks: texts of one partition, a few MB to a row, under the bucket of their first text.
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, last = [], 0, itertools.count(TaskContext.get().partitionId() << 32), None

        def packed() -> pa.RecordBatch:
            blobs = [t for *_, t in held]
            return _parts([[held[0][0]], [next(made)], [[d for _, d, _, _ in held]], [[s for _, _, s, _ in held]], [np.cumsum([0, *map(len, blobs)])], [b"".join(blobs)]], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()], ["bucket", "chunk", "docs", "shas", "offsets", "data"])

        for batch in batches:
            give_back()
            for bucket, doc, sha, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if (doc, sha) == last:  # a repeated row: its result is given out once for each row at the end
                    continue
                last = (doc, sha)
                held.append((bucket, doc, sha, text))
                size += len(text)
                if size >= chunk_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    name = f"chunks_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    with _by_bucket(spark, n_buckets), _dropped(spark, name, folder):  # fewer buckets than shuffle partitions would be dealt anew
        sources = firsts.where(F.col("n_bytes") >= LENGTH).select(F.col("first").alias("doc"), "sha").select(bucket_of, "*").repartition(n_buckets, "bucket")
        dealt = texts.where(F.octet_length("text") >= LENGTH).select("doc", F.sha2(F.col("text"), 256).alias("sha"), "text").select(bucket_of, "*").repartition(n_buckets, "bucket")
        # An inner join: a semi-join would be moved below the dealing, and texts dealt twice. Sources are unique.
        packed = dealt.join(sources.hint("merge"), ["bucket", "doc", "sha"]).sortWithinPartitions("bucket", "doc", "sha")
        packed = packed.mapInArrow(pack, "bucket int, chunk long, docs array<long>, shas array<string>, offsets array<long>, data binary")
        packed.write.option("compression", "zstd").option("path", folder).bucketBy(n_buckets, "bucket").format("parquet").saveAsTable(name)
        chunks = spark.table(name)
        answers = settle(_answers(chunks, n_anchor))
        spans = settle(_spans(chunks, answers, n_anchor, n_run, how))
        hot = spans.where("again is not null").select("bucket", "chunk", "again")
        found = spans.where("from is not null").select("bucket", "chunk", "from", "to", F.lit(None).cast("binary").alias("hits"))
        if not hot.isEmpty():
            hits = _hot_spans(chunks, hot, n_run, how)
            found = found.unionByName(settle(hits), allowMissingColumns=True)
        gathered = settle(found.groupBy("bucket", "chunk").agg(*(F.collect_list(c).alias(c) for c in ("from", "to", "hits"))))
        cut = settle(_cut(chunks, gathered, with_text, how))
    whole = join_unique(rows, firsts.select("sha", "first", "copies"), "sha").join(cut, ["doc", "sha"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    out = whole.select(
        F.when(~F.col("none"), F.col("doc")).alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept_bytes", "short")).alias("kept_bytes")] if with_text else []),  # texts under LENGTH bytes were not packed
        F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(REPEATS))).alias("_from"),  # a row for each of the repeated ones, by lists of bounded length
        "times",
    )
    return out.withColumn("_time", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + REPEATS, F.col("times")) - 1))).drop("_time", "_from", "times")


def _each(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        row = batch.slice(k, 1)
        offsets = np.array(row.column("offsets")[0].as_py(), np.int64)
        data, _ = flat(row.column("data"))
        yield row, data, offsets


def _owned_runs(row: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, last, anchor and document of the runs of a chunk."""
    first, last, low = chunk_runs(data, offsets)
    return first, last, low, np.array(row.column("docs")[0].as_py(), np.int64)[np.searchsorted(offsets, first, side="right") - 1]


def _split(values: np.ndarray, n: int) -> np.ndarray:
    """Where the values of each of n buckets begin among ordered values."""
    return np.searchsorted(_bucket(values, n), np.arange(n + 1))


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _answers(chunks: DataFrame, n_anchor: int) -> DataFrame:
    """bucket, chunk, bits: for each bucket of anchors one bit an anchor, whether two documents hold it, and which are hot."""

    def sent(data: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct anchors in order; TOLD less one where two documents hold it, less twice the power of four of its different runs."""
        if not len(low):
            return low
        order = np.lexsort((doc, low))
        starts = np.flatnonzero(np.append(True, low[order][1:] != low[order][:-1]))
        ends = np.append(starts[1:], len(low)) - 1
        power = np.zeros(len(starts), np.uint64)
        count = ends - starts + 1
        several = np.flatnonzero(count >= 4)
        if len(several):
            group = np.zeros(len(low), np.int64)
            group[order] = np.repeat(np.arange(len(starts)), count)
            use = np.flatnonzero(count[group] >= 4)  # runs in the order of the chunk
            pairs = np.stack([group[use], run_hashes(data, first[use], last[use] + LENGTH).view(np.int64)])
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            differ = np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))
            runs_of = np.bincount(pairs[0][differ], minlength=len(starts))[several]
            power[several] = np.searchsorted(4 ** np.arange(1, 8), runs_of, side="right")
        two = (doc[order][starts] != doc[order][ends]).astype(np.uint64)
        return low[order][starts] - two - power * np.uint64(2)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for row, data, offsets in _each(batch):
                values = sent(data, *_owned_runs(row, data, offsets))
                cut = _split(values, n_anchor)
                full = np.flatnonzero(np.diff(cut))
                yield _parts([full, [row.column("bucket")[0].as_py()] * len(full), [row.column("chunk")[0].as_py()] * len(full), [values[cut[k] : cut[k + 1]].tobytes() for k in full]], [pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["anchor_bucket", "bucket", "chunk", "anchors"])

    def answer(part: pa.Table) -> pa.Table:
        give_back()
        lists = [np.frombuffer(x, np.uint64) for x in part.column("anchors").to_pylist()]
        values = np.concatenate(lists)
        told = TOLD - (values & TOLD)
        known, at, count = np.unique(values | TOLD, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[at[(told & np.uint64(1)) == 1]] = True
        hot = shared & (np.bincount(at, weights=4.0 ** (told >> np.uint64(1)), minlength=len(known)) > HOT_RUNS)
        flags, hot, cut = shared[at], hot[at], np.cumsum([0, *map(len, lists)])
        mine = [slice(cut[k], cut[k + 1]) for k in range(len(lists))]
        out = part.drop_columns(["anchors"]).append_column("bits", pa.array([np.packbits(flags[x]).tobytes() for x in mine], pa.binary()))
        return out.append_column("hot", pa.array([np.flatnonzero(hot[x]).astype(np.uint32).tobytes() for x in mine], pa.binary()))

    asked = chunks.mapInArrow(ask, "anchor_bucket int, bucket int, chunk long, anchors binary")
    answered = asked.groupBy("anchor_bucket").applyInArrow(answer, "anchor_bucket int, bucket int, chunk long, bits binary, hot binary")
    return answered.groupBy("bucket", "chunk").agg(F.collect_list(F.struct("anchor_bucket", "bits", "hot")).alias("bits"))


RUN_NAMES = ["run_bucket", "bucket", "chunk", "low", "owner", "first", "size", "data"]
RUN_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def _dealt(index: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of n buckets that the keys of ``index`` fall into, with those of them in it."""
    to = _bucket(keys[index], n)
    by = np.argsort(to, kind="stable")
    index, to = index[by], to[by]
    edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(index))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(to[a]), index[a:b]


def _compare(part: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """bucket, chunk and starts of the strings of a bucket of runs that a smaller document holds too."""
    give_back()
    cells = [part.column(c).to_pylist() for c in ("bucket", "chunk", "low", "owner", "first", "size", "data")]
    source = np.repeat(np.arange(part.num_rows), [len(x) // 8 for x in cells[2]])
    low = np.concatenate([np.frombuffer(x, np.uint64) for x in cells[2]])
    owner, first, size = (np.concatenate([np.frombuffer(x, np.int64) for x in cells[k]]) for k in (3, 4, 5))
    data = np.frombuffer(b"".join(cells[6]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(low, kind="stable")
    # Runs whose anchor came alone (their other home is the same document) need no array.
    firsts = np.flatnonzero(np.append(True, low[order][1:] != low[order][:-1]))
    counts = np.diff(np.append(firsts, len(order)))
    order = order[np.repeat(counts > 1, counts)]
    found_source, found_from = [], []
    low_o, size_o = low[order], size[order]
    done, a = np.concatenate([[0], np.cumsum(size_o)]), 0
    while a < len(order):
        b = int(np.searchsorted(done, done[a] + PIECE_BYTES))
        b = min(max(b, a + 1), len(order))
        while b < len(order) and low_o[b] == low_o[b - 1]:
            b += 1
        use = order[a:b]
        piece, start = repeats([data[begin[j] : begin[j + 1]] for j in use.tolist()], owner[use])
        found_source.append(source[use[piece]])
        found_from.append(first[use[piece]] + start)
        a = b
    rows = np.concatenate(found_source) if found_source else np.zeros(0, np.int64)
    starts = np.concatenate(found_from) if found_from else np.zeros(0, np.int64)
    by = np.argsort(rows, kind="stable")
    rows, starts = rows[by], starts[by]
    for r in np.unique(rows):
        lo, hi = np.searchsorted(rows, [r, r + 1])
        yield cells[0][r], cells[1][r], starts[lo:hi]


FOUND_NAMES = ["bucket", "chunk", "from", "to", "again"]
FOUND_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _spans(chunks: DataFrame, answers: DataFrame, n_anchor: int, n_run: int, how: str) -> DataFrame:
    """bucket, chunk, from, to: spans to cut out of a chunk; or bucket, chunk, again: starts of hot strings that other chunks hold too."""

    def shared(row: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Hot strings; bucket, chunk; first, last, anchor, document and bytes of the other runs whose anchor two documents hold."""
        first, last, low, owner = _owned_runs(row, data, offsets)
        values = np.unique(low)
        cut, flags, hot = _split(values, n_anchor), np.zeros(len(values), bool), np.zeros(len(values), bool)
        for x in row.column("bits")[0].as_py() or []:
            a, b = cut[x["anchor_bucket"]], cut[x["anchor_bucket"] + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
            hot[a + np.frombuffer(x["hot"], np.uint32).astype(np.int64)] = True
        at, raw = np.searchsorted(values, low), data.tobytes()
        use, many = flags[at] & ~hot[at], hot[at]
        strings = hot_strings(data, offsets, first[many], last[many], owner[many])
        first, last = first[use], last[use]
        return strings, row.column("bucket")[0].as_py(), row.column("chunk")[0].as_py(), first, last, low[use], owner[use], [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def ask(strings: Iterator[tuple[np.ndarray, ...]], bucket: int, chunk: int) -> Iterator[pa.RecordBatch]:
        for hashes, starts, *gone in strings:  # block by block: all of a group's would not fit
            if len(gone[0]):
                yield _parts([[-1], [bucket], [chunk], [b""], [b""], [gone[0].tobytes()], [gone[1].tobytes()], [b""]], RUN_TYPES, RUN_NAMES)
            asked = [(n_run + to, bucket, chunk, hashes[i].tobytes(), b"", starts[i].astype(np.uint32).tobytes(), b"", b"") for to, i in _dealt(np.arange(len(hashes)), hashes, n_run)]
            yield _parts(list(zip(*asked, strict=True)), RUN_TYPES, RUN_NAMES)

    def give(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # Of runs with the same bytes in several documents only the smallest document's are sent.
        least: dict[bytes, int] = {}
        for *_, owner, texts_of in held:
            for t, d in zip(texts_of, owner.tolist(), strict=True):
                if least.get(t, d) >= d:
                    least[t] = d
        for bucket, chunk, first, last, low, owner, texts_of in held:
            keep = np.fromiter((least[t] == d for t, d in zip(texts_of, owner.tolist(), strict=True)), bool, len(texts_of))
            gone_from, gone_to = joined(first[~keep], last[~keep] + LENGTH)
            if len(gone_from):
                yield _parts([[-1], [bucket], [chunk], [b""], [b""], [gone_from.tobytes()], [gone_to.tobytes()], [b""]], RUN_TYPES, RUN_NAMES)
            index = np.flatnonzero(keep)
            if not len(index):
                continue
            out = []
            for to, i in _dealt(index, low, n_run):
                out.append((to, bucket, chunk, low[i].tobytes(), owner[i].tobytes(), first[i].tobytes(), (last[i] - first[i] + LENGTH).tobytes(), b"".join(texts_of[j] for j in i.tolist())))
            yield _parts(list(zip(*out, strict=True)), RUN_TYPES, RUN_NAMES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, data, offsets in _each(batch):
                give_back()
                strings, *found = shared(row, data, offsets)
                yield from ask(strings, *found[:2])
                held.append(found)
                size += len(data)
                if size >= TOGETHER:
                    yield from give(held)
                    held, size = [], 0
        yield from give(held)

    def spans_of(part: pa.Table) -> pa.Table:
        kind, out = part.column("run_bucket")[0].as_py(), []
        if kind < 0:
            found = pa.table([part.column(c) for c in ("bucket", "chunk", "first", "size")], FOUND_NAMES[:4])
            return found.append_column("again", pa.nulls(found.num_rows, pa.binary()))
        if kind < n_run:
            out = [(bucket, chunk, *(x.tobytes() for x in joined(s, s + LENGTH)), None) for bucket, chunk, s in _compare(part)]
        else:  # hashes of hot strings: those asked about more than once
            give_back()
            lists = [np.frombuffer(x, np.uint64) for x in part.column("low").to_pylist()]
            _, at, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            two = np.split(count[at] > 1, np.cumsum([len(x) for x in lists])[:-1])
            for bucket, chunk, starts, t in zip(*(part.column(c).to_pylist() for c in ("bucket", "chunk", "first")), two, strict=True):
                if t.any():
                    out.append((bucket, chunk, None, None, np.frombuffer(starts, np.uint32)[t].tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, FOUND_TYPES, strict=True)], FOUND_NAMES)

    told = chunks.select("bucket", "chunk", "docs", "offsets", "data").join(answers.hint(how), ["bucket", "chunk"])
    sent = told.mapInArrow(send, "run_bucket int, bucket int, chunk long, low binary, owner binary, first binary, size binary, data binary")
    # Three kinds of rows in one pass over the chunks: runs to compare, hot strings to ask about (buckets from n_run on), and spans settled where they were found (run_bucket -1, spread by chunk).
    dealt = sent.withColumn("group", F.when(F.col("run_bucket") >= 0, F.col("run_bucket").cast("long")).otherwise(-1 - F.col("chunk")))
    return dealt.groupBy("group").applyInArrow(spans_of, "bucket int, chunk long, from binary, to binary, again binary")


def _hot_spans(chunks: DataFrame, hot: DataFrame, n_run: int, how: str) -> DataFrame:
    """bucket, chunk, hits: starts of hot strings (the first in their text) that a smaller document holds too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for row, data, offsets in _each(batch):
                starts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in row.column("again")[0].as_py()])).astype(np.int64)
                hashes, owner = run_hashes(data, starts, starts + LENGTH), np.array(row.column("docs")[0].as_py(), np.int64)[np.searchsorted(offsets, starts, side="right") - 1]
                strings, size = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.full(len(starts), LENGTH)
                bucket, chunk = row.column("bucket")[0].as_py(), row.column("chunk")[0].as_py()
                out = [(to, bucket, chunk, *(x[i].tobytes() for x in (hashes, owner, starts, size)), strings[starts[i]].tobytes()) for to, i in _dealt(np.arange(len(starts)), hashes, n_run)]
                yield _parts(list(zip(*out, strict=True)), RUN_TYPES, RUN_NAMES)

    def hits_of(part: pa.Table) -> pa.Table:
        cols = list(zip(*((bucket, chunk, s.tobytes()) for bucket, chunk, s in _compare(part)), strict=True)) or [[]] * 3
        return pa.table([pa.array(x, t) for x, t in zip(cols, FOUND_TYPES[:3], strict=True)], ["bucket", "chunk", "hits"])

    asked = settle(hot.groupBy("bucket", "chunk").agg(F.collect_list("again").alias("again")))
    told = chunks.select("bucket", "chunk", "docs", "offsets", "data").join(asked.hint(how), ["bucket", "chunk"])
    sent = told.mapInArrow(send, "run_bucket int, bucket int, chunk long, low binary, owner binary, first binary, size binary, data binary")
    return sent.groupBy("run_bucket").applyInArrow(hits_of, "bucket int, chunk long, hits binary")


def _cut(chunks: DataFrame, spans: DataFrame, with_text: bool, how: str) -> DataFrame:
    """doc, sha, removed, spans, kept, kept_bytes of each packed text."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for row, data, offsets in _each(batch):
                gather = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in row.column(c)[0].as_py() or [])])
                starts, ends, hits = gather("from"), gather("to"), gather("hits")
                if len(hits):
                    more = echoes(data, offsets, np.sort(hits))
                    starts, ends = np.concatenate([starts, more]), np.concatenate([ends, more + LENGTH])
                starts, ends = joined(starts, ends)
                gone = np.zeros(len(data) + 1, np.int8)
                gone[starts] += 1
                gone[ends] -= 1
                gone = np.cumsum(gone[:-1], dtype=np.int8) > 0
                out = []
                for doc, sha, a, b in zip(row.column("docs")[0].as_py(), row.column("shas")[0].as_py(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    g = gone[a:b]
                    n = int(g.sum())
                    kept = data[a:b][~g].tobytes() if n or with_text else b""
                    out.append((doc, sha, n, int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest() if n else sha, kept if with_text else None))
                yield _parts(list(zip(*out, strict=True)), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], ["doc", "sha", "removed", "spans", "kept", "kept_bytes"])

    told = chunks.join(spans.hint(how), ["bucket", "chunk"], "left")
    return told.mapInArrow(cut_out, "doc long, sha string, removed long, spans long, kept string, kept_bytes binary")
