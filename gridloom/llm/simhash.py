"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that differ
in three bits or fewer, one segment differs in one bit at most; so every
segment is indexed under its 32 variants with one bit deleted, variants are
joined by equality, and candidates are verified on all 64 bits. Equal
fingerprints are one node before anything is indexed, so exact copies add no
work. A bucket never gives all its pairs: it gives a spanning forest of its
verified links, which keeps every component. A bucket over ``LIMIT`` nodes is
dealt out as tiles (pairs of blocks), each a task of its own.

Nulls and texts without words have fingerprint zero, linked like any other. Very
long texts are hashed whole. A null id counts as larger than any other, but as equal to the largest long, and comes out null.
Repeated rows give one result row each; an empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, settle, slices

SHINGLE, SEED, DISTANCE, SEGMENT_BITS = 3, 42, 3, 32
#: Nodes of a bucket that are compared in one piece; larger ones go in tiles.
LIMIT = 4096
#: Stands for a missing id while rows are grouped: larger than any.
NO_ID = (1 << 63) - 1


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero where there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # blocks that fit the cache
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the unsigned fingerprint's bits as a signed long) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fp = np.array([majority(shingle_hashes(t or b"")) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (segment, deleted bit, the other bits) of each fingerprint, row by row."""
    bits = fp.view(np.uint64)
    position = np.arange(SEGMENT_BITS, dtype=np.uint64)
    low = (np.uint64(1) << position) - np.uint64(1)
    keys = []
    for s in range(64 // SEGMENT_BITS):
        part = ((bits >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFFFFFF))[:, None]
        kept = (part & low) | ((part >> np.uint64(1)) & ~low)
        keys.append(kept | ((np.uint64(s * SEGMENT_BITS) + position) << np.uint64(32)))
    return np.concatenate(keys, axis=1).ravel(), np.repeat(fp, 64)


def forest(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links (at most DISTANCE bits) among some nodes.

    Breadth first: a reached node leaves the rest, so each node is compared
    once with what is still unreached; memory is linear.
    """
    rest, near, far = np.arange(len(fp)), [], []
    bits = fp.view(np.uint64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = np.bitwise_count(bits[rest] ^ bits[at]) <= DISTANCE
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                queue += found.tolist()
                near += [node[at]] * len(found)
                far += node[found].tolist()
    return np.array(near, np.int64), np.array(far, np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.nulls(len(low), pa.int64()), pa.nulls(len(low), pa.int64())], ["a", "b", "hot", "fp"])


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a < b) that join all nodes (node, fp) of one component, no more.

    One row per node; fingerprints are distinct.
    """
    spark = nodes.sparkSession

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keys, fp = _variants(part.column("fp").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp), pa.array(np.repeat(part.column("node").to_numpy(zero_copy_only=False), 64))], ["key", "fp", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, fp, node, hot = none, none, none, None

        def settle_runs(last: bool):
            """Everything but the last run, which may go on in the next batch."""
            nonlocal key, fp, node, hot
            if not len(key):
                return
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            whole = len(starts) if last else len(starts) - 1
            sizes = ends - starts
            two = starts[:whole][sizes[:whole] == 2]
            if len(two):  # the most common case, all at once
                near = np.bitwise_count(fp.view(np.uint64)[two] ^ fp.view(np.uint64)[two + 1]) <= DISTANCE
                if near.any():
                    yield _edges(node[two[near]], node[two[near] + 1])
            for k in np.flatnonzero(sizes > 2):
                i, j = starts[k], ends[k]
                if key[i] == hot or sizes[k] > LIMIT:
                    hot = key[i]
                    yield pa.RecordBatch.from_arrays([pa.nulls(j - i, pa.int64()), pa.array(node[i:j]), pa.array(key[i:j]), pa.array(fp[i:j])], ["a", "b", "hot", "fp"])
                elif k < whole:
                    a, b = forest(fp[i:j], node[i:j])
                    if len(a):
                        yield _edges(a, b)
            if hot is not None and whole < len(starts) and key[starts[-1]] == hot:
                key, fp, node = none, none, none  # given out above; more of it may follow
            else:
                at = starts[whole] if whole < len(starts) else len(key)
                key, fp, node = key[at:], fp[at:], node[at:]

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")]
            if hot is not None and len(new[0]) and new[0][0] == hot and len(key) == 0:
                n = int(np.searchsorted(new[0], hot, side="right")) if np.all(new[0][:-1] <= new[0][1:]) else int(np.argmax(np.append(new[0] != hot, True)))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(new[2][:n]), pa.array(new[0][:n]), pa.array(new[1][:n])], ["a", "b", "hot", "fp"])
                new = [x[n:] for x in new]
            key, fp, node = (np.concatenate([x, y]) for x, y in zip((key, fp, node), new, strict=True))
            yield from settle_runs(last=False)
        yield from settle_runs(last=True)

    found = (
        nodes.select("node", "fp")
        .mapInArrow(index, "key long, fp long, node long")
        .repartition(F.col("key"))
        .sortWithinPartitions("key")
        .mapInArrow(compare, "a long, b long, hot long, fp long")
    )
    found = settle(found)
    plain = found.where("hot is null").select("a", "b")
    hot = found.where("hot is not null")
    if hot.isEmpty():
        return plain.distinct()

    # The exact way for large buckets: blocks of about LIMIT / 2 nodes, one task for each pair of blocks.
    # Counts of the hot buckets only: at most one row for each LIMIT index rows.
    blocks = hot.groupBy("hot").agg(F.ceil(F.count(F.lit(1)) / (LIMIT // 2)).cast("int").alias("n_blocks"))
    dealt = hot.join(blocks, "hot").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
    tiles = dealt.select("hot", "fp", F.col("b").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))).alias("tile"))

    def tile(key: tuple, part: pa.Table) -> pa.Table:
        a, b = forest(part.column("fp").to_numpy(), part.column("node").to_numpy())
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    dense = tiles.groupBy("hot", "tile.i", "tile.j").applyInArrow(tile, "a long, b long")
    return plain.unionByName(dense).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge.

    Alternating large-star and small-star steps; each round is written out, so
    lineage stays short and a lost executor repeats one round at most.
    """
    now = settle(edges.select("a", "b").where("a <> b"))
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = settle(small)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    named = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    marks = settle(fingerprints(named, id_col, text_col))
    largest = F.coalesce(F.bool_or(F.col("id") == NO_ID), F.lit(False))
    nodes = settle(marks.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("node"), F.count(F.lit(1)).alias("copies"), largest.alias("largest")))
    roots = components(links(nodes))
    root = F.coalesce("root", "node")
    rooted = nodes.join(roots, "node", "left").select("fp", "copies", F.when((root != NO_ID) | F.col("largest"), root).alias("component_id"))
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_unique(marks, rooted, "fp").select(F.col("id").alias(id_col), hex_digits.alias("fingerprint"), "component_id")
