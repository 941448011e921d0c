"""Token-id output as a content-addressed store.

Each document's ids (with an end id) are cut where a rolling hash of the last
ids meets a fixed pattern; a chunk is known by the hash of its ids and stored
once. Files, all Parquet in one folder:

* ``chunks/kind=chunk``: hash, ids (little-endian, 2 or 4 bytes each) - every chunk once;
* ``recipes``: part, doc_id, start, n_tokens, recipe (hash and length of each chunk), leaf - in ascending doc_id order, a file a part;
* ``manifest``: part, first start, documents, root (Merkle root over the part's leaves), and the format: bytes of an id, end id, the vocabulary's hash; a part of -1 holds the root over the roots.

Parts follow the number of documents (``PART_DOCS`` each), so a part's tree fits a task at any size.

Reading checks chunk hashes, leaves, parts and the top root, and fails on any
difference. The checksum of a document comes from its chunks' checksums, which
combine, so the read side never moves ids over the network. A chunk that very
many documents hold is joined in ``WAYS`` places.

Null texts are empty documents: they hold the end id alone. Repeated doc_ids
are documents of their own, one after the other, documents without a doc_id come
first; very long texts are encoded whole; an empty table makes a valid empty
store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet, split
from .common import BASE, BASE_INVERSE, delete, give_back, mix, powers, shared_dir, slices
from .words import WordIds

END_ID = 2
#: Ids in a chunk: least, the mean of what is beyond it, most.
LEAST, MEAN, MOST, REACH = 128, 512, 4096, 16
#: Words whose ids a worker remembers at most.
REMEMBERED = 800_000
HASH_BYTES = 16
#: Documents of a part, about.
PART_DOCS = 250_000
#: Share of recipes that is looked at for chunks in very many documents, the share of uses that makes one hot, the places it is joined in.
LOOKED_AT, HOT, WAYS = 0.01, 1 / 1000, 64


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word.

    Byte-level BPE never joins ids across pre-split words, so a text's ids are
    its words' ids in turn: new words go straight to the library's BPE model.
    Texts with special tokens go to the library whole, as do all texts where the
    file has a normaliser or another way of splitting.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        splitting = self.tool.pre_tokenizer
        plain = self.tool.normalizer is None and type(splitting).__name__ == "ByteLevel" and not splitting.add_prefix_space
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()] if plain else [""]
        self.model, self.stand_ins = self.tool.model, {byte: c for c, byte in byte_alphabet().items()}
        self.wide = self.tool.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.words = WordIds(lambda w: [t.id for t in self.model.tokenize(self._spelled(w))], split, self.kind, REMEMBERED)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = [any(s in t for s in self.special) for t in texts]
        plain = iter(self.words.encode([t for t, x in zip(texts, special, strict=True) if not x]))
        return [np.array(self.tool.encode(t, add_special_tokens=False).ids, self.kind) if x else next(plain) for t, x in zip(texts, special, strict=True)]

    def _spelled(self, word: str) -> str:
        """A word in the stand-ins of its bytes; printable ASCII stands for itself, but for the space."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.stand_ins[0x20])
        return word.encode().decode("latin-1").translate(self.stand_ins)


_tools: dict[str, LibraryEncoder] = {}


def library(path: str) -> LibraryEncoder:
    if path not in _tools:
        _tools[path] = LibraryEncoder(path)
    return _tools[path]


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last REACH ids meets the pattern."""
    n = len(ids)
    if n < REACH:
        return np.zeros(0, np.int64)
    up, down = powers(BASE, n), powers(BASE_INVERSE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * up[:n], out=total[1:])
    rolled = mix((total[REACH:] - total[:-REACH]) * down[: n - REACH + 1])
    return np.flatnonzero(rolled & np.uint64(MEAN - 1) == 0) + REACH


def chunk_ends(marks: list[int], n: int) -> list[int]:
    """The ends of the chunks of a stream of n ids, from its marks; the last end is n."""
    ends, at = [], 0
    for m in [*marks, n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if LEAST <= m - at and m < n:
            at = m
            ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def streams(ids_of: list[np.ndarray], end_id: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Each document's ids with the end id, and its chunk ends; a mark depends on the document's own ids alone."""
    sizes = np.array(list(map(len, ids_of)), np.int64) + 1
    tail = np.array([end_id], ids_of[0].dtype)
    joined = np.concatenate([x for ids in ids_of for x in (ids, tail)])
    marks = rolling_marks(joined)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(marks, begins[:-1] + REACH).tolist()
    last = np.searchsorted(marks, begins[1:]).tolist()
    for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        yield joined[a:b], chunk_ends((marks[first[k] : last[k]] - a).tolist(), b - a)


def chunk_hash(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=HASH_BYTES).digest()


def leaf_hash(doc_id: int | None, start: int, n_tokens: int, recipe: bytes) -> bytes:
    return hashlib.blake2b(f"{doc_id}:{start}:{n_tokens}:".encode() + recipe, digest_size=HASH_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=HASH_BYTES).digest() for i in range(0, len(level), 2)]
    return level[0]


RECIPE = np.dtype([("hash", f"V{HASH_BYTES}"), ("n", "<u4")])


def write_store(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode docs (doc_id, text) and write the store; returns its folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    with open(vocabulary, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    form = (4 if 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) > 1 << 16 else 2, end_id, hashlib.blake2b(raw, digest_size=HASH_BYTES).hexdigest())
    del raw, spec

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = library(vocabulary), set()
        for batch in batches:
            give_back()
            for part in slices(batch):
                rows: list[tuple] = []
                ids_of = tool.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, (ids, ends) in zip(part.column("doc_id").to_pylist(), streams(ids_of, end_id), strict=True):
                    at, recipe = 0, []
                    for end in ends:
                        chunk, at = ids[at:end], end
                        name = chunk_hash(chunk)
                        recipe.append(name + len(chunk).to_bytes(4, "little"))
                        if name not in seen:  # a hint that saves shuffling; the next step is what makes chunks unique
                            if len(seen) < REMEMBERED:
                                seen.add(name)
                            rows.append(("chunk", name, None, None, chunk.tobytes()))
                    body = b"".join(recipe)
                    rows.append(("recipe", hashlib.blake2b(f"{doc_id}".encode() + body, digest_size=HASH_BYTES).digest(), doc_id, len(ids), body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["kind", "hash", "doc_id", "n_tokens", "body"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep, kinds = [], batch.column("kind").to_pylist()
            for kind, name in zip(kinds, batch.column("hash").to_pylist(), strict=True):
                keep.append(kind == "recipe" or name != last)
                last = name if kind == "chunk" else last
            yield batch.filter(pa.array(keep))

    ddl = "kind string, hash binary, doc_id long, n_tokens long, body binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, ddl)
    rows.repartition("hash").sortWithinPartitions("kind", "hash").mapInArrow(unique, ddl).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/chunks")

    made = spark.read.schema(ddl).parquet(f"{path}/chunks").where("kind = 'recipe'")
    n_docs = made.count()  # from the files' footers
    n_parts = max(1, -(-n_docs // PART_DOCS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // 1000))
    ranged = made.select("doc_id", "n_tokens", F.col("body").alias("recipe"), "hash").repartitionByRange(n_parts, "doc_id", "hash")
    ranged.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/ranged")
    ranged = spark.read.parquet(f"{path}/ranged")
    # A row a part: bounded by the number of partitions.
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = dict(zip([t["part"] for t in totals], np.cumsum([0, *(t["n"] for t in totals)]).tolist(), strict=False))
    base = spark.createDataFrame([(int(p), int(s)) for p, s in starts.items()], "part int, base long")
    before = W.partitionBy("part").orderBy("doc_id", "hash").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(base), "part").select("part", "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start"), "n_tokens", "recipe")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "recipe")), strict=True)
            yield batch.append_column("leaf", pa.array([leaf_hash(*x) for x in cells], pa.binary()))

    placed.sortWithinPartitions("part", "start").mapInArrow(leaves, "part int, doc_id long, start long, n_tokens long, recipe binary, leaf binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = part_roots(spark.read.parquet(f"{path}/recipes"))
    roots = parts.orderBy("part").collect()  # a row a part
    top = merkle_root([r["root"] for r in roots])
    rows = [*map(tuple, roots), (-1, 0, sum(r["documents"] for r in roots), bytearray(top))]
    spark.createDataFrame([(*r, *form) for r in rows], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    delete(spark, f"{path}/ranged")
    return path


MANIFEST = "part int, first long, documents long, root binary, id_bytes int, end_id int, vocabulary string"


def part_roots(recipes: DataFrame) -> DataFrame:
    """part, first, documents, root of each part, from the leaves in the files."""

    def fold(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("start").to_numpy(), kind="stable")
        leaves = part.column("leaf").to_pylist()
        return pa.table({"part": part.column("part")[:1].cast(pa.int32()), "first": pa.array([part.column("start")[int(order[0])].as_py()], pa.int64()), "documents": pa.array([part.num_rows], pa.int64()), "root": pa.array([merkle_root([leaves[i] for i in order])], pa.binary())})

    return recipes.select("part", "start", "leaf").groupBy("part").applyInArrow(fold, "part int, first long, documents long, root binary")


def check_manifest(spark: SparkSession, path: str) -> type:
    """The type of the stored ids; fails unless the recipes in the files have the roots that the manifest states."""
    rows = spark.read.parquet(f"{path}/manifest").collect()
    stated = {r["part"]: (r["first"], r["documents"], bytes(r["root"])) for r in rows}
    found = {r["part"]: (r["first"], r["documents"], bytes(r["root"])) for r in part_roots(spark.read.parquet(f"{path}/recipes")).collect()}
    top = merkle_root([found[p][2] for p in sorted(found)])
    if {p: x for p, x in stated.items() if p >= 0} != found or stated[-1][2] != top:
        raise ValueError(f"{path}: the manifest does not fit the recipes")
    return {2: np.uint16, 4: np.uint32}[rows[0]["id_bytes"]]


def _shift_table() -> np.ndarray:
    """row k: what appending 2**k zero bytes does to each bit of a CRC-32."""
    def square(m):
        return apply_matrix(m, m)

    one = np.array([0xEDB88320] + [1 << k for k in range(31)], np.uint32)  # one zero bit
    for _ in range(3):
        one = square(one)
    out = [one]
    for _ in range(47):
        out.append(square(out[-1]))
    return np.array(out)


def apply_matrix(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & np.uint32(1), matrix[k], np.uint32(0))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part a chunk's CRC-32 plays in that of a stream that goes on for n_bytes."""
    table, out = _shift_table(), crc.astype(np.uint32)
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        hit = (n_bytes >> k) & 1 == 1
        out[hit] = apply_matrix(table[k], out[hit])
    return out


def _entries(recipes: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, hash, place, n, after of each chunk of each document; leaves are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                cols = [part.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "recipe", "leaf")]
                for doc_id, start, n, recipe, leaf in zip(*cols, strict=True):
                    if leaf_hash(doc_id, start, n, recipe) != leaf:
                        raise ValueError(f"document {doc_id} at {start}: its leaf does not fit")
                steps = [np.frombuffer(r, RECIPE) for r in cols[3]]
                counts = [len(s) for s in steps]
                flat_steps = np.concatenate(steps)
                row = np.repeat(np.arange(len(counts)), counts)
                n = flat_steps["n"].astype(np.int64)
                done = np.cumsum(n)
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                through = done - (done[first] - n[first])[row]
                total = np.array(cols[2], np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()).take(pa.array(row)), pa.array(np.array(cols[1], np.int64)[row]), pa.array(total), pa.array([h.tobytes() for h in flat_steps["hash"]], pa.binary()), pa.array(through - n), pa.array(n), pa.array(total - through)], ["doc_id", "start", "n_tokens", "hash", "place", "n", "after"])

    return recipes.select("doc_id", "start", "n_tokens", "recipe", "leaf").mapInArrow(run, "doc_id long, start long, n_tokens long, hash binary, place long, n long, after long")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, hash binary, doc_id long, n_tokens long, body binary").parquet(f"{path}/chunks").where("kind = 'chunk'").select("hash", "body")


def _with_chunks(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """The entries of all recipes with what ``held`` (hash, ...) says of their chunks, nulls where a chunk is not there."""
    recipes = spark.read.parquet(f"{path}/recipes")
    # Hot chunks are found in a sample of the uses; at most 1000 can have so large a share of it.
    looked = _entries(recipes.sample(LOOKED_AT, seed=1)).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    seen = looked.orderBy(F.desc("n")).limit(int(1 / HOT)).collect()
    least = max(100, HOT * sum(r["n"] for r in seen))
    hot = [bytes(r["hash"]) for r in seen if r["n"] >= least]
    way, every = F.lit(0), F.array(F.lit(0))
    if hot:
        is_hot = F.col("hash").isin([F.lit(h) for h in hot])
        way = F.when(is_hot, F.pmod(F.xxhash64("start"), F.lit(WAYS)).cast("int")).otherwise(0)
        every = F.when(is_hot, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(every)
    return _entries(recipes).withColumn("way", way).join(held.withColumn("way", F.explode(every)), ["hash", "way"], "left")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    kind = check_manifest(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, crc, count = batch.column("hash"), [], []
            for name, body in zip(names.to_pylist(), batch.column("body").to_pylist(), strict=True):
                ids = np.frombuffer(body, kind).astype("<u4").tobytes()
                if hashlib.blake2b(ids, digest_size=HASH_BYTES).digest() != name:
                    raise ValueError(f"chunk {name.hex()}: its ids do not fit its hash")
                crc.append(zlib.crc32(ids))
                count.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([names, pa.array(crc, pa.int64()), pa.array(count, pa.int64())], ["hash", "crc", "held"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, held, n, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "held", "n", "after"))
            if not np.array_equal(held, n):
                raise ValueError("a recipe states another length than its chunk has")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(shifted(crc, after * 4).astype(np.int64)), pa.array(n)], ["doc_id", "start", "n_tokens", "crc", "n"])

    sums_df = _chunks(spark, path).mapInArrow(sums, "hash binary, crc long, held long")
    parts = _with_chunks(spark, path, sums_df).mapInArrow(shift, "doc_id long, start long, n_tokens long, crc long, n long")
    whole = parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    return whole.select("doc_id", "start", "n_tokens", F.when(F.col("n") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document lacks a chunk"))).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, token_ids of each document, put together from its chunks.

    Fails where a chunk is missing, its ids do not fit its hash, or a document has not as many ids as its recipe says.
    """
    kind = check_manifest(spark, path)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("hash").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if hashlib.blake2b(np.frombuffer(body, kind).astype("<u4").tobytes(), digest_size=HASH_BYTES).digest() != name:
                    raise ValueError(f"chunk {name.hex()}: its ids do not fit its hash")
            yield batch

    def join(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("place").to_numpy(), kind="stable")
        bodies = part.column("body").to_pylist()
        doc_id, start, n = (part.column(c)[0].as_py() for c in ("doc_id", "start", "n_tokens"))
        if any(b is None for b in bodies):
            raise ValueError(f"document {doc_id} at {start} lacks a chunk")
        ids = np.frombuffer(b"".join(bodies[i] for i in order), kind)
        if len(ids) != n:
            raise ValueError(f"document {doc_id} at {start} has {len(ids)} ids and should have {n}")
        return pa.table({"doc_id": part.column("doc_id")[:1], "start": part.column("start")[:1], "token_ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    chunks = _chunks(spark, path).mapInArrow(checked, "hash binary, body binary")
    entries = _with_chunks(spark, path, chunks).select("doc_id", "start", "n_tokens", "place", "body")
    return entries.groupBy("start").applyInArrow(join, "doc_id long, start long, token_ids array<int>")
