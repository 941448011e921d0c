"""Queries over other forms of storage: blocks, sheets of co-located images, masks as words of bits."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CUBE_SQL, EVENTS_SQL, cube, events, stored_in_blocks
from .image import Image
from .operators import apply, elementwise, folds, masks, tables
from .operators.reduce import imreduce
from .sources import stream_source
from .sources.codec import StorageDescriptor, write_image
from .sources.shared import mounted, shared_dir
from .sources.sheets import colocate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_IJK = "i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k"
_PLACE = "(i + 50*j + 350*k)::BIGINT"


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _ijk(image: Image) -> DataFrame:
    return image.cells.select(*(a.cast("int").alias(n) for a, n in zip(image.axes(), "ijk", strict=True)), image.value().alias("v"))


#: Queries over dense and packed cubes whose operators have kernels for blocks.
IN_BLOCKS = ("reduce_dense_", "reduce_packed_", "reorient_flip_", "reorient_swap_", "reorient_turn_", "pack_int", "pack_uint", "pack_calibrated", "dense_plus_packed", "number_over_dense", "number_to_the_dense", "number_modulo_packed", "number_less_than_dense", "slice_apply_median")


def in_blocks(queries: dict[str, Query], sql: dict[str, str]) -> None:
    """The same queries and SQL over the blocked form, as blocked_<name>."""

    def stored(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with stored_in_blocks():
                return query(spark, sf_dir)

        return run

    for name in [n for n in queries if n.startswith(IN_BLOCKS) and not n.endswith("_sparse")]:
        _add(f"blocked_{name}", stored(queries[name]), sql[name])


def _where(image: Image, rule: str) -> Image:
    """The cells of a sparse image that a rule on i, j, k keeps."""
    named = image.cells.withColumns(dict(zip("ijk", image.axes(), strict=True)))
    return Image(named.where(rule).select("loc", "elem", "v"), image.dims, image.spatial, "sparse", geometry=image.geometry)


def _sheet(spark: SparkSession, sf_dir: str) -> dict[str, Image]:
    x = cube(spark, sf_dir)
    return colocate({"x": x, "even": _where(x, "(i + j + k) % 2 = 0"), "low": _where(x, "j < 3"), "dense": x.as_dense() + 1}, f"sheet_{uuid.uuid4().hex}", 8)


def _expressions() -> None:
    def fused(s, d):
        x, even, low = cube(s, d), _where(cube(s, d), "(i + j + k) % 2 = 0"), _where(cube(s, d), "j < 3")
        return _ijk((x + even) * (x - low) + abs(low))

    value = "(v + CASE WHEN (i+j+k) % 2 = 0 THEN v ELSE 0 END) * (v - CASE WHEN j < 3 THEN v ELSE 0 END) + CASE WHEN j < 3 THEN abs(v) ELSE 0 END"
    rows = f"WITH {CUBE_SQL}, y AS (SELECT i, j, k, {value} AS v FROM sparse_cube) SELECT {_IJK}, v FROM y WHERE v <> 0"
    _add("fused_three_images", fused, rows)
    _add("fused_densified", lambda s, d: _ijk((cube(s, d) + 1) - cube(s, d) * 2), f"WITH {CUBE_SQL} SELECT {_IJK}, 1 - v AS v FROM cube")

    def chain(s, d):
        at = _sheet(s, d)
        return _ijk((at["x"] + at["even"]) * (at["x"] - at["low"]) + abs(at["low"]))

    _add("sheet_chain", chain, rows)
    _add("sheet_dense_minus_sparse", lambda s, d: (lambda at: _ijk(at["dense"] * 2 - at["even"]))(_sheet(s, d)), f"WITH {CUBE_SQL} SELECT {_IJK}, 2*(v+1) - CASE WHEN (i+j+k) % 2 = 0 THEN v ELSE 0 END AS v FROM cube")
    _add("sheet_reduce", lambda s, d: imreduce(_sheet(s, d)["low"] * 2, [2], "sum").select(F.col("m1").alias("j"), "v"), f"WITH {CUBE_SQL} SELECT j::INTEGER AS j, CASE WHEN j < 3 THEN 2*sum(v) ELSE 0 END AS v FROM cube GROUP BY j")


def _exact_sums() -> None:
    names = {"k": [3], "ij": [1, 2]}
    for kind in ("sparse", "dense"):
        for what, sql in {"sum": "sum(v)", "mean": "round(avg(v), 9)", "var": "round(var_samp(v), 4)"}.items():
            for letters, margin in names.items():

                def query(s, d, kind=kind, what=what, margin=margin, letters=letters):
                    v = F.round("v", {"sum": 0, "mean": 9, "var": 4}[what])
                    return imreduce(cube(s, d, kind), margin, what, exact=True).select(*(F.col(f"m{i + 1}").alias(c) for i, c in enumerate(letters)), v.alias("v"))

                _add(f"exact_{kind}_{what}_by_{letters}", query, f"WITH {CUBE_SQL} SELECT {', '.join(f'{c}::INTEGER AS {c}' for c in letters)}, {sql} AS v FROM cube GROUP BY {', '.join(letters)}")
    thirds = lambda s, d: imreduce(cube(s, d) / 3.0, [3], "sum", exact=True)
    _add("exact_sum_of_thirds", lambda s, d: thirds(s, d).select(F.col("m1").alias("k"), F.round("v", 6).alias("v")), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, round(sum(v/3.0::DOUBLE), 6) AS v FROM cube GROUP BY k")


def _mask_queries() -> None:
    def two(s, d) -> tuple[masks.Mask, masks.Mask]:
        x = cube(s, d)
        return elementwise.bits(_where(x, "j < 3")), elementwise.bits(elementwise.binary(x, ">", 60))

    present = f"WITH {CUBE_SQL}, p AS (SELECT {_PLACE} AS loc, j, v FROM sparse_cube)"
    words = "loc // 64 AS word, sum(1::HUGEINT << (loc % 64)::INTEGER) AS s"
    _add("mask_rank", lambda s, d: elementwise.bits(cube(s, d)).places(cube(s, d).cells.select("loc", "v")), f"{present} SELECT loc, v, row_number() OVER (ORDER BY loc) - 1 AS place FROM p")
    _add("mask_rank_of_series", lambda s, d: elementwise.masked_matrix(events(s, d)).select("loc", "place", F.expr("aggregate(values, 0D, (a, x) -> a + x)").alias("total")), f"WITH {EVENTS_SQL}, n AS (SELECT max(user_id)+1 AS n FROM events), t AS (SELECT (u + n*h)::BIGINT AS loc, sum(v) AS total FROM evgrid, n WHERE EXISTS (SELECT 1 FROM ev WHERE ev.u = evgrid.u AND ev.h = evgrid.h) GROUP BY 1) SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS place, total FROM t")
    _add("mask_located", lambda s, d: elementwise.bits(cube(s, d)).located(s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 7).cast("long").alias("place"))), f"{present}, r AS (SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS place FROM p) SELECT place, loc FROM r WHERE place IN (SELECT n_nationkey * 7 FROM nation)")
    _add("mask_words", lambda s, d: elementwise.bits(cube(s, d)).words, f"{present}, w AS (SELECT {words} FROM p GROUP BY 1) SELECT word, (CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END)::BIGINT AS bits FROM w")
    _add("mask_bytes", lambda s, d: masks.decoded(elementwise.bits(cube(s, d)).encoded(), 4200).encoded().select("word", F.lower(F.hex("bytes")).alias("bytes")), f"{present}, b AS (SELECT loc // 8 AS byte, sum(1 << (loc % 8)::INTEGER) AS s FROM p GROUP BY 1), g AS (SELECT word, unnest(range(8)) AS n FROM (SELECT DISTINCT loc // 64 AS word FROM p)) SELECT word, string_agg(printf('%02x', coalesce(s, 0)::BIGINT), '' ORDER BY n) AS bytes FROM g LEFT JOIN b ON byte = word * 8 + n GROUP BY word")
    _add("masks_difference", lambda s, d: (lambda a, b: (a - b).locations())(*two(s, d)), f"{present} SELECT loc FROM p WHERE j < 3 AND v <= 60")
    _add("mask_complement", lambda s, d: (~two(s, d)[1]).locations(), f"WITH {CUBE_SQL} SELECT {_PLACE} AS loc FROM cube WHERE v <= 60")
    _add("masks_everywhere", lambda s, d: (lambda a, b: (a & b).everywhere())(*two(s, d)), f"WITH {CUBE_SQL} SELECT {_PLACE} AS loc, j < 3 AND v > 60 AS v FROM cube")


def _tables() -> None:
    read = lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet")

    def lines(s, d):
        rows = read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.select("l_orderkey", "l_linenumber", F.col("p_size").alias("i"), F.col("l_linenumber").alias("j"), F.month("l_shipdate").alias("k"))

    _add("extract_at_lines", lambda s, d: tables.extract_at(cube(s, d), lines(s, d), ["i", "j", "k"]), f"WITH {CUBE_SQL} SELECT l_orderkey, l_linenumber, p_size AS i, l_linenumber AS j, month(l_shipdate)::INTEGER AS k, v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sparse_cube c ON c.i = p_size - 1 AND c.j = l_linenumber - 1 AND c.k = month(l_shipdate) - 1")
    boxes = lambda s, d: read(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") - 1).alias("a"), (F.col("n_nationkey") + 2).alias("b"), F.col("n_regionkey").alias("c"), F.lit(9).alias("d"), F.lit(12).alias("e"))
    _add("extract_boxes_of_nations", lambda s, d: tables.extract_boxes(cube(s, d), boxes(s, d), [("a", "b"), ("c", "c"), ("d", "e")], ["i", "j", "k"]).select("n_nationkey", F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"), "v"), f"WITH {CUBE_SQL} SELECT n_nationkey, (i+1)::INTEGER AS i, (k+1)::INTEGER AS k, v FROM nation JOIN cube ON i+1 BETWEEN n_nationkey - 1 AND n_nationkey + 2 AND j+1 = n_regionkey AND k+1 BETWEEN 9 AND 12")
    accounts = lambda s, d: read(s, d, "customer").select((F.col("c_custkey") % 50 + 1).alias("i"), (F.col("c_nationkey") % 7 + 1).alias("j"), (F.col("c_custkey") % 12 + 1).alias("k"), F.rint("c_acctbal").alias("new"), F.col("c_custkey").alias("at"))
    new = "n AS (SELECT c_custkey % 50 AS i, c_nationkey % 7 AS j, c_custkey % 12 AS k, arg_max(round_even(c_acctbal, 0), c_custkey) AS new FROM customer GROUP BY 1, 2, 3)"
    for kind in ("sparse", "dense", "packed"):
        _add(f"assign_at_accounts_{kind}", lambda s, d, kind=kind: _ijk(tables.assign_at(cube(s, d, kind), accounts(s, d), ["i", "j", "k"], "new", "at").as_dense()), f"WITH {CUBE_SQL}, {new} SELECT c.i::INTEGER AS i, c.j::INTEGER AS j, c.k::INTEGER AS k, coalesce(new, v)::DOUBLE AS v FROM cube c LEFT JOIN n USING (i, j, k)")


def _functions() -> None:
    def mixed(x):
        """Of the first slices whether all is there, of others a count, a mean and a text: of different types and lengths."""
        total = int(x.sum())
        return [bool((x > 0).all()), total, total / 4, f"{total} in all"][: 1 + total % 4]

    rows = f"WITH {CUBE_SQL}, t AS (SELECT k, sum(v)::BIGINT AS t, bool_and(v > 0) AS b FROM cube GROUP BY k)"
    _add("imapply_of_any_type", lambda s, d: apply.imapply(cube(s, d), [3], mixed, returns=None).select(F.col("m1").alias("k"), "r", F.expr("schema_of_variant(v)").alias("kind"), F.expr("CASE WHEN schema_of_variant(v) = 'DOUBLE' THEN cast(cast(v AS double) * 4 AS bigint) || '/4' ELSE cast(v AS string) END").alias("v")), f"{rows}, e AS (SELECT k, 0 AS r, 'BOOLEAN' AS kind, b::VARCHAR AS v, t FROM t UNION ALL SELECT k, 1, 'BIGINT', t::VARCHAR, t FROM t UNION ALL SELECT k, 2, 'DOUBLE', t || '/4', t FROM t UNION ALL SELECT k, 3, 'STRING', t || ' in all', t FROM t) SELECT k::INTEGER AS k, r, kind, v FROM e WHERE r <= t % 4")
    _add("imapply_finds_its_type", lambda s, d: apply.imapply(cube(s, d, "dense"), [3], lambda x: int((x > 60).sum()), returns=None).select(F.col("m1").alias("k"), "r", "v"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, 0 AS r, count(*) FILTER (v > 60) AS v FROM cube GROUP BY k")
    for kind in ("sparse", "dense", "packed"):
        _add(f"fold_quantiles_{kind}", lambda s, d, kind=kind: folds.fold_apply(cube(s, d, kind), [3], folds.quantiles(0.25, 0.5)).select(F.col("m1").alias("k"), "r", "v"), f"WITH {CUBE_SQL} SELECT k::INTEGER AS k, 0 AS r, quantile_cont(v, 0.25)::DOUBLE AS v FROM cube GROUP BY 1 UNION ALL SELECT k::INTEGER, 1, quantile_cont(v, 0.5)::DOUBLE FROM cube GROUP BY 1")


def _streams() -> None:
    dims = "50,7,12"

    def options(spark, name: str, **more) -> dict[str, str]:
        folder = f"{mounted(shared_dir(spark))}/stream-{uuid.uuid4().hex}"
        os.makedirs(folder)
        stream_source.register(spark)
        return {"path": f"{folder}/{name}", "axes": "i,j,k", "dims": dims, **more}

    def stream(s, d, only: dict[str, str] | None = None, **more) -> DataFrame:
        frame = _ijk(cube(s, d, "dense")).cache()  # its range is read, then it is written
        try:
            at = stream_source.widened(frame, options(s, "cube", **more))
            frame.write.format(stream_source.NAME).options(**at).mode("append").save()
        finally:
            frame.unpersist()
        return s.read.format(stream_source.NAME).options(**at, **(only or {})).load()

    def packed(s, d) -> DataFrame:
        at = options(s, "cube.gz", type="int32", offset="5")
        write_image(cube(s, d), at["path"], StorageDescriptor("int32", offset=5))
        return s.read.format(stream_source.NAME).options(**at).option("only.k", "11").load()

    def view(s, d) -> DataFrame:
        stream(s, d, type="float32").createOrReplaceTempView("streamed_cube")
        return s.sql("SELECT k, sum(v) AS v FROM streamed_cube WHERE j BETWEEN 2 AND 4 AND i <> 7 GROUP BY k")

    ijk = f"WITH {CUBE_SQL} SELECT i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k"
    _add("source_whole", lambda s, d: stream(s, d, type="int32", endian="big", offset="17"), f"{ijk}, v::BIGINT AS v FROM cube")
    _add("source_scaled", lambda s, d: stream(s, d, type="int16", slope="0.5", intercept="3"), f"{ijk}, v::DOUBLE AS v FROM cube")
    _add("source_box", lambda s, d: stream(s, d, {"only.k": "2,9", "only.j": "2:4", "only.i": "45:"}, type="int64").where("v > 20"), f"{ijk}, v::BIGINT AS v FROM cube WHERE k IN (2, 9) AND j > 1 AND j <= 4 AND i >= 45 AND v > 20")
    _add("source_gzip_volume", lambda s, d: packed(s, d), f"{ijk}, v::BIGINT AS v FROM cube WHERE k = 11")
    _add("source_in_sql", view, f"WITH {CUBE_SQL} SELECT k::BIGINT AS k, sum(v)::DOUBLE AS v FROM cube WHERE j BETWEEN 2 AND 4 AND i <> 7 GROUP BY k")


_expressions()
_streams()
_tables()
_functions()
_exact_sums()
_mask_queries()
