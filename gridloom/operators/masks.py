"""Masks as words of bits: a row for each 64 locations of which any is present, least location first.

Words are the unit of mask algebra: union, intersection and difference work on 64
locations at once, and no list of locations is made, sorted or made distinct.
With running counts a mask is a distributed index: the storage place of a
location is the count before its word and the bits below its own. Running counts
are taken within spans of SPAN words and over the spans' totals, so the one
sorted table has a row for 4 million locations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16

_WORD = "shiftright(loc, 6)"
_BIT = "shiftleft(1L, cast(loc & 63 as int))"
_BELOW = "~shiftleft(-1L, cast(loc & 63 as int))"


@dataclass(frozen=True, eq=False)
class Mask:
    """words: (word, bits), present locations of 64 * word to 64 * word + 63; words without any may be absent."""

    words: DataFrame
    n_locations: int

    def _like(self, words: DataFrame) -> Mask:
        return Mask(words, self.n_locations)

    def _pairs(self, other: Mask, how: str) -> DataFrame:
        if self.n_locations != other.n_locations:
            raise ValueError("the masks differ in locations")
        return self.words.join(other.words.withColumnRenamed("bits", "other"), "word", how)

    def __or__(self, other: Mask) -> Mask:
        if self.n_locations != other.n_locations:
            raise ValueError("the masks differ in locations")
        return self._like(self.words.unionByName(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits")))

    def __and__(self, other: Mask) -> Mask:
        return self._like(self._pairs(other, "inner").select("word", F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where("bits <> 0"))

    def __sub__(self, other: Mask) -> Mask:
        return self._like(self._pairs(other, "left").select("word", F.expr("bits & ~coalesce(other, 0L)").alias("bits")).where("bits <> 0"))

    def __invert__(self) -> Mask:
        """The absent locations of the grid."""
        n = -(-self.n_locations // 64)
        tail = self.n_locations % 64
        every = self.words.sparkSession.range(n).select(F.col("id").alias("word"), (F.when(F.col("id") == n - 1, F.lit((1 << tail) - 1)).otherwise(F.lit(-1)) if tail else F.lit(-1)).cast("long").alias("bits"))
        return self._like(every) - self

    def count(self) -> int:
        """How many locations are present."""
        return self.words.agg(F.sum(F.bit_count("bits"))).first()[0] or 0

    def locations(self) -> DataFrame:
        """(loc) of the present locations."""
        return self.words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).where("shiftright(bits, at) & 1 = 1").select((F.col("word") * 64 + F.col("at")).alias("loc"))

    def everywhere(self) -> DataFrame:
        """(loc, v) of every location of the grid: whether it is present."""
        every = self.words.sparkSession.range(-(-self.n_locations // 64)).withColumnRenamed("id", "word")
        rows = every.join(self.words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
        return rows.select((F.col("word") * 64 + F.col("at")).alias("loc"), F.expr("shiftright(bits, at) & 1 = 1").alias("v")).where(F.col("loc") < self.n_locations)

    def ranked(self) -> DataFrame:
        """words with ``before``: how many present locations come before the word."""
        counted = self.words.select("word", "bits", F.bit_count("bits").cast("long").alias("held"), F.call_function("div", "word", F.lit(SPAN)).alias("span"))
        totals = counted.groupBy("span").agg(F.sum("held").alias("held"))
        earlier = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = totals.select("span", earlier(Window.orderBy("span")).alias("base"))  # n_locations / 2**22 rows
        return counted.join(bases, "span").select("word", "bits", (F.col("base") + earlier(Window.partitionBy("span").orderBy("word"))).alias("before"))

    def places(self, rows: DataFrame) -> DataFrame:
        """rows (loc, ...) at present locations with ``place``: how many present locations come before, in order of location."""
        below = F.bit_count(F.expr(f"bits & {_BELOW}")).cast("long")
        return rows.withColumn("word", F.expr(_WORD)).join(self.ranked(), "word").where(F.expr(f"(bits & {_BIT}) <> 0")).select(*rows.columns, (F.col("before") + below).alias("place"))

    def located(self, rows: DataFrame) -> DataFrame:
        """rows (place, ...) with ``loc``: the inverse of places."""
        listed = self.ranked().select("word", "bits", "before", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).where("shiftright(bits, at) & 1 = 1")
        below = F.bit_count(F.expr("bits & ~shiftleft(-1L, at)"))
        return rows.join(listed.select((F.col("before") + below).alias("place"), (F.col("word") * 64 + F.col("at")).alias("loc")), "place")

    def encoded(self) -> DataFrame:
        """(word, bytes): eight bytes a word, least location in the least bit of the first byte."""
        big = F.unhex(F.lpad(F.hex("bits"), 16, "0"))
        return self.words.select("word", F.concat(*(F.substring(big, 8 - k, 1) for k in range(8))).alias("bytes"))


def decoded(rows: DataFrame, n_locations: int) -> Mask:
    """The mask of encoded words (word, bytes)."""
    digits = F.concat(*(F.hex(F.substring("bytes", 8 - k, 1)) for k in range(8)))
    return Mask(rows.select("word", F.conv(digits, 16, -10).cast("long").alias("bits")), n_locations)


def of_locations(rows: DataFrame, n_locations: int, present: Column | None = None) -> Mask:
    """The mask of the locations (loc) of some rows; a location may come any number of times."""
    rows = rows if present is None else rows.where(present)
    return Mask(rows.groupBy(F.expr(_WORD).alias("word")).agg(F.bit_or(F.expr(_BIT)).alias("bits")), n_locations)
