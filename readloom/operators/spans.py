"""Continuous spans and gaps of interval sets (merging of overlapping, nested and touching intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Starts are grouped in bins of 2**BIN_BITS positions; entries of one start are merged before, so a bin holds at most that many rows.
BIN_BITS = 18


def unpack_intervals(df: DataFrame, packed: str, *keep: str) -> DataFrame:
    """One row per entry of an array of ``start * 2**32 + end`` values: ``keep``, ``start_pos``, ``end_pos``.

    Null arrays, empty arrays and null entries give no row.
    """
    e = F.col("_e")
    return (
        df.select(*keep, F.explode(packed).alias("_e"))
        .where(e.isNotNull())
        .select(*keep, F.shiftright(e, 32).alias("start_pos"), e.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("end_pos"))
    )


def spans_and_gaps(df: DataFrame, keys: list[str], start: str | Column = "start_pos", end: str | Column = "end_pos", *, bin_bits: int = BIN_BITS) -> DataFrame:
    """Merge half-open intervals per ``keys`` into continuous spans and list the gaps between them.

    Returns ``keys``, ``kind`` ('span' or 'gap'), ``start_pos``, ``end_pos`` (bigint, half-open).

    Intervals that touch form one span. An interval with a null bound or whose end isn't above its start is void and
    ignored; keys that have only void intervals (and empty inputs) give no row; null keys form a group of their own;
    repeated rows change nothing; other columns are ignored, whatever their names.

    Sort-based islands: an interval opens an island where its start exceeds the running maximum end before it; islands are
    labelled by the cumulative count of such heads, and each is aggregated to its least start and greatest end; the gap before
    it begins at the running maximum that its head exceeded. The sort is cut in bins of the start position, each bounded to ``2**bin_bits`` rows because equal starts are first
    reduced to their greatest end (a partial aggregate on the map side). What one bin must know of the others is one
    row a bin: the greatest end and the number of islands before it. No group is gathered in one task.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    to_col = lambda c: F.col(c) if isinstance(c, str) else c
    base = (
        df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], to_col(start).cast("bigint").alias("_s"), to_col(end).cast("bigint").alias("_x"))
        .where(F.col("_x") > F.col("_s"))
        .groupBy(*k, "_s").agg(F.max("_x").alias("_x"))
        .withColumn("_b", F.shiftright("_s", bin_bits))
    )
    inside = Window.partitionBy(*k, "_b").orderBy("_s")
    local = base.withColumn("_m", F.max("_x").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # bins know their own running maximum; the rest of the way is one row a bin
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*k, "_b").agg(F.max("_x").alias("_bx")).withColumn("_c", F.max("_bx").over(before))
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*k, "_b"]]
    joined = local.alias("l").join(carry.alias("c"), on("l", "c"), "inner").select(*[F.col(f"l.{c}").alias(c) for c in [*k, "_b", "_s", "_x"]], F.greatest("_m", "_c").alias("_p"))
    # islands are labelled by the heads so far: those of earlier bins, and those of this one
    opens = F.col("_p").isNull() | (F.col("_s") > F.col("_p"))
    headed = joined.withColumn("_h", opens.cast("bigint")).withColumn("_l", F.sum("_h").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = headed.groupBy(*k, "_b").agg(F.sum("_h").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    isl = (
        headed.alias("h").join(earlier.alias("e"), on("h", "e"), "inner")
        .select(*[F.col(f"h.{c}").alias(c) for c in k], "_s", "_x", (F.col("_o") + F.col("_l")).alias("_i"), F.when(F.col("_h") == 1, F.col("_p")).alias("_g"))
        .groupBy(*k, "_i").agg(F.min("_s").alias("_s"), F.max("_x").alias("_e"), F.max("_g").alias("_p"))
    )
    both = F.array(
        F.struct(F.lit("span").alias("kind"), F.col("_s").alias("start_pos"), F.col("_e").alias("end_pos")),
        F.struct(F.lit("gap").alias("kind"), F.col("_p").alias("start_pos"), F.col("_s").alias("end_pos")),
    )
    return isl.select(*k, F.explode(both).alias("_r")).where(F.col("_r.start_pos").isNotNull()).select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "_r.kind", "_r.start_pos", "_r.end_pos")
