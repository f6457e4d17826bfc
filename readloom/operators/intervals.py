"""Interval sets against alignments and positions: semi, anti and inner joins on overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the bins by which many intervals meet.
BIN = 8192
#: Widths of bins for rows of any length: BIN * 16 ** 5 is above every position.
CLASSES = 6


def pad_regions(regions: DataFrame, padding: int = 0) -> DataFrame:
    """Regions (contig, start_pos, end_pos, ...) widened on both sides, not below 0; void regions (end not above start) are left out."""
    return regions.where("end_pos > start_pos").withColumn("start_pos", F.greatest(F.col("start_pos") - padding, F.lit(0))).withColumn("end_pos", F.col("end_pos") + padding)


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor((end - 1) / BIN)))


def overlap_join(left: DataFrame, regions: DataFrame, *, start: str = "pos", end: str = "endpos", contig: str = "contig") -> DataFrame:
    """Each left row with each region it overlaps (half-open); region columns r_start, r_end and the others as they are.

    Both sides are cut in bins of BIN positions and meet by an equi-join on (contig, bin), so that Spark may hash, sort or
    broadcast by measured size; a pair is kept in the bin where its overlap begins, hence once.
    """
    r = regions.withColumnRenamed("start_pos", "r_start").withColumnRenamed("end_pos", "r_end").withColumnRenamed("contig", "_rc").withColumn("_rb", _bins(F.col("r_start"), F.col("r_end")))
    l = left.where(F.col(end) > F.col(start)).withColumn("_lb", _bins(F.col(start), F.col(end)))  # noqa: E741
    cond = (F.col(contig) == F.col("_rc")) & (F.col("_lb") == F.col("_rb")) & (F.col(start) < F.col("r_end")) & (F.col(end) > F.col("r_start")) & (F.col("_lb") == F.floor(F.greatest(F.col(start), F.col("r_start")) / BIN))
    return l.join(r, cond).drop("_rc", "_rb", "_lb")


def _reach(left_start: Column, left_end: Column) -> tuple[Column, Column]:
    """(class, bin) of a row: the least class whose bins (BIN, 16 BIN, 256 BIN, ...) are no narrower than the row, and the bin of its start."""
    width = left_end - left_start
    level, size = F.lit(CLASSES - 1), F.lit(BIN * 16 ** (CLASSES - 1))
    for c in range(CLASSES - 2, -1, -1):
        level, size = F.when(width <= BIN * 16**c, c).otherwise(level), F.when(width <= BIN * 16**c, BIN * 16**c).otherwise(size)
    return level, F.floor(left_start / size)


def _entries(regions: DataFrame) -> DataFrame:
    """Regions in every (class, bin) from which a row can reach them: _rc, _rs, _re, _class, _rb."""
    r = regions.select(F.col("contig").alias("_rc"), F.col("start_pos").alias("_rs"), F.col("end_pos").alias("_re")).distinct()
    bins = lambda size: F.sequence(F.floor((F.col("_rs") - size) / size), F.floor((F.col("_re") - 1) / size))
    named = lambda c: lambda b: F.struct(F.lit(c).alias("c"), b.alias("b"))
    each = F.flatten(F.array(*[F.transform(bins(BIN * 16**c), named(c)) for c in range(CLASSES)]))
    return r.withColumn("_x", F.explode(each)).select("_rc", "_rs", "_re", F.col("_x.c").alias("_class"), F.col("_x.b").alias("_rb"))


def overlaps(left: DataFrame, regions: DataFrame, *, start: str = "pos", end: str = "endpos", how: str = "left_semi") -> DataFrame:
    """Left rows that overlap any region ('left_semi') or none ('left_anti'): one row a left row.

    Rows have bins of a width that fits their own (BIN positions, 16 times as many, ...), so a row that overlaps a region
    begins less than a bin before it: it is looked up by the bin of its start alone, and each region is entered, for every
    width, in the bins from which it can be reached. An equi-join on (contig, width, bin) without repeated rows, for long
    rows as for short ones. Rows with a null contig or position overlap nothing.
    """
    level, at = _reach(F.col(start), F.col(end))
    hit = (F.col("contig") == F.col("_rc")) & (level == F.col("_class")) & (at == F.col("_rb")) & (F.col(start) < F.col("_re")) & (F.col(end) > F.col("_rs"))
    return left.join(_entries(regions), hit, how)


def overlap_flag(left: DataFrame, regions: DataFrame, name: str, *, start: str = "pos", end: str = "endpos") -> DataFrame:
    """Left rows with a boolean column ``name``: does the row overlap any region? One existence join, one row a left row."""
    level, at = _reach(F.col(start), F.col(end))
    l = left.withColumns({"_lc": F.col("contig"), "_ls": F.col(start), "_le": F.col(end), "_level": level, "_at": at})  # noqa: E741
    o = lambda c: F.col(c).outer()
    found = _entries(regions).where((o("_lc") == F.col("_rc")) & (o("_level") == F.col("_class")) & (o("_at") == F.col("_rb")) & (o("_ls") < F.col("_re")) & (o("_le") > F.col("_rs"))).exists()
    return l.select(*left.columns, found.alias(name))
