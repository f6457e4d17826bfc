"""BED scans: interval sets, plain or gzip, with bad lines kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str, *, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(regions, bad lines) of BED files, gzip ones too by their suffix.

    Regions: contig, start_pos, end_pos, region_name. Comments, blank, 'browser' and 'track' lines are skipped. A line of
    two fields is a 1-based position. ``named``: fields are divided by tabs alone and a missing name is NO_ID; else by
    any white space and a missing name is null.
    """
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$|browser\b|track\b)"))
    f = F.split("value", "\t" if named else r"\s+")
    num = lambda i: F.expr(f"try_cast(get(f, {i}) as bigint)")
    p = raw.withColumn("f", f)
    two = (F.size("f") == 2) & ~F.lit(named)
    p = p.select(
        "value", F.get("f", F.lit(0)).alias("contig"), F.when(two, num(1) - 1).otherwise(num(1)).alias("start_pos"), F.when(two, num(1)).otherwise(num(2)).alias("end_pos"),
        F.coalesce(F.get("f", F.lit(3)), F.lit("NO_ID") if named else F.lit(None)).alias("region_name"),
    )
    good = F.coalesce((F.col("end_pos") > F.col("start_pos")) & (F.col("start_pos") >= 0), F.lit(False))
    return p.where(good).drop("value"), p.where(~good).select("value")
