"""Structured Streaming forms: running family statistics and pairing of mates as they arrive (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def family_windows(reads: DataFrame, *, time: str = "loaded_at", window: str = "1 hour", late: str = "30 days", family: list[str] = ("library_id", "barcode", "mate")) -> DataFrame:
    """Families per event-time window from a stream of marked reads: window_start, family, fm, rv, fp_failed.

    A read delivered twice counts once: duplicates by read_id are dropped within the watermark, which also bounds the state.
    Reads later than ``late`` are not counted. Works on a batch DataFrame as well.
    """
    t = F.col(time).cast("timestamp")
    s = reads.withColumn("_t", t).withWatermark("_t", late) if reads.isStreaming else reads.withColumn("_t", t)
    s = s.dropDuplicatesWithinWatermark(["read_id"]) if reads.isStreaming else s.dropDuplicates(["read_id"])
    g = s.groupBy(F.window("_t", window).alias("w"), *family).agg(F.count("*").alias("fm"), F.count(F.when(F.col("strand") == "R", 1)).alias("rv"), F.count(F.when(F.col("fp") == 0, 1)).alias("fp_failed"))
    return g.select(F.col("w.start").alias("window_start"), *family, "fm", "rv", "fp_failed")


def paired_mates(reads: DataFrame, *, time: str = "loaded_at", wait: str = "7 days") -> DataFrame:
    """Mates 1 and 2 of a name as soon as both have arrived: qname, read_id_1, read_id_2.

    A stream-stream join bounded by ``wait`` on both sides: an orphan leaves the state when its partner can't come any more.
    """
    side = lambda m: reads.where(F.col("mate") == m).select(F.col("qname").alias(f"q{m}"), F.col("library_id").alias(f"l{m}"), F.col("read_id").alias(f"read_id_{m}"), F.col(time).cast("timestamp").alias(f"t{m}")).withWatermark(f"t{m}", wait)
    a, b = side(1), side(2)
    on = (F.col("q1") == F.col("q2")) & (F.col("l1") == F.col("l2")) & (F.col("t2") >= F.col("t1") - F.expr(f"interval {wait}")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {wait}"))
    return a.join(b, on).select(F.col("q1").alias("qname"), "read_id_1", "read_id_2")
