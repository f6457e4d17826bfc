"""CIGAR expressions: lengths, unclipped ends, and the expansion of alignments to aligned bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ops(cigar: Column) -> Column:
    return F.zip_with(
        F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda n: n.cast("int")),
        F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1),
        lambda n, o: F.struct(n.alias("n"), o.alias("op")),
    )


def _total(cigar: Column, ops: str) -> Column:
    return F.aggregate(_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin(*ops), x["n"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """Reference positions that the alignment spans."""
    return _total(cigar, "MDN=X")


def aligned_fraction(cigar: Column) -> Column:
    """Aligned letters by all letters of the read."""
    return _total(cigar, "M=X") / _total(cigar, "MIS=X")


def aligned_length(cigar: Column) -> Column:
    """Letters aligned to a reference position."""
    return _total(cigar, "M=X")


def lead_clip(cigar: Column) -> Column:
    """Clipped letters before the alignment."""
    hit = F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1)
    return F.coalesce(F.when(hit != "", hit).cast("int"), F.lit(0))


def tail_clip(cigar: Column) -> Column:
    """Clipped letters behind the alignment."""
    hit = F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1)
    return F.coalesce(F.when(hit != "", hit).cast("int"), F.lit(0))


def unclipped_start(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Where the read would begin without clipping: before the start, or behind the end on the reverse strand."""
    return F.when(reverse, pos + reference_length(cigar) + tail_clip(cigar)).otherwise(pos - lead_clip(cigar))


def aligned_bases(aln: DataFrame, keep: list[str], *, reverse: Column, arrays: list[str] = (), gaps: bool = False) -> DataFrame:
    """One row per aligned base (per deleted position too with ``gaps``): ``keep``, ref_pos, qpos, cycle, base, qual, is_del, arrays' values.

    ``cycle`` is the position in sequencing order (from the end on the reverse strand). ``seq`` and ``qual`` are in
    reference order, tag arrays (``arrays``) in sequencing order. The walk over the CIGAR is a prefix sum over its
    few operations; only the bases that are asked for are then exploded.
    """
    one = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int,d:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        both, ref, query = x["op"].isin("M", "=", "X"), x["op"].isin("D", "N"), x["op"].isin("I", "S")
        item = F.array(F.struct(a["r"].alias("r"), a["q"].alias("q"), x["n"].alias("n"), ref.alias("d")))
        wanted = both | (ref & (x["op"] == "D")) if gaps else both
        return F.struct((a["r"] + F.when(both | ref, x["n"]).otherwise(0)).alias("r"), (a["q"] + F.when(both | query, x["n"]).otherwise(0)).alias("q"), F.when(wanted, F.concat(a["out"], item)).otherwise(a["out"]).alias("out"))

    blocks = F.aggregate(_ops(F.col("cigar")), one, step, lambda a: a["out"])
    n = F.length("seq")
    e = aln.select(*keep, "pos", "seq", "qual", *arrays, reverse.alias("_rev"), n.alias("_n"), F.explode(blocks).alias("_b"))
    e = e.select(*keep, "seq", "qual", *arrays, "_rev", "_n", (F.col("pos") + F.col("_b.r")).alias("_r0"), F.col("_b.q").alias("_q0"), F.col("_b.d").alias("_d"), F.explode(F.sequence(F.lit(0), F.col("_b.n") - 1)).alias("_i"))
    q = F.when(F.col("_d"), F.col("_q0")).otherwise(F.col("_q0") + F.col("_i"))
    e = e.withColumn("qpos", q).withColumn("cycle", F.when(F.col("_rev"), F.col("_n") - 1 - F.col("qpos")).otherwise(F.col("qpos")))
    return e.select(
        *keep,
        (F.col("_r0") + F.col("_i")).alias("ref_pos"), "qpos", "cycle",
        F.when(~F.col("_d"), F.substring("seq", F.col("qpos") + 1, F.lit(1))).alias("base"),
        F.when(~F.col("_d"), F.ascii(F.substring("qual", F.col("qpos") + 1, F.lit(1))) - 33).alias("qual"),
        F.col("_d").alias("is_del"),
        *[F.when(~F.col("_d"), F.get(F.col(a), F.col("cycle"))).alias(f"{a}_at") for a in arrays],
    )
