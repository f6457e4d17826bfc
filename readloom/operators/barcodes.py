"""Barcode marking of raw reads (inline and secondary index), and quality rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.seq import canonical_barcode, homing_trim, homopolymer_fail, mask_prefix

_cut = lambda s, n: F.substring(s, n + 1, F.length(s))


def _lit(n: Column | int) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def mark_inline(r1: DataFrame, r2: DataFrame | None = None, *, barcode_len: int, homing: str, max_barcode_len: int | None = None, offset: int = 0, hp_threshold: int = 10, check_both: bool = False) -> DataFrame:
    """Reads with inline barcodes to marked reads: read_id, name, mate, barcode, strand, fp, seq, qual.

    ``r1``/``r2``: read_id, name, seq, qual; mates meet on read_id (the shorter file ends the pairing). The barcode of a
    pair is its two halves, the smaller first; where they are swapped the strand is 'R' and the mates change places. fp is
    0 without the homing sequence, with an N, or with a run of more than ``hp_threshold`` letters. ``check_both`` looks for the
    homing sequence in both mates, else in mate 1 only. Null sequences give a null barcode and fp 0.
    """
    half = lambda s: F.substring(s, offset + 1, barcode_len)
    if r2 is None:
        trim, ok = homing_trim(F.col("seq"), homing, barcode_len, max_barcode_len, offset)
        bc = half(F.col("seq"))
        fp = F.coalesce((~homopolymer_fail(bc, hp_threshold) & (ok == 1)).cast("int"), F.lit(0))
        return r1.select("read_id", "name", F.lit(1).alias("mate"), bc.alias("barcode"), F.lit("F").alias("strand"), fp.alias("fp"), _cut(F.col("seq"), trim).alias("seq"), _cut(F.col("qual"), trim).alias("qual"))
    p = r1.select("read_id", "name", F.col("seq").alias("s1"), F.col("qual").alias("q1")).join(r2.select("read_id", F.col("seq").alias("s2"), F.col("qual").alias("q2")), "read_id")
    trim, ok = homing_trim(F.col("s1"), homing, barcode_len, max_barcode_len, offset)
    if check_both:
        ok = ok * homing_trim(F.col("s2"), homing, barcode_len, max_barcode_len, offset)[1]
    bc, strand = canonical_barcode(half(F.col("s1")), half(F.col("s2")))
    p = p.withColumn("_trim", trim).withColumn("_ok", ok).withColumn("barcode", bc).withColumn("strand", strand)
    fp = F.coalesce((~homopolymer_fail(F.col("barcode"), hp_threshold) & (F.col("_ok") == 1)).cast("int"), F.lit(0))
    swap = F.col("strand") == "R"
    mate = lambda m, s, q: F.struct(F.lit(m).alias("mate"), _cut(s, F.col("_trim")).alias("seq"), _cut(q, F.col("_trim")).alias("qual"))
    both = F.array(mate(1, F.when(swap, F.col("s2")).otherwise(F.col("s1")), F.when(swap, F.col("q2")).otherwise(F.col("q1"))), mate(2, F.when(swap, F.col("s1")).otherwise(F.col("s2")), F.when(swap, F.col("q1")).otherwise(F.col("q2"))))
    return p.select("read_id", "name", "barcode", "strand", fp.alias("fp"), F.explode(both).alias("_m")).select("read_id", "name", "_m.mate", "barcode", "strand", "fp", "_m.seq", "_m.qual")


def mark_secondary(r1: DataFrame, index: DataFrame, r2: DataFrame | None = None, *, salt: int = 0, offset: int = 0, hp_threshold: int = 10) -> DataFrame:
    """Reads with a separate index read to marked reads; the barcode is salt letters of each mate around the index read."""
    p = r1.select("read_id", "name", F.col("seq").alias("s1"), F.col("qual").alias("q1")).join(index.select("read_id", F.col("seq").alias("ix")), "read_id")
    part = lambda s: F.substring(s, offset + 1, salt) if salt else F.lit("")
    bc = F.concat(part(F.col("s1")), F.col("ix"))
    mates = [(1, "s1", "q1")]
    if r2 is not None:
        p = p.join(r2.select("read_id", F.col("seq").alias("s2"), F.col("qual").alias("q2")), "read_id")
        bc, mates = F.concat(bc, part(F.col("s2"))), [*mates, (2, "s2", "q2")]
    p = p.withColumn("barcode", bc)
    fp = F.coalesce((~homopolymer_fail(F.col("barcode"), hp_threshold)).cast("int"), F.lit(0))
    n = F.lit(offset + salt)
    m = F.array(*[F.struct(F.lit(i).alias("mate"), _cut(F.col(s), n).alias("seq"), _cut(F.col(q), n).alias("qual")) for i, s, q in mates])
    return p.select("read_id", "name", "barcode", F.lit("Z").alias("strand"), fp.alias("fp"), F.explode(m).alias("_m")).select("read_id", "name", "_m.mate", "barcode", "strand", "fp", "_m.seq", "_m.qual")


def rescale_quality(bases: DataFrame, table: DataFrame) -> DataFrame:
    """Replace ``qual`` of (mate, cycle, base, qual, ...) rows by ``new_qual`` of (mate, cycle, qual, base); N becomes 2.

    Cells that the table lacks keep their quality. New values are clamped to 2..93; the table has one row a cell and
    is small (2 mates x cycles x 94 x 4); Spark broadcasts it by its size.
    """
    if not {"mate", "cycle", "qual", "base", "new_qual"} <= set(table.columns):
        raise ValueError("the rescaler table needs mate, cycle, qual, base, new_qual")
    t = table.select("mate", "cycle", "qual", "base", F.least(F.lit(93), F.greatest(F.lit(2), F.col("new_qual"))).alias("_new"))
    new = F.when(F.col("base") == "N", 2).otherwise(F.coalesce("_new", "qual"))
    return bases.join(t, ["mate", "cycle", "qual", "base"], "left").withColumn("qual", new).drop("_new").select(bases.columns)


def rescale_reads(reads: DataFrame, table: DataFrame, *, mate: str = "mate") -> DataFrame:
    """Reads (mate, seq, qual) with every quality replaced by the table (mate, cycle, qual, base, new_qual); N becomes 2.

    The table becomes one row a mate, an array of its cycles (bounded by the read length times 376 cells), so whole reads meet it by
    mate and are never taken apart. Cells, cycles and mates that the table lacks keep their quality; new values are clamped to 2..93.
    """
    if not {"mate", "cycle", "qual", "base", "new_qual"} <= set(table.columns):
        raise ValueError("the rescaler table needs mate, cycle, qual, base, new_qual")
    t = table.where(F.col("base").isin("A", "C", "G", "T") & F.col("qual").between(0, 93)).groupBy("mate", "cycle", (F.col("qual") * 4 + F.instr(F.lit("ACGT"), F.col("base")) - 1).alias("at")).agg(F.max(F.least(F.lit(93), F.greatest(F.lit(2), F.col("new_qual")))).alias("new"))
    top = t.groupBy("mate").agg(F.max("cycle").alias("top"))
    grid = top.select("mate", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("cycle")).select("mate", "cycle", F.explode(F.sequence(F.lit(0), F.lit(94 * 4 - 1))).alias("at"))
    line = grid.join(t, ["mate", "cycle", "at"], "left").groupBy("mate", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("cells"))
    whole = line.groupBy("mate").agg(F.transform(F.array_sort(F.collect_list(F.struct("cycle", "cells"))), lambda x: x["cells"]).alias("_t")).withColumnRenamed("mate", "_m")
    j = reads.join(whole, F.col(mate) == F.col("_m"), "left")

    def new(i: Column) -> Column:
        q = F.ascii(F.substring("qual", i + 1, F.lit(1))) - 33
        code = F.instr(F.lit("ACGT"), F.upper(F.substring("seq", i + 1, F.lit(1))))
        got = F.coalesce(F.get(F.get(F.col("_t"), i), q * 4 + code - 1), q)
        return F.char(F.when(code == 0, 2).otherwise(got) + 33)

    turned = F.array_join(F.transform(F.sequence(F.lit(0), F.length("qual") - 1), new), "")
    return j.withColumn("qual", F.when(F.length("qual") > 0, turned).otherwise(F.col("qual"))).select(reads.columns)


def single_sided_index(reads: DataFrame, blen: int) -> tuple[DataFrame, DataFrame]:
    """Reads whose first ``blen`` letters (the inline barcode) are masked with N and '#', and these letters as index reads: (reads, index)."""
    seq, qual = mask_prefix(F.col("seq"), F.col("qual"), blen)
    return reads.withColumns({"seq": seq, "qual": qual}), reads.withColumns({"seq": F.substring("seq", 1, blen), "qual": F.substring("qual", 1, blen)})


def barcode_to_index(reads: DataFrame, blen: int) -> tuple[DataFrame, DataFrame]:
    """Strip 2 x blen inline letters into a separate index read: (reads, index)."""
    rest = reads.withColumns({"seq": _cut(F.col("seq"), F.lit(2 * blen)), "qual": _cut(F.col("qual"), F.lit(2 * blen))})
    return rest, reads.withColumns({"seq": F.substring("seq", 1, 2 * blen), "qual": F.substring("qual", 1, 2 * blen)})
