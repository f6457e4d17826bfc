"""All core queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.flags import REVERSE, any_of
from readloom.functions.seq import base_code, canonical_barcode, homing_trim, homopolymer_fail, revcomp
from readloom.operators import barcodes, collapse, depth, errors, intervals, pileup, reads, rescue
from readloom.plans import problems, views
from readloom.plans.views import alignments, bed, reads_once, reference, variants, with_
from readloom.session import cut, table

QUERIES = {**problems.QUERIES}
SQL = {**problems.SQL}
FAMILY = ["library_id", "barcode", "mate"]


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# ---------------------------------------------------------------- barcodes

_runs = " OR ".join(f"contains(barcode, '{b * 5}')" for b in "ACGTN")


@query("barcode_qc", with_("reads") + f"SELECT read_id, barcode, CASE WHEN contains(barcode, 'N') OR {_runs} THEN 1 ELSE 0 END AS fails FROM reads")
def barcode_qc(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes with an N or five letters alike in a row."""
    return reads_once(spark, d).select("read_id", "barcode", homopolymer_fail(F.col("barcode"), 4).cast("int").alias("fails"))


@query("barcode_canonical_strand", with_("reads", extra="h AS (SELECT read_id, barcode[: length(barcode) // 2] AS a, barcode[length(barcode) // 2 + 1 :] AS b FROM reads)") + "SELECT read_id, least(a, b) || greatest(a, b) AS canonical, CASE WHEN a <= b THEN 'F' ELSE 'R' END AS strand FROM h")
def barcode_canonical_strand(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of a barcode in canonical order."""
    r = reads_once(spark, d)
    h = F.expr("cast(floor(length(barcode) / 2) as int)")
    bc, strand = canonical_barcode(F.substring("barcode", F.lit(1), h), F.substring("barcode", h + 1, F.length("barcode")))
    return r.select("read_id", bc.alias("canonical"), strand.alias("strand"))


_homing = ", ".join(f"CASE WHEN substring(seq, {i + 1}, 3) = 'TGA' THEN {i} END" for i in range(5, 16))


@query("homing_search", with_("reads") + f"SELECT read_id, coalesce({_homing}, 5) + 3 AS trim_len, CASE WHEN coalesce({_homing}) IS NULL THEN 0 ELSE 1 END AS found FROM reads WHERE seq IS NOT NULL")
def homing_search(spark: SparkSession, d: str) -> DataFrame:
    """Where a homing sequence first begins, for barcodes of variable length."""
    trim, ok = homing_trim(F.col("seq"), "tga", 5, 15)
    return reads_once(spark, d).where("seq is not null").select("read_id", trim.alias("trim_len"), ok.alias("found"))


_digit = "(instr('ACGT', substring(barcode, {i}, 1)) - 1)"


@query("barcode_bins", with_("reads") + "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(barcode, '^[ACGT]{4}') THEN " + " + ".join(f"{_digit.format(i=i + 1)} * {4 ** (3 - i)}" for i in range(4)) + " END AS bin FROM reads) GROUP BY bin")
def barcode_bins(spark: SparkSession, d: str) -> DataFrame:
    """Reads by the base-4 number of the barcode's first four letters."""
    return reads_once(spark, d).groupBy(base_code(F.col("barcode"), 4).alias("bin")).agg(F.count("*").alias("n"))


@query("reverse_complement", with_("reads") + "SELECT read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM reads")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements of all reads."""
    return reads_once(spark, d).select("read_id", revcomp(F.col("seq")).alias("rc"))


@query("mark_inline", with_("reads", extra="h AS (SELECT read_id, seq, qual, substring(seq, 1, 8) AS a, substring(qual, 1, 1) AS z FROM reads WHERE seq IS NOT NULL AND qual IS NOT NULL)") + """
SELECT read_id, a AS barcode, 'F' AS strand, CASE WHEN substring(seq, 9, 2) = 'TG' AND NOT contains(a, 'N') AND NOT (contains(a, 'AAAAA') OR contains(a, 'CCCCC') OR contains(a, 'GGGGG') OR contains(a, 'TTTTT')) THEN 1 ELSE 0 END AS fp,
  substring(seq, 11) AS seq, substring(qual, 11) AS qual FROM h""")
def mark_inline(spark: SparkSession, d: str) -> DataFrame:
    """Inline barcodes of eight letters before the homing letters TG, cut off the read."""
    raw = reads_once(spark, d).where("seq is not null and qual is not null").withColumn("name", F.col("read_id").cast("string"))
    return barcodes.mark_inline(raw, barcode_len=8, homing="TG", hp_threshold=4).select("read_id", "barcode", "strand", "fp", "seq", "qual")


# ---------------------------------------------------------------- families


@query("family_size_hist", with_("reads") + "SELECT fm, count(*) AS n_families FROM (SELECT count(*) AS fm FROM reads GROUP BY library_id, barcode, mate) GROUP BY fm")
def family_size_hist(spark: SparkSession, d: str) -> DataFrame:
    """Families by size."""
    return reads_once(spark, d).groupBy(*FAMILY).agg(F.count("*").alias("fm")).groupBy("fm").agg(F.count("*").alias("n_families"))


def _stats_sql(strand: str) -> str:
    return f"""
p AS (SELECT library_id, barcode, mate, {strand} AS strand, unnest(range(1, least(length(seq), length(qual)) + 1)) AS pos, seq, qual FROM reads WHERE length(seq) > 0 AND length(qual) > 0),
b AS (SELECT library_id, barcode, mate, strand, pos, CASE WHEN substring(seq, pos, 1) IN ('A', 'C', 'G', 'T') THEN substring(seq, pos, 1) ELSE 'N' END AS base, ascii(substring(qual, pos, 1)) - 33 AS q FROM p),
s AS (SELECT library_id, barcode, mate, strand, pos, base, count(*) AS n, CAST(sum(q) AS BIGINT) AS ps, max(q) AS mq FROM b GROUP BY ALL)"""


_key = "library_id, barcode, mate"
_pv = lambda n, s: (
    f"(CASE WHEN {s} <= 0 THEN 0 WHEN {s} * 0.230258509299404568 >= {n} AND {n} * ln({s} * 0.230258509299404568) - {s} * 0.230258509299404568 - lgamma({n}) < -708.396418532264106224 THEN 3117 "
    f"ELSE CAST(greatest(0, floor(-10 * log10(list_sum(list_transform(range(0, {n}), lambda k: exp(k * ln({s} * 0.230258509299404568) - lgamma(k + 1) - {s} * 0.230258509299404568)))) + 0.5)) AS INT) END)"
)
_meta = """m AS (SELECT library_id, barcode, mate, CAST(count(*) AS INT) AS fm, CAST(count(*) FILTER (strand = 'R') AS INT) AS rv, arg_min(row(fp), read_id) AS fpr FROM reads GROUP BY ALL)"""
_family_out = """
SELECT library_id, barcode, mate, fm, rv, CASE WHEN rv > 0 AND rv < fm THEN 1 ELSE 0 END AS dr, round(coalesce(miss, 0) / fm, 6) AS nf, seq, qual, fa, pv
FROM m LEFT JOIN (SELECT library_id, barcode, mate, string_agg(base, '' ORDER BY pos) AS seq, string_agg(chr(CAST(33 + qual AS INT)), '' ORDER BY pos) AS qual, string_agg(fa, ',' ORDER BY pos) AS fa, string_agg(pv, ',' ORDER BY pos) AS pv, sum(depth - fa - CASE WHEN won <> 'N' THEN nn ELSE 0 END) AS miss FROM c GROUP BY ALL) USING (library_id, barcode, mate)"""


def _family_columns(f: DataFrame) -> DataFrame:
    return f.select(*FAMILY, "fm", "rv", "dr", F.round("nf", 6).alias("nf"), "seq", "qual", F.array_join("fa", ",").alias("fa"), F.array_join("pv", ",").alias("pv"))


@query("family_consensus", with_("reads", extra=_stats_sql("'F'") + f""",
w AS (SELECT {_key}, pos, CAST(sum(n) AS INT) AS depth, CAST(coalesce(sum(n) FILTER (base = 'N'), 0) AS INT) AS nn, arg_max(row(base, n, ps, mq), row(ps, instr('ACGTN', base))) AS w FROM s GROUP BY {_key}, pos),
v AS (SELECT *, CASE WHEN w[3] > 0 THEN w[1] ELSE 'N' END AS won, {_pv('depth', 'w[3]')} AS pv0, w[2] AS fa, w[4] AS mq FROM w),
c AS (SELECT *, CASE WHEN pv0 > 2 AND fa / depth > 0.5 THEN won ELSE 'N' END AS base, CASE WHEN pv0 > 2 AND fa / depth > 0.5 THEN pv0 ELSE 2 END AS pv, CASE WHEN pv0 > 2 AND fa / depth > 0.5 OR won = 'N' THEN mq ELSE 2 END AS qual FROM v), """ + _meta) + _family_out)
def family_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of every family, strands taken together."""
    return _family_columns(collapse.collapse_families(reads_once(spark, d), FAMILY, "read_id", stranded=False))


@query("family_consensus_duplex", with_("reads", extra=_stats_sql("CASE WHEN strand = 'R' THEN 'R' ELSE 'F' END") + f""",
t AS (SELECT {_key}, pos, strand = 'R' AS rev, CAST(sum(n) AS INT) AS depth, CAST(coalesce(sum(n) FILTER (base = 'N'), 0) AS INT) AS nn, arg_max(row(base, n, ps, mq), row(ps, instr('ACGTN', base))) AS w FROM (SELECT {_key}, pos, CASE WHEN strand = 'R' THEN 'R' ELSE strand END AS strand, base, n, ps, mq FROM s) GROUP BY {_key}, pos, strand),
u AS (SELECT {_key}, pos, max(w) FILTER (NOT rev) AS f, max(w) FILTER (rev) AS r, max(depth) FILTER (NOT rev) AS fd, max(depth) FILTER (rev) AS rd, CAST(sum(depth) AS INT) AS depth, CAST(sum(nn) AS INT) AS nn FROM t GROUP BY {_key}, pos),
x AS (SELECT *, CASE WHEN f IS NULL THEN NULL WHEN f[3] > 0 THEN f[1] ELSE 'N' END AS fb, CASE WHEN r IS NULL THEN NULL WHEN r[3] > 0 THEN r[1] ELSE 'N' END AS rb, coalesce(fd, rd) AS basis FROM u),
y AS (SELECT *, CASE WHEN fb = rb THEN 'same' WHEN rb IS NULL OR rb = 'N' THEN 'f' WHEN fb IS NULL OR fb = 'N' THEN 'r' ELSE 'clash' END AS how FROM x),
v AS (SELECT *, CASE how WHEN 'same' THEN fb WHEN 'f' THEN fb WHEN 'r' THEN rb ELSE 'N' END AS won, CASE how WHEN 'same' THEN f[3] + r[3] WHEN 'f' THEN f[3] WHEN 'r' THEN r[3] ELSE 0 END AS ps,
  CAST(CASE how WHEN 'same' THEN f[2] + r[2] WHEN 'f' THEN f[2] WHEN 'r' THEN r[2] ELSE 0 END AS INT) AS fa, CASE how WHEN 'same' THEN greatest(f[4], r[4]) WHEN 'f' THEN f[4] WHEN 'r' THEN r[4] ELSE 2 END AS mq FROM y),
z AS (SELECT *, CASE WHEN how = 'clash' THEN 0 ELSE {_pv('basis', 'ps')} END AS pv0 FROM v),
c AS (SELECT {_key}, pos, depth, nn, won, fa, CASE WHEN how <> 'clash' AND pv0 > 2 AND fa / basis > 0.5 THEN won ELSE 'N' END AS base, CASE WHEN how = 'clash' THEN 0 WHEN pv0 > 2 AND fa / basis > 0.5 THEN pv0 ELSE 2 END AS pv,
  CASE WHEN pv0 > 2 AND fa / basis > 0.5 OR won = 'N' THEN mq ELSE 2 END AS qual FROM z), """ + _meta) + _family_out)
def family_consensus_duplex(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of every family from the consensus of its two strands."""
    r = reads_once(spark, d).withColumn("strand", F.when(F.col("strand") == "R", "R").otherwise("F"))
    return _family_columns(collapse.collapse_families(r, FAMILY, "read_id", stranded=True))


@query("family_first_fp", with_("reads") + "SELECT library_id, barcode, mate, fpr[1] AS fp, fm FROM (SELECT library_id, barcode, mate, CAST(count(*) AS INT) AS fm, arg_min(row(fp), read_id) AS fpr FROM reads GROUP BY ALL)")
def family_first_fp(spark: SparkSession, d: str) -> DataFrame:
    """QC flag of the first read of each family."""
    return reads_once(spark, d).groupBy(*FAMILY).agg(F.min_by("fp", "read_id").alias("fp"), F.count("*").cast("int").alias("fm"))


@query("duplex_fraction", with_("reads", extra="m AS (SELECT count(*) AS fm, count(*) FILTER (strand = 'R') AS rv FROM reads GROUP BY library_id, barcode, mate)") + """
SELECT count(*) FILTER (rv > 0 AND rv < fm) AS n_duplex, count(*) AS n_families, CAST(coalesce(sum(fm) FILTER (rv > 0 AND rv < fm), 0) AS BIGINT) AS duplex_reads, CAST(sum(fm) AS BIGINT) AS n_reads FROM m""")
def duplex_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Families with reads of both strands."""
    m = reads_once(spark, d).groupBy(*FAMILY).agg(F.count("*").alias("fm"), F.count(F.when(F.col("strand") == "R", 1)).alias("rv"))
    dup = (F.col("rv") > 0) & (F.col("rv") < F.col("fm"))
    return m.agg(F.count(F.when(dup, 1)).alias("n_duplex"), F.count("*").alias("n_families"), F.coalesce(F.sum(F.when(dup, F.col("fm"))), F.lit(0)).alias("duplex_reads"), F.sum("fm").alias("n_reads"))


@query("accumulator_consensus", f"""
WITH k AS (SELECT DISTINCT kf_id, fm, readlen, nuc_counts, phred_sums, max_phreds FROM kingfisher WHERE len(nuc_counts) = 5 * readlen AND len(phred_sums) = 5 * readlen AND length(max_phreds) = 5 * readlen AND readlen > 0),
e AS (SELECT *, unnest(range(0, readlen)) AS pos FROM k),
w AS (SELECT *, list_max([row(phred_sums[pos * 5 + i + 1], i) for i in [0, 1, 2, 3, 4] if phred_sums[pos * 5 + i + 1] IS NOT NULL]) AS w FROM e),
x AS (SELECT *, CASE WHEN w[1] > 0 THEN w[2] ELSE 4 END AS k, w[1] AS ps FROM w)
SELECT kf_id, string_agg(substring('ACGTN', k + 1, 1), '' ORDER BY pos) AS seq, CAST(sum(nuc_counts[pos * 5 + k + 1]) AS BIGINT) AS agree_sum, CAST(sum(ps) AS BIGINT) AS phred_total, CAST(sum({_pv('fm', 'ps')}) AS BIGINT) AS pv_sum, CAST(sum(ascii(substring(max_phreds, pos * 5 + k + 1, 1)) - 33) AS BIGINT) AS qual_sum
FROM x GROUP BY kf_id""")
def accumulator_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of stored accumulators."""
    k = table(spark, d, "kingfisher").dropDuplicates(["kf_id"])
    p = collapse.accumulator_consensus(k, ["kf_id"])
    cells = F.array_sort(F.collect_list(F.struct("pos", "base")))
    return p.groupBy("kf_id").agg(F.array_join(F.transform(cells, lambda x: x["base"]), "").alias("seq"), F.sum("agree").cast("bigint").alias("agree_sum"), F.sum("phred_sum").cast("bigint").alias("phred_total"), F.sum("pv").cast("bigint").alias("pv_sum"), F.sum("qual").cast("bigint").alias("qual_sum"))


# ---------------------------------------------------------------- alignments: filters, targets, statistics

_pass = "fm >= 2 AND mapq >= 12 AND (flag & 1280) = 0 AND (flag & 1) = 1"
_filter = dict(min_fm=2, min_mapq=12, skip_flags=1280, require_flags=1)


def _ov(pad: int = 0, start: str = "a.pos", end: str = "a.endpos") -> str:
    return f"EXISTS (SELECT 1 FROM bed b WHERE b.contig = a.contig AND {start} < b.end_pos + {pad} AND {end} > greatest(b.start_pos - {pad}, 0))"


def _aln(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d, bases=False).withColumn("mf", F.lit(None).cast("double"))


@query("filter_pass", with_("aln") + f"SELECT read_id, fm, mapq, flag FROM aln WHERE {_pass}")
def filter_pass(spark: SparkSession, d: str) -> DataFrame:
    """Filter by family size, mapping quality and flags."""
    return reads.filter_reads(_aln(spark, d), **_filter).select("read_id", "fm", "mapq", "flag")


@query("filter_inverted", with_("aln", "bed") + f"SELECT read_id FROM aln a WHERE NOT ({_pass} AND {_ov()})")
def filter_inverted(spark: SparkSession, d: str) -> DataFrame:
    """All that a filter with regions refuses."""
    return reads.filter_reads(_aln(spark, d), **_filter, regions=bed(spark, d), invert=True).select("read_id")


@query("filter_aligned_fraction", with_("aln") + "SELECT read_id FROM aln WHERE CASE WHEN shape = 2 THEN (len - 2) / len ELSE 1.0 END >= 0.9")
def filter_aligned_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Reads aligned over nine tenths of their letters."""
    return reads.filter_reads(_aln(spark, d), min_aligned_fraction=0.9, single_end=True).select("read_id")


@query("filter_split_counts", with_("aln", "bed") + f"SELECT CASE WHEN {_pass} AND {_ov(5)} THEN 1 ELSE 0 END AS passed, count(*) AS n FROM aln a GROUP BY 1")
def filter_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the two parts of a split."""
    a, b = reads.split_reads(_aln(spark, d), **_filter, regions=bed(spark, d), padding=5)
    return a.select(F.lit(1).alias("passed")).unionByName(b.select(F.lit(0).alias("passed"))).groupBy("passed").agg(F.count("*").alias("n"))


@query("bed_semi", with_("aln", "bed") + f"SELECT read_id, contig, pos, endpos FROM aln a WHERE {_ov()}")
def bed_semi(spark: SparkSession, d: str) -> DataFrame:
    """Alignments that overlap a region."""
    return intervals.overlaps(_aln(spark, d), bed(spark, d)).select("read_id", "contig", "pos", "endpos")


@query("bed_anti", with_("aln", "bed") + f"SELECT read_id, contig, pos, endpos FROM aln a WHERE NOT {_ov()}")
def bed_anti(spark: SparkSession, d: str) -> DataFrame:
    """Alignments that overlap no region."""
    return intervals.overlaps(_aln(spark, d), bed(spark, d), how="left_anti").select("read_id", "contig", "pos", "endpos")


@query("bed_pad", with_("aln", "bed") + f"SELECT read_id FROM aln a WHERE {_ov(25)}")
def bed_pad(spark: SparkSession, d: str) -> DataFrame:
    """Alignments that overlap a widened region."""
    return intervals.overlaps(_aln(spark, d), intervals.pad_regions(bed(spark, d), 25)).select("read_id")


@query("bed_join", with_("aln", "bed") + "SELECT region_id, read_id, least(endpos, end_pos) - greatest(pos, start_pos) AS shared FROM aln a JOIN bed b ON a.contig = b.contig AND a.pos < b.end_pos AND a.endpos > b.start_pos")
def bed_join(spark: SparkSession, d: str) -> DataFrame:
    """Each alignment with each region it overlaps."""
    j = intervals.overlap_join(_aln(spark, d), bed(spark, d).select("region_id", "contig", "start_pos", "end_pos"))
    return j.select("region_id", "read_id", (F.least("endpos", "r_end") - F.greatest("pos", "r_start")).alias("shared"))


@query("target_rate", with_("aln", "bed", extra=f"u AS (SELECT *, (flag & 3844) <> 0 OR mapq < 6 AS skip, CASE WHEN {_ov(10)} THEN 1 ELSE 0 END AS hit FROM aln a)") + """
SELECT count(*) FILTER (NOT skip) AS n_reads, CAST(sum(hit) FILTER (NOT skip) AS BIGINT) AS n_target, CAST(sum(fm) FILTER (NOT skip) AS BIGINT) AS raw_reads, CAST(sum(fm * hit) FILTER (NOT skip) AS BIGINT) AS raw_target,
  count(*) FILTER (NOT skip AND fm > 1) AS n_real, CAST(sum(hit) FILTER (NOT skip AND fm > 1) AS BIGINT) AS real_target, count(*) FILTER (skip) AS n_skipped FROM u""")
def target_rate(spark: SparkSession, d: str) -> DataFrame:
    """On-target counts of reads, raw reads and real families."""
    t = reads.target_rate(_aln(spark, d), bed(spark, d), padding=10, min_mapq=6)
    return t.select("n_reads", "n_target", "raw_reads", "raw_target", "n_real", "real_target", "n_skipped")


_reason = "CASE WHEN (flag & 2304) <> 0 THEN 'flag' WHEN mapq < 6 THEN 'mapq' WHEN fm < 2 THEN 'fm' ELSE 'pass' END"
_fam = with_("aln", extra=f"r AS (SELECT *, {_reason} AS why FROM aln WHERE (flag & 128) = 0)")


@query("famstats_fm", _fam + """
SELECT count(*) FILTER (why = 'pass') AS n_pass, count(*) FILTER (why = 'flag') AS n_flag_fail, count(*) FILTER (why = 'mapq') AS n_mapq_fail, count(*) FILTER (why = 'fm') AS n_fm_fail, count(*) FILTER (why = 'pass' AND fp = 0) AS n_fp_fail,
  CAST(sum(fm) FILTER (why = 'pass') AS BIGINT) AS fm_sum, CAST(sum(rv) FILTER (why = 'pass') AS BIGINT) AS rv_sum, count(*) FILTER (why = 'pass' AND dr = 1) AS n_duplex,
  round(avg(fm) FILTER (why = 'pass'), 6) AS mean_fm, round(avg(rv / fm) FILTER (why = 'pass' AND dr = 1), 6) AS mean_duplex_rv, round(sum(rv) FILTER (why = 'pass' AND dr = 1) / sum(fm) FILTER (why = 'pass' AND dr = 1), 6) AS pooled_duplex_rv FROM r""")
def famstats_fm(spark: SparkSession, d: str) -> DataFrame:
    """Family statistics."""
    s = reads.famstats(_aln(spark, d), min_mapq=6, min_fm=2)
    return s.select("n_pass", "n_flag_fail", "n_mapq_fail", "n_fm_fail", "n_fp_fail", "fm_sum", "rv_sum", "n_duplex", *_r6("mean_fm", "mean_duplex_rv", "pooled_duplex_rv"))


@query("famstats_hist", _fam + "SELECT 'fm' AS kind, fm AS value, count(*) AS n_families FROM r WHERE why = 'pass' GROUP BY fm UNION ALL SELECT 'rv', rv, count(*) FROM r WHERE why = 'pass' GROUP BY rv UNION ALL SELECT 'np', np, count(*) FROM r WHERE why = 'pass' AND np > 0 GROUP BY np")
def famstats_hist(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of family size, reversed reads and reads before rescue."""
    return reads.family_histograms(_aln(spark, d), min_mapq=6, min_fm=2)


@query("famstats_frac", with_("aln") + "SELECT CAST(sum(CASE WHEN fm >= 3 THEN fm ELSE 0 END) AS BIGINT) AS fm_above, CAST(sum(fm) AS BIGINT) AS fm_total, round(sum(CASE WHEN fm >= 3 THEN fm ELSE 0 END) / sum(fm), 6) AS fraction FROM aln WHERE (flag & 2432) = 0 AND fp <> 0")
def famstats_frac(spark: SparkSession, d: str) -> DataFrame:
    """Share of raw reads in families of three or more."""
    return reads.family_fraction(_aln(spark, d), 3).select("fm_above", "fm_total", *_r6("fraction"))


@query("famstats_sum", with_("aln") + "SELECT contig, CAST(sum(fm) AS BIGINT) AS fm_sum, CAST(sum(rv) AS BIGINT) AS rv_sum FROM aln WHERE (flag & 2432) = 0 GROUP BY contig")
def famstats_sum(spark: SparkSession, d: str) -> DataFrame:
    """Raw and reversed reads by contig."""
    return reads.family_sum(_aln(spark, d), ["contig"])


@query("primary_count", with_("aln") + "SELECT count(*) AS n_primary FROM aln WHERE (flag & 2304) = 0")
def primary_count(spark: SparkSession, d: str) -> DataFrame:
    """Primary records."""
    return reads.primary_count(_aln(spark, d))


@query("orphan_names", with_("aln") + "SELECT qname, count(*) AS n FROM aln GROUP BY qname HAVING count(*) <> 2")
def orphan_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without exactly two records."""
    return rescue.orphans(_aln(spark, d))


_ucs = "CASE WHEN is_rev THEN endpos ELSE pos - CASE WHEN shape = 2 THEN 2 ELSE 0 END END"


@query("mark_pairs", with_("aln", extra=f"m AS (SELECT *, {_ucs} AS su, (flag & 128) <> 0 AS second FROM aln)") + """
SELECT a.read_id, a.su, b.su AS mu, b.len AS lm, CASE WHEN a.fp = 0 OR coalesce(b.fp, 1) = 0 THEN a.flag | 512 ELSE a.flag END AS flag
FROM m a LEFT JOIN m b ON a.qname = b.qname AND a.second <> b.second AND (b.flag & 2304) = 0 WHERE abs(a.isize) >= 30""")
def mark_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mate tags and QC bits of pairs with a large enough insert."""
    a = alignments(spark, d).withColumn("sa", F.lit(None).cast("string"))
    return reads.mark_pairs(a, min_insert=30).select("read_id", "su", "mu", "lm", "flag")


def _capped(other: str) -> str:
    return with_("bases") + f"SELECT read_id, CAST(sum(CASE WHEN pv >= 40 AND fa / fm >= 0.7 THEN 90 ELSE {other} END) AS BIGINT) AS qual_sum, count(*) AS n FROM (SELECT *, 2 + (read_id * 13 + i * 5) % 40 AS q0 FROM (SELECT *, CAST(2 + (read_id * 13 + i * 5) % 40 + 10 * fm AS INT) AS pv, CAST(greatest(1, fm - (read_id + i) % 2) AS INT) AS fa FROM (SELECT *, unnest(range(0, len)) AS i FROM aln))) WHERE fm >= 2 GROUP BY read_id"


def _cap(spark: SparkSession, d: str, keep: bool) -> DataFrame:
    c = reads.cap_qualities(alignments(spark, d), min_pv=40, min_fraction=0.7, min_fm=2, cap=90, keep_failing=keep)
    total = F.aggregate(F.split("qual", ""), F.lit(0).cast("bigint"), lambda s, x: s + F.ascii(x) - 33)
    return c.select("read_id", total.alias("q"), F.length("qual").cast("bigint").alias("l")).groupBy("read_id").agg(F.sum("q").alias("qual_sum"), F.sum("l").alias("n"))


@query("cap_quality", _capped("2"))
def cap_quality(spark: SparkSession, d: str) -> DataFrame:
    """Qualities capped where the family agrees, masked elsewhere."""
    return _cap(spark, d, False)


@query("cap_keep", _capped("q0"))
def cap_keep(spark: SparkSession, d: str) -> DataFrame:
    """Qualities capped where the family agrees, left elsewhere."""
    return _cap(spark, d, True)


# ---------------------------------------------------------------- depth

_gate = "(flag & 1796) = 0 AND mapq >= 6"
_depth = with_("aln", "bed", extra=f"""
z AS (SELECT region_id, contig, unnest(range(start_pos, end_pos)) AS p FROM bed),
e AS (SELECT contig, fm, unnest(range(pos, endpos)) AS p FROM aln WHERE {_gate}),
pd AS (SELECT contig, p, count(*) AS collapsed, sum(fm) AS raw, count(*) FILTER (fm = 1) AS singleton FROM e GROUP BY ALL),
f AS (SELECT region_id, p, CAST(coalesce(collapsed, 0) AS BIGINT) AS collapsed, CAST(coalesce(raw, 0) AS BIGINT) AS raw, CAST(coalesce(singleton, 0) AS BIGINT) AS singleton FROM z LEFT JOIN pd USING (contig, p))""")


@query("depth_region", _depth + "SELECT region_id, count(*) AS region_len, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_stdev, round(stddev_samp({c}) / nullif(avg({c}), 0), 6) AS {c}_cv" for c in ("collapsed", "raw", "singleton")) + ", round(100.0 * sum(singleton) / nullif(sum(collapsed), 0), 6) AS pct_singleton FROM f GROUP BY region_id")
def depth_region(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the regions."""
    r = depth.region_depth(_aln(spark, d), bed(spark, d), min_mapq=6)
    return r.select("region_id", "region_len", *[F.round(c, 6).alias(c) if not c.endswith("_total") else F.col(c) for c in r.columns[2:]])


@query("depth_quantiles", _depth + """, l AS (SELECT region_id, 'collapsed' AS kind, collapsed AS depth FROM f UNION ALL SELECT region_id, 'raw', raw FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY region_id, kind ORDER BY depth) - 1 AS k, count(*) OVER (PARTITION BY region_id, kind) AS n FROM l)
SELECT region_id, kind, CAST(i AS INT) AS i, depth FROM o, unnest([1, 2, 3]) AS t(i) WHERE k = least(n * i // 4 + 1, n - 1)""")
def depth_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the coverage of each region."""
    return depth.depth_quantiles(_aln(spark, d), bed(spark, d), min_mapq=6)


@query("depth_hist_cumulative", _depth + ", h AS (SELECT collapsed AS depth, count(*) AS n FROM f WHERE collapsed > 0 GROUP BY 1) SELECT depth, CAST(sum(n) OVER (ORDER BY depth DESC) AS BIGINT) AS n_bases, round(100.0 * sum(n) OVER (ORDER BY depth DESC) / sum(n) OVER (), 6) AS pct_bases FROM h")
def depth_hist_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Bases covered to at least each depth."""
    return depth.depth_histogram(_aln(spark, d), bed(spark, d), min_mapq=6).select("depth", "n_bases", *_r6("pct_bases"))


_sdepth = with_("aln", "bed", extra=f"""
z AS (SELECT region_id, contig, unnest(range(start_pos, end_pos)) AS p, s FROM bed, (SELECT DISTINCT 'lib' || (fp + 0) AS s FROM aln)),
e AS (SELECT contig, fm, 'lib' || fp AS s, unnest(range(pos, endpos)) AS p FROM aln WHERE {_gate}),
pd AS (SELECT contig, p, s, count(*) AS collapsed, sum(fm) AS raw, count(*) FILTER (fm = 1) AS singleton FROM e GROUP BY ALL),
f AS (SELECT region_id, s AS sample, p, CAST(coalesce(collapsed, 0) AS BIGINT) AS collapsed, CAST(coalesce(raw, 0) AS BIGINT) AS raw, CAST(coalesce(singleton, 0) AS BIGINT) AS singleton FROM z LEFT JOIN pd USING (contig, p, s))""")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return _aln(spark, d).withColumn("sample", F.concat(F.lit("lib"), F.col("fp").cast("string")))


@query("depth_region_samples", _sdepth + "SELECT region_id, sample, count(*) AS region_len, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_stdev" for c in ("collapsed", "raw", "singleton")) + " FROM f GROUP BY region_id, sample")
def depth_region_samples(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the regions by sample."""
    r = depth.region_depth(_sampled(spark, d), bed(spark, d), min_mapq=6, sample="sample")
    return r.select("region_id", "sample", "region_len", *[x for c in ("collapsed", "raw", "singleton") for x in (F.col(f"{c}_total"), *_r6(f"{c}_mean", f"{c}_stdev"))])


@query("depth_hist_samples", _sdepth + """, h AS (SELECT sample, collapsed AS depth, count(*) AS n FROM f WHERE collapsed > 0 GROUP BY 1, 2),
k AS (SELECT d.depth, m.sample, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT depth FROM h) d CROSS JOIN (SELECT DISTINCT sample FROM f) m LEFT JOIN h ON h.depth = d.depth AND h.sample = m.sample)
SELECT sample, depth, CAST(sum(n) OVER (PARTITION BY sample ORDER BY depth DESC) AS BIGINT) AS n_bases, round(100.0 * sum(n) OVER (PARTITION BY sample ORDER BY depth DESC) / sum(n) OVER (PARTITION BY sample), 6) AS pct_bases FROM k""")
def depth_hist_samples(spark: SparkSession, d: str) -> DataFrame:
    """Bases covered to at least each depth, for the depths of all samples."""
    return depth.depth_histogram(_sampled(spark, d), bed(spark, d), min_mapq=6, sample="sample").select("sample", "depth", "n_bases", *_r6("pct_bases"))


@query("depth_named_regions", _depth + ", r AS (SELECT region_id, avg(collapsed) AS c, avg(raw) AS w, avg(singleton) AS s FROM f GROUP BY region_id) SELECT count(*) AS n_regions, round(avg(c), 6) AS mean_collapsed, round(avg(w), 6) AS mean_raw, round(avg(s), 6) AS mean_singleton FROM r JOIN nation ON n_nationkey = region_id WHERE n_name LIKE 'I%'")
def depth_named_regions(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage of the regions of one name."""
    r = bed(spark, d)
    return depth.named_mean_depth(depth.region_depth(_aln(spark, d), r, min_mapq=6), r, "I").select("n_regions", *_r6("mean_collapsed", "mean_raw", "mean_singleton"))


@query("capture_summary", _depth + "SELECT round(avg(collapsed), 6) AS mean_collapsed, round(avg(raw), 6) AS mean_raw, round(avg(singleton), 6) AS mean_singleton, round(100 * avg(singleton) / avg(raw), 6) AS pct_singleton_raw, round(100 * avg(singleton) / avg(collapsed), 6) AS pct_singleton_collapsed FROM f")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage of the whole capture."""
    s = depth.capture_summary(_aln(spark, d), bed(spark, d), min_mapq=6)
    return s.select(*_r6(*s.columns))


# ---------------------------------------------------------------- errors

_cube_of = lambda where: f"cube AS (SELECT CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, base, qual, cycle, count(*) AS obs, count(*) FILTER (base <> ref_base) AS err FROM bases WHERE (flag & 3844) = 0 AND base <> 'N' AND {where} GROUP BY ALL)"
_cube = with_("bases", extra=_cube_of("mapq >= 6"))


def _error_cube(spark: SparkSession, d: str) -> DataFrame:
    return errors.error_cube(alignments(spark, d), reference(spark), min_mapq=6)


@query("err_cube", _cube + "SELECT mate, base, qual, cycle, obs, err FROM cube")
def err_cube(spark: SparkSession, d: str) -> DataFrame:
    """Observations and errors by mate, base, quality and cycle."""
    return _error_cube(spark, d)


@query("err_cube_strict", with_("bases", "bed", extra=_cube_of("mapq >= 6 AND pv >= 40 AND fm >= 2 AND fm <= 6 AND fp <> 0 AND (flag & 2) <> 0 AND rv > 0 AND rv < fm AND EXISTS (SELECT 1 FROM bed b WHERE b.contig = bases.contig AND pos < b.end_pos + 20 AND endpos > b.start_pos - 20)")) + "SELECT mate, base, qual, cycle, obs, err FROM cube")
def err_cube_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same under all gates."""
    return errors.error_cube(alignments(spark, d), reference(spark), min_mapq=6, min_pv=40, min_fm=2, max_fm=6, require_fp=True, proper_only=True, duplex=True, regions=bed(spark, d), padding=20)


@query("err_marginals", _cube + "SELECT CASE grouping_id(base, cycle) WHEN 0 THEN 'base_cycle' WHEN 2 THEN 'cycle' ELSE 'global' END AS kind, mate, base, cycle, CAST(sum(obs) AS BIGINT) AS obs, CAST(sum(err) AS BIGINT) AS err, round(sum(obs * power(10.0, qual * -0.1)), 4) AS expected FROM cube WHERE qual > 2 GROUP BY GROUPING SETS ((mate, base, cycle), (mate, cycle), (mate))")
def err_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Marginals of the cube with the errors that the qualities promise."""
    return errors.cube_marginals(_error_cube(spark, d)).withColumn("expected", F.round("expected", 4))


@query("err_cycle", _cube + ", c AS (SELECT cycle, CAST(coalesce(sum(err) FILTER (mate = 1), 0) AS BIGINT) AS r1_err, CAST(coalesce(sum(obs) FILTER (mate = 1), 0) AS BIGINT) AS r1_obs, CAST(coalesce(sum(err) FILTER (mate = 2), 0) AS BIGINT) AS r2_err, CAST(coalesce(sum(obs) FILTER (mate = 2), 0) AS BIGINT) AS r2_obs FROM cube WHERE qual > 2 GROUP BY cycle) SELECT cycle, round(r1_err / nullif(r1_obs, 0), 6) AS r1_rate, round(r2_err / nullif(r2_obs, 0), 6) AS r2_rate, r1_err, r1_obs, r2_err, r2_obs FROM c")
def err_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Error rates by cycle."""
    return errors.cycle_rates(_error_cube(spark, d)).select("cycle", *_r6("r1_rate", "r2_rate"), "r1_err", "r1_obs", "r2_err", "r2_obs")


_ph = lambda p: f"CASE WHEN {p} > 0 THEN CAST(floor(-10 * log10({p}) + 0.5) AS INT) ELSE 3117 END"
_impute = _cube + f""", g AS (SELECT mate, base, cycle, sum(obs) AS obs, sum(err) AS err, sum(obs * power(10.0, qual * -0.1)) AS x FROM cube WHERE qual > 2 GROUP BY ALL),
d AS (SELECT mate, base, cycle, CASE WHEN obs >= 100 THEN {_ph('(err / obs)')} - {_ph('(x / obs)')} ELSE 0 END AS shift FROM g),
t AS (SELECT mate, cycle, base, qual, CAST(CASE WHEN qual <= 2 THEN 2 ELSE greatest(2, qual + coalesce(shift, 0)) END AS INT) AS new_qual FROM cube LEFT JOIN d USING (mate, base, cycle)) """


@query("err_impute", _impute + "SELECT mate, cycle, base, qual, new_qual FROM t")
def err_impute(spark: SparkSession, d: str) -> DataFrame:
    """Recalibrated qualities of every cell."""
    return errors.impute_quality(_error_cube(spark, d), min_obs=100)


@query("quality_rescale", _impute + "SELECT CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, cycle, CAST(CASE WHEN b.base = 'N' THEN 2 ELSE least(93, coalesce(new_qual, b.qual)) END AS INT) AS qual, count(*) AS n FROM bases b LEFT JOIN t ON t.mate = CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AND t.cycle = b.cycle AND t.base = b.base AND t.qual = b.qual GROUP BY 1, 2, 3".replace("mate, cycle, CAST(CASE WHEN b.base", "mate, b.cycle AS cycle, CAST(CASE WHEN b.base"))
def quality_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Bases by mate, cycle and recalibrated quality."""
    from readloom.functions.cigar import aligned_bases

    t = errors.impute_quality(_error_cube(spark, d), min_obs=100)
    a = alignments(spark, d).withColumn("mate", F.when(any_of(F.col("flag"), 128), 2).otherwise(1))
    b = aligned_bases(a, ["mate"], reverse=any_of(F.col("flag"), REVERSE)).select("mate", "cycle", "base", "qual")
    return barcodes.rescale_quality(b, t).groupBy("mate", "cycle", "qual").agg(F.count("*").alias("n"))


_byfm = with_("bases", extra="g AS (SELECT fm, " + ", ".join(f"count(*) FILTER (m = {m} AND base <> ref_base) AS r{m}_err, count(*) FILTER (m = {m}) AS r{m}_obs" for m in (1, 2)) + " FROM (SELECT *, CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS m FROM bases WHERE (flag & 1796) = 0 AND base <> 'N' AND pv >= 30 AND fa / fm >= 0.6) GROUP BY fm)")
_byfm_rates = "round(r1_err / nullif(r1_obs, 0), 6) AS r1_rate, round(r2_err / nullif(r2_obs, 0), 6) AS r2_rate"


@query("err_by_fm", _byfm + f"SELECT fm, {_byfm_rates}, r1_err, r1_obs, r2_err, r2_obs FROM g")
def err_by_fm(spark: SparkSession, d: str) -> DataFrame:
    """Error rates by family size."""
    return errors.error_by_family_size(alignments(spark, d), reference(spark), min_pv=30, min_fraction=0.6).select("fm", *_r6("r1_rate", "r2_rate"), "r1_err", "r1_obs", "r2_err", "r2_obs")


@query("weighted_error_sweep", _byfm + ", s AS (SELECT fm, count(*) AS n FROM aln WHERE (flag & 2432) = 0 GROUP BY fm) SELECT fm, round(sum(r1_err / r1_obs * n) OVER (ORDER BY fm DESC) / sum(n) OVER (ORDER BY fm DESC), 6) AS mean_error FROM g JOIN s USING (fm)")
def weighted_error_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean error of families of m reads or more, for every m."""
    e = errors.error_by_family_size(alignments(spark, d), reference(spark), min_pv=30, min_fraction=0.6).select("fm", F.col("r1_rate").alias("rate"))
    s = _aln(spark, d).where(~any_of(F.col("flag"), 2432)).groupBy("fm").agg(F.count("*").alias("n_families"))
    return errors.weighted_error_sweep(e, s).select("fm", *_r6("mean_error"))


@query("err_by_region", with_("bases", "bed", extra="p AS (SELECT read_id, contig, pos, endpos, count(*) AS obs, count(*) FILTER (base <> ref_base) AS err FROM bases WHERE (flag & 3844) = 0 AND base <> 'N' GROUP BY ALL)") + "SELECT region_id, CAST(sum(err) AS BIGINT) AS errors, CAST(sum(obs) AS BIGINT) AS obs, round(100.0 * sum(err) / sum(obs), 6) AS pct_error FROM p JOIN bed b ON p.contig = b.contig AND pos < end_pos AND endpos > start_pos GROUP BY region_id")
def err_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of the reads over each region."""
    return errors.error_by_region(alignments(spark, d), reference(spark), bed(spark, d)).select("region_id", "errors", "obs", *_r6("pct_error"))


# ---------------------------------------------------------------- rescue

def _stacked(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Alignments with the full signature of a pair: the mate lies 100 positions behind, on the other strand."""
    a = alignments(spark, d).withColumns({"nc": F.lit(None).cast("int"), "mate_contig": F.col("contig"), "mate_pos": F.col("pos") + 100, "lm": F.col("len")})
    return rescue.with_signature(a)


_K = "contig, pos, rev, len, second"
_on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in _K.split(", "))
_stack = with_("aln", extra=f"s AS (SELECT contig, pos, is_rev AS rev, len, (flag & 128) <> 0 AS second, barcode, fm, rv, np, read_id, shape FROM aln WHERE (flag & 2304) = 0), n AS (SELECT DISTINCT {_K}, barcode FROM s)")
_pairs = f"SELECT {', '.join('a.' + c for c in _K.split(', '))}, a.barcode, min(b.barcode) AS parent FROM n a JOIN n b ON {_on('a', 'b')} AND a.barcode < b.barcode AND hamming(a.barcode, b.barcode) <= 2 GROUP BY ALL"


def _sig_out(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"sig_0": "contig", "sig_1": "pos", "sig_2": "rev", "sig_3": "len", "sig_4": "second"})


def _rescued(spark: SparkSession, d: str, **kw) -> tuple[DataFrame, DataFrame]:
    a, sig = _stacked(spark, d)
    return rescue.rescue(a, sig, **kw)


@query("rescue_pairs", _stack + _pairs)
def rescue_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes of a stack with the barcode that each is merged into."""
    a, sig = _stacked(spark, d)
    return _sig_out(rescue.rescue_parents(a.where(~any_of(F.col("flag"), 2304)), sig, "barcode")).select("contig", "pos", "rev", "len", "second", "barcode", "parent")


_up = " AND ".join(f"par.{c} = w.{c}" for c in _K.split(", "))
_roots = _stack.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", par AS ({_pairs}), w AS (SELECT {_K}, barcode, barcode AS last_name FROM n UNION ALL SELECT {', '.join('w.' + c for c in _K.split(', '))}, w.barcode, par.parent FROM w JOIN par ON {_up} AND par.barcode = w.last_name), root AS (SELECT {_K}, barcode, max(last_name) AS root FROM w GROUP BY ALL) "


@query("rescue_records", _roots + f"SELECT {_K}, root, count(*) AS n_merged, CAST(sum(fm) AS BIGINT) AS fm, CAST(sum(rv) AS BIGINT) AS rv_sum, CAST(sum(np) AS BIGINT) AS np, CASE WHEN sum(rv) > 0 AND sum(rv) < sum(fm) THEN 1 ELSE 0 END AS dr, arg_max(read_id, row(barcode, read_id)) AS read_id FROM s JOIN root USING ({_K}, barcode) GROUP BY {_K}, root")
def rescue_records(spark: SparkSession, d: str) -> DataFrame:
    """Merged records of every stack, with the record that leads each."""
    rec = _rescued(spark, d)[0].withColumnRenamed("rv", "rv_sum").drop("contig", "pos", "len")
    return _sig_out(rec).select("contig", "pos", "rev", "len", "second", "root", "n_merged", "fm", "rv_sum", "np", "dr", "read_id")


@query("rescue_conservation", _stack + "SELECT CAST(sum(fm) AS BIGINT) AS fm, CAST(sum(rv) AS BIGINT) AS rv, count(*) AS n_reads FROM s")
def rescue_conservation(spark: SparkSession, d: str) -> DataFrame:
    """Reads and family sizes in sum, which a rescue leaves as they are."""
    return _rescued(spark, d)[0].agg(F.sum("fm").alias("fm"), F.sum("rv").alias("rv"), F.sum("n_merged").alias("n_reads"))


def _merged_sql(trust: bool, infer: bool = False) -> str:
    """Every record's letters in reference order, merged by root."""
    agree = "lo = hi" if trust else "lo = hi AND k = n"
    root = f"{_stack}, root AS (SELECT {_K}, barcode, '*' AS root FROM n) " if infer else _roots
    return root.rstrip() + f""", z AS (SELECT s.*, root, unnest(range(0, len)) AS i FROM s JOIN root USING ({_K}, barcode)),
l AS (SELECT z.*, {views.LETTER.format(i='i')} AS base, {views.QUAL.format(i='i')} AS q, {views.PV.format(i='i')} AS p, {views.FA.format(i='i')} AS f FROM (SELECT *, rev AS is_rev FROM z) z),
g AS (SELECT {_K}, root, i, count(*) AS n, CAST(count(*) FILTER (base <> 'N') AS INT) AS k, min(base) FILTER (base <> 'N') AS lo, max(base) FILTER (base <> 'N') AS hi, sum(f) FILTER (base <> 'N') AS f, sum(p) FILTER (base <> 'N') AS p, max(q) FILTER (base <> 'N') AS q, max(base) AS b1, max(f) AS f1, max(p) AS p1, max(q) AS q1 FROM l GROUP BY ALL),
h AS (SELECT *, CASE WHEN k = 1 THEN p ELSE {_pv('k', 'p')} END AS pm FROM g),
o AS (SELECT *, coalesce({agree} AND pm > 2, false) AS ok FROM h),
r AS (SELECT {_K}, root, i, n, k, ok, CASE WHEN n = 1 THEN b1 WHEN ok THEN lo ELSE 'N' END AS base, CASE WHEN n = 1 THEN f1 WHEN ok THEN f ELSE 0 END AS fa, CASE WHEN n = 1 THEN p1 WHEN ok THEN pm ELSE 0 END AS pv, CASE WHEN n = 1 THEN q1 WHEN ok THEN q ELSE 2 END AS qual FROM o) """


_base_sums = "SELECT base, i AS base_pos, count(*) AS n, CAST(sum(fa) AS BIGINT) AS fa, CAST(sum(pv) AS BIGINT) AS pv, CAST(sum(qual) AS BIGINT) AS qual FROM r GROUP BY base, i"


def _sum_bases(b: DataFrame) -> DataFrame:
    return b.groupBy("base", "base_pos").agg(F.count("*").alias("n"), F.sum("fa").cast("bigint").alias("fa"), F.sum("pv").cast("bigint").alias("pv"), F.sum("qual").cast("bigint").alias("qual"))


@query("rescue_bases", _merged_sql(False) + _base_sums)
def rescue_bases(spark: SparkSession, d: str) -> DataFrame:
    """Letters of the merged records by position in reference order, with sums of their statistics."""
    return _sum_bases(_rescued(spark, d)[1])


@query("rescue_trusting", _merged_sql(True) + _base_sums)
def rescue_trusting(spark: SparkSession, d: str) -> DataFrame:
    """The same where N members don't count against a letter."""
    return _sum_bases(_rescued(spark, d, trust_unmasked=True)[1])


@query("rescue_infer", _merged_sql(False, True) + _base_sums)
def rescue_infer(spark: SparkSession, d: str) -> DataFrame:
    """The same without barcodes: every stack is one molecule."""
    return _sum_bases(_rescued(spark, d, infer=True)[1])


@query("rescue_realign", _merged_sql(True) + f"""
SELECT CAST(count(*) FILTER (i = 0) AS BIGINT) AS n_reads, CAST(sum(CASE WHEN ok AND k < n THEN 1 ELSE 0 END) AS BIGINT) AS nc_sum, CAST(count(*) AS BIGINT) AS n_letters, CAST(count(*) FILTER ((CASE WHEN rev THEN CASE base WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' ELSE 'N' END ELSE base END) = 'A') AS BIGINT) AS n_a FROM r WHERE n > 1""")
def rescue_realign(spark: SparkSession, d: str) -> DataFrame:
    """Merged records on their way to realignment: reads, letters and letters gained from N members."""
    a, sig = _stacked(spark, d)
    need = ["barcode", "read_id", "qname", "flag", "fm", "rv", "np", "nc", "seq", "qual", "fa", "pv"]
    rec = rescue.rescue(a.select(*sig, *need), sig, trust_unmasked=True)[0]
    rec = cut(rec.where("nc IS NOT NULL").select("qname", "flag", "nc", "seq", "qual"), "realigned")  # what is routed, read twice below
    again = rescue.route(rec)[1]
    n = F.length("seq").cast("bigint")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = again.agg(F.count("*").alias("n_reads"), zero(n).alias("n_letters"), zero(n - F.length(F.replace("seq", F.lit("A"), F.lit("")))).alias("n_a"))
    return sums.crossJoin(rec.agg(F.sum("nc").alias("nc_sum"))).select("n_reads", "nc_sum", "n_letters", "n_a")  # one row each


@query("route_supplementary", with_("aln", extra="b AS (SELECT read_id, qname, flag, is_rev, i, " + "CASE WHEN (read_id * 7 + i * 5) % 41 = 0 THEN 'N' ELSE 'x' END AS c FROM (SELECT *, unnest(range(0, len)) AS i FROM aln))") + "SELECT qname AS name, CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, count(*) AS len, count(*) FILTER (c = 'N') AS n_ambiguous FROM b WHERE (flag & 2048) <> 0 GROUP BY 1, 2")
def route_supplementary(spark: SparkSession, d: str) -> DataFrame:
    """Reads with supplementary alignments, in sequencing order for realignment."""
    a = alignments(spark, d).withColumn("nc", F.lit(None).cast("int")).withColumn("sa", F.when(any_of(F.col("flag"), 2048), "x")).withColumn("mate_sa", F.lit(None).cast("string"))
    again = rescue.route(a, route_supplementary=True)[1]
    n = F.length("seq").cast("bigint")
    return again.groupBy("name", "mate").agg(F.sum(n).alias("len"), F.sum(n - F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("n_ambiguous"))


# ---------------------------------------------------------------- pile-ups and variants

_obs_sql = f"""
og AS (SELECT contig, ref_pos, qname, count(*) AS n, CAST(count(*) FILTER (base <> 'N') AS INT) AS k, min(base) FILTER (base <> 'N') AS lo, max(base) FILTER (base <> 'N') AS hi, sum(pv) FILTER (base <> 'N') AS ps, sum(fa) FILTER (base <> 'N') AS fs,
  sum(pv) AS pn, sum(fa) AS fn, CAST(sum(fm) AS INT) AS fm, CAST(sum(rv) AS INT) AS rv, max(mapq) AS mapq, min(flag * 2 + dr) AS f FROM bases WHERE (flag & 3844) = 0 GROUP BY ALL),
u AS (SELECT contig, ref_pos, qname, CASE WHEN lo = hi THEN lo ELSE 'N' END AS base, CAST(CASE WHEN n = 1 THEN pn WHEN k = 1 THEN ps WHEN k = 0 THEN {_pv('CAST(n AS INT)', 'pn')} WHEN lo = hi THEN {_pv('k', 'ps')} ELSE 0 END AS INT) AS pv,
  CAST(CASE WHEN n = 1 OR k = 0 THEN fn WHEN lo = hi THEN fs ELSE 0 END AS INT) AS fa, fm, f % 2 AS dr, rv, mapq, ((f // 2) & 16) <> 0 AS is_rev, CASE WHEN n > 1 THEN 1 ELSE 0 END AS overlap FROM og)"""


def _obs(spark: SparkSession, d: str, **more) -> DataFrame:
    return pileup.observations(alignments(spark, d).withColumn("sample", F.when(F.col("fp") == 1, "t").otherwise("n")), skip_flags=3844, **more)


@query("mate_overlap_merge", with_("bases", extra=_obs_sql) + "SELECT contig, ref_pos, count(*) AS n, CAST(sum(overlap) AS BIGINT) AS n_overlap, count(*) FILTER (base = 'N') AS n_masked, CAST(sum(pv) AS BIGINT) AS pv_sum, CAST(sum(fa) AS BIGINT) AS fa_sum, CAST(sum(fm) AS BIGINT) AS fm_sum FROM u GROUP BY contig, ref_pos")
def mate_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """Unique observations of every position after the merge of overlapping mates."""
    return _obs(spark, d).groupBy("contig", "ref_pos").agg(F.count("*").alias("n"), F.sum("overlap").cast("bigint").alias("n_overlap"), F.count(F.when(F.col("base") == "N", 1)).alias("n_masked"), F.sum("pv").cast("bigint").alias("pv_sum"), F.sum("fa").cast("bigint").alias("fa_sum"), F.sum("fm").cast("bigint").alias("fm_sum"))


_T = pileup.Thresholds(min_fm=2, min_pv=30, min_fa=2, min_fraction=0.5, min_mapq=6, min_count=2, min_duplex=1)
_fails = "(fm < 2 OR pv < 30 OR fa < 2 OR fa / fm < 0.5 OR mapq < 6)"


def _alleles(src: str, name: str) -> str:
    return f"""{name}0 AS (SELECT contig, ref_pos, base, count(*) AS n_obs, count(*) FILTER ({_fails}) AS n_failed, count(*) FILTER (NOT {_fails}) AS n_pass, count(*) FILTER (fm < 2) AS fm_failed, count(*) FILTER (pv < 30) AS pv_failed,
  CAST(coalesce(sum(dr) FILTER (NOT {_fails}), 0) AS BIGINT) AS n_duplex, CAST(coalesce(sum(overlap) FILTER (NOT {_fails}), 0) AS BIGINT) AS n_overlap, CAST(coalesce(sum(pv) FILTER (NOT {_fails}), 0) AS BIGINT) AS qss,
  coalesce(sum(1 - power(10.0, pv * -0.1)) FILTER ({_fails}), 0) AS t, sum(power(10.0, pv * -0.1)) AS er FROM {src} GROUP BY ALL),
{name} AS (SELECT *, n_duplex >= 1 AND n_pass >= 2 AS pass, CAST(n_pass + greatest(0, floor(t + 0.5) - floor((er_all - er) / 3 + 0.5)) AS BIGINT) AS quantity, n_obs / d AS af FROM (SELECT *, sum(er) OVER (PARTITION BY contig, ref_pos) AS er_all, sum(n_obs) OVER (PARTITION BY contig, ref_pos) AS d FROM {name}0 WHERE base <> 'N'))"""


@query("stack_allele_counts", with_("bases", extra=_obs_sql + ", " + _alleles("u", "al")) + "SELECT contig, ref_pos, base, n_obs, n_pass, n_failed, fm_failed, pv_failed, n_duplex, n_overlap, qss, CAST(pass AS INT) AS passes, quantity, round(af, 6) AS allele_fraction FROM al")
def stack_allele_counts(spark: SparkSession, d: str) -> DataFrame:
    """Allele counts of every position under thresholds, with the quantity estimate."""
    c = pileup.allele_counts(_obs(spark, d), None, _T)
    return c.select("contig", "ref_pos", "base", "n_obs", "n_pass", "n_failed", "fm_failed", "pv_failed", "n_duplex", "n_overlap", "qss", F.col("pass").cast("int").alias("passes"), "quantity", *_r6("allele_fraction"))


def _half(n: int) -> str:
    return _obs_sql.replace("(flag & 3844) = 0", f"(flag & 3844) = 0 AND fp = {n}").replace("og AS", f"og{n} AS").replace("FROM og", f"FROM og{n}").replace("u AS", f"u{n} AS")


@query("somatic_calls", with_("bases", extra=_half(1) + ", " + _half(0) + ", " + _alleles("u1", "tu") + ", " + _alleles("u0", "no")) + """
SELECT t.contig, t.ref_pos, t.base, t.n_obs, coalesce(n.n_obs, 0) AS normal_obs, CAST(t.pass AND NOT coalesce(n.pass, false) AS INT) AS somatic
FROM tu t LEFT JOIN no n ON t.contig = n.contig AND t.ref_pos = n.ref_pos AND t.base = n.base WHERE EXISTS (SELECT 1 FROM no c WHERE c.contig = t.contig AND c.ref_pos = t.ref_pos)""")
def somatic_calls(spark: SparkSession, d: str) -> DataFrame:
    """Alleles that pass in one sample and not in the other."""
    c = pileup.allele_counts(_obs(spark, d, sample="sample"), None, _T, ["contig", "ref_pos", "sample"])
    return pileup.somatic_samples(c, "sample", "t", "n").select("contig", "ref_pos", "base", "n_obs", "normal_obs", F.col("somatic").cast("int").alias("somatic"))


@query("vet_variants", with_("bases", "variants", extra=_obs_sql + ", " + _alleles("u", "al") + """,
va AS (SELECT variant_id, contig, pos, 0 AS allele_index, r AS allele, variant_id % 10 <> 0 AS snv FROM variants UNION ALL SELECT variant_id, contig, pos, 1, CASE WHEN variant_id % 10 = 0 THEN a || 'A' ELSE a END, variant_id % 10 <> 0 FROM variants),
co AS (SELECT DISTINCT contig, ref_pos FROM al)""") + """
SELECT variant_id, allele_index, allele, CASE WHEN snv AND co.contig IS NOT NULL THEN coalesce(n_pass, 0) END AS n_pass, CASE WHEN snv AND co.contig IS NOT NULL THEN coalesce(n_failed, 0) END AS n_failed,
  CASE WHEN snv AND co.contig IS NOT NULL THEN coalesce(quantity, 0) END AS quantity, CASE WHEN snv AND co.contig IS NOT NULL THEN CAST(coalesce(pass, false) AS INT) END AS vet_pass
FROM va LEFT JOIN co ON co.contig = va.contig AND co.ref_pos = va.pos LEFT JOIN al ON al.contig = va.contig AND al.ref_pos = va.pos AND al.base = va.allele""")
def vet_variants(spark: SparkSession, d: str) -> DataFrame:
    """Known variants checked against the pile-up, per allele."""
    known = variants(spark, d)
    v = pileup.vet_variants(known, _obs(spark, d, loci=pileup.variant_loci(known)), _T)
    return v.select("variant_id", "allele_index", "allele", "n_pass", "n_failed", "quantity", F.col("vet_pass").cast("int").alias("vet_pass"))


@query("locus_allele_fraction", with_("bases", "variants", extra=_obs_sql + ", lo AS (SELECT DISTINCT contig, pos, r, min(a) OVER (PARTITION BY contig, pos) AS a FROM variants)") + "SELECT contig, ref_pos, count(*) FILTER (base = r) AS n_ref, count(*) FILTER (base = a) AS n_alt, round(count(*) FILTER (base = a) / nullif(count(*) FILTER (base = r) + count(*) FILTER (base = a), 0), 6) AS alt_fraction FROM u JOIN lo USING (contig) WHERE ref_pos = pos AND fm >= 2 GROUP BY contig, ref_pos")
def locus_allele_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Alternative allele fraction at the loci of known variants."""
    loci = variants(spark, d).groupBy("contig", F.col("pos").alias("ref_pos")).agg(F.min(F.element_at("alleles", 1)).alias("ref_base"), F.min(F.substring(F.element_at("alleles", 2), 1, 1)).alias("alt_base"))
    return pileup.locus_fraction(_obs(spark, d, loci=loci), loci, min_fm=2).select("contig", "ref_pos", "n_ref", "n_alt", *_r6("alt_fraction"))


@query("allele_family_sizes", with_("bases") + "SELECT contig, base, fm, count(*) AS n FROM bases WHERE (flag & 3844) = 0 GROUP BY contig, base, fm")
def allele_family_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Family sizes behind every letter."""
    from readloom.functions.cigar import aligned_bases

    a = alignments(spark, d).where(~any_of(F.col("flag"), 3844))
    return aligned_bases(a, ["contig", "fm"], reverse=F.col("is_rev")).groupBy("contig", "base", "fm").agg(F.count("*").alias("n"))


@query("region_coverage_gaps", """
WITH e AS (SELECT DISTINCT contig, start_pos AS s, end_pos AS t FROM regions WHERE end_pos > start_pos),
o AS (SELECT *, max(t) OVER (PARTITION BY contig ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
i AS (SELECT *, count(*) FILTER (p IS NULL OR s > p) OVER (PARTITION BY contig ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT contig, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS covered FROM (SELECT contig, k, max(t) - min(s) AS n FROM i GROUP BY ALL) GROUP BY contig""")
def region_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Positions covered by the target regions of each contig."""
    from readloom.operators.spans import spans_and_gaps

    s = spans_and_gaps(table(spark, d, "regions"), ["contig"]).where("kind = 'span'")
    return s.groupBy("contig").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered"))


from readloom.plans import more  # noqa: E402, F401  registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the smallest tables with their consensus."""
    return family_consensus(spark, sf_dir)
