"""More queries and their SQL twins: marking of pairs, length rules, error outputs, vetting, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.flags import READ2, REVERSE, any_of
from readloom.operators import barcodes, collapse, errors, pileup, reads, rescue
from readloom.plans import catalog as c
from readloom.plans import tools, views
from readloom.plans.views import alignments, bed, reads_once, reference, variants, with_
from readloom.session import cut, drop_cut, scratch, table
from readloom.sources import bed as bed_files
from readloom.sources import fasta, fastq, reports, sam, vcf

query = c.query
_r6 = c._r6

# ---------------------------------------------------------------- marking

_mates = "m AS (SELECT DISTINCT ON (read_id) library_id || ':' || qname AS id, mate, upper(trim(barcode)) AS barcode, upper(seq) AS seq, qual FROM reads_marked WHERE seq IS NOT NULL AND qual IS NOT NULL), p AS (SELECT a.id, a.seq AS s1, a.qual AS q1, b.seq AS s2, b.qual AS q2, a.barcode AS ix FROM m a JOIN m b ON a.id = b.id AND a.mate = 1 AND b.mate = 2)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mates 1, mates 2 and index reads (the barcodes of mates 1) that share a read_id by library and name."""
    r = table(spark, d, "reads_marked").where("seq is not null and qual is not null").dropDuplicates(["read_id"])
    r = r.select(F.concat(F.col("library_id").cast("string"), F.lit(":"), F.col("qname")).alias("read_id"), F.col("qname").alias("name"), "mate", F.upper("seq").alias("seq"), "qual", F.upper(F.trim("barcode")).alias("barcode"))
    side = lambda m: r.where(F.col("mate") == m).drop("mate", "barcode")
    return side(1), side(2), r.where("mate = 1 and barcode is not null").select("read_id", "name", F.col("barcode").alias("seq"), F.lit("").alias("qual"))


_alike = lambda s, n: "(" + " OR ".join(f"contains({s}, '{b * n}')" for b in "ACGTN") + f" OR contains({s}, 'N'))"
_at = "CASE WHEN substring(s1, 5, 2) = 'TG' THEN 4 WHEN substring(s1, 6, 2) = 'TG' THEN 5 WHEN substring(s1, 7, 2) = 'TG' THEN 6 END"


@query("mark_inline_pair", "WITH " + _mates + f""",
h AS (SELECT *, substring(s1, 1, 4) AS h1, substring(s2, 1, 4) AS h2, coalesce({_at}, 4) + 2 AS t, {_at} IS NOT NULL AS ok FROM p),
k AS (SELECT *, least(h1, h2) || greatest(h1, h2) AS bc, h1 > h2 AS turned FROM h),
f AS (SELECT *, CASE WHEN ok AND NOT {_alike('bc', 5)} THEN 1 ELSE 0 END AS fp FROM k)
SELECT id AS read_id, 1 AS mate, bc AS barcode, CASE WHEN turned THEN 'R' ELSE 'F' END AS strand, fp, substring(CASE WHEN turned THEN s2 ELSE s1 END, t + 1) AS seq, substring(CASE WHEN turned THEN q2 ELSE q1 END, t + 1) AS qual FROM f
UNION ALL SELECT id, 2, bc, CASE WHEN turned THEN 'R' ELSE 'F' END, fp, substring(CASE WHEN turned THEN s1 ELSE s2 END, t + 1), substring(CASE WHEN turned THEN q1 ELSE q2 END, t + 1) FROM f""")
def mark_inline_pair(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with half a barcode of four letters on each mate, before homing letters at up to three places."""
    r1, r2, _ = _sides(spark, d)
    return barcodes.mark_inline(r1, r2, barcode_len=4, homing="TG", max_barcode_len=6, hp_threshold=4).select("read_id", "mate", "barcode", "strand", "fp", "seq", "qual")


_sec = lambda bc, cut, mates: "WITH " + _mates + f", k AS (SELECT *, {bc} AS bc FROM p WHERE ix IS NOT NULL), f AS (SELECT *, CASE WHEN {_alike('bc', 11)} THEN 0 ELSE 1 END AS fp FROM k) " + " UNION ALL ".join(f"SELECT id AS read_id, {m} AS mate, bc AS barcode, 'Z' AS strand, fp, substring(s{m}, {cut + 1}) AS seq, substring(q{m}, {cut + 1}) AS qual FROM f" for m in mates)


@query("mark_secondary_pair", _sec("substring(s1, 2, 2) || ix || substring(s2, 2, 2)", 3, (1, 2)))
def mark_secondary_pair(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with an index read and two letters of salt on each mate, behind an offset."""
    r1, r2, ix = _sides(spark, d)
    return barcodes.mark_secondary(r1, ix, r2, salt=2, offset=1).select("read_id", "mate", "barcode", "strand", "fp", "seq", "qual")


@query("mark_secondary_single", "WITH " + _mates.split(", p AS")[0] + f", f AS (SELECT id, seq, qual, substring(seq, 1, 3) || barcode AS bc FROM m WHERE mate = 1 AND barcode IS NOT NULL) SELECT id AS read_id, 1 AS mate, bc AS barcode, 'Z' AS strand, CASE WHEN {_alike('bc', 11)} THEN 0 ELSE 1 END AS fp, substring(seq, 4) AS seq, substring(qual, 4) AS qual FROM f")
def mark_secondary_single(spark: SparkSession, d: str) -> DataFrame:
    """Single reads with an index read and three letters of salt."""
    r1, _, ix = _sides(spark, d)
    return barcodes.mark_secondary(r1, ix, salt=3).select("read_id", "mate", "barcode", "strand", "fp", "seq", "qual")


@query("index_reads", with_("reads") + "SELECT read_id, substring(seq, 9) AS rest, substring(seq, 1, 8) AS index_seq, repeat('N', 6) || substring(seq, 7) AS masked, repeat('#', 6) || substring(qual, 7) AS masked_qual, substring(seq, 1, 6) AS sided FROM reads WHERE seq IS NOT NULL AND qual IS NOT NULL")
def index_reads(spark: SparkSession, d: str) -> DataFrame:
    """Inline barcodes made index reads: cut off the reads, or masked in them."""
    r = reads_once(spark, d).where("seq is not null and qual is not null").select("read_id", "seq", "qual")
    rest, index = barcodes.barcode_to_index(r, 4)
    masked, sided = barcodes.single_sided_index(r, 6)
    one = lambda df, n, q=False: df.select("read_id", F.col("seq").alias(n), *([F.col("qual").alias(f"{n}_qual")] if q else []))
    return one(rest, "rest").join(one(index, "index_seq"), "read_id").join(one(masked, "masked", True), "read_id").join(one(sided, "sided"), "read_id")


_frac = "1 - len(list_filter(range(0, len), lambda i: (read_id * 7 + i * 5) % 41 = 0)) / len"


@query("mark_single_end", with_("aln") + f"SELECT read_id, {c._ucs} AS su, CASE WHEN fp = 0 THEN flag | 512 ELSE flag END AS flag FROM aln WHERE {_frac} >= 0.97")
def mark_single_end(spark: SparkSession, d: str) -> DataFrame:
    """QC bits of single reads of which nearly all letters are known."""
    a = alignments(spark, d).withColumn("sa", F.lit(None).cast("string"))
    return reads.mark_pairs(a, single_end=True, min_unambiguous=0.97).select("read_id", "su", "flag")


@query("mark_pairs_dropped", with_("aln", extra=f"m AS (SELECT *, (flag & 128) <> 0 AS second, {_frac} AS fr, CASE WHEN shape = 2 THEN (len - 2) / len ELSE 1.0 END AS al FROM aln)") + """
SELECT a.read_id, round(b.al, 6) AS mf FROM m a LEFT JOIN m b ON a.qname = b.qname AND a.second <> b.second AND (b.flag & 2304) = 0
WHERE greatest(a.fr, coalesce(b.fr, a.fr)) >= 0.98 AND NOT (a.fp = 0 OR coalesce(b.fp, 1) = 0 OR (a.flag & 512) <> 0)""")
def mark_pairs_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without failed ones and without those unclear on both sides, with the mate's aligned fraction."""
    a = alignments(spark, d).withColumn("sa", F.lit(None).cast("string"))
    return reads.mark_pairs(a, drop_qcfail=True, min_unambiguous=0.98, add_aligned_fraction=True).select("read_id", *_r6("mf"))


# ---------------------------------------------------------------- families


@query("family_length_rule", with_("reads", extra="l AS (SELECT library_id, barcode, mate, arg_min(length(seq), read_id) AS n FROM reads WHERE length(seq) > 0 GROUP BY ALL)") + """
SELECT read_id, CASE WHEN length(seq) > n THEN right(seq, n) WHEN length(seq) > 0 AND length(seq) < n THEN lpad(seq, CAST(n AS INT), 'N') ELSE seq END AS seq,
  CASE WHEN length(seq) <> n AND length(seq) > 0 THEN CASE WHEN length(seq) > n THEN right(qual, n) ELSE right(repeat('#', CAST(greatest(n - length(qual), 0) AS INT)) || left(qual, n), n) END ELSE qual END AS qual
FROM reads LEFT JOIN l USING (library_id, barcode, mate) WHERE n IS NULL OR seq IS NULL OR length(seq) = 0 OR length(seq) = n OR coalesce(fp, 1) = 0""")
def family_length_rule(spark: SparkSession, d: str) -> DataFrame:
    """Reads brought to the length of their family's first one."""
    return collapse.align_lengths(reads_once(spark, d), c.FAMILY, "read_id").select("read_id", "seq", "qual")


_duplex = c.SQL["family_consensus_duplex"].split("\ny AS (")[0].rstrip().rstrip(",")


@query("strand_distance_hist", _duplex + f", d AS (SELECT {c._key}, CAST(sum(CASE WHEN fb <> rb THEN 1 ELSE 0 END) FILTER (fb IS NOT NULL AND rb IS NOT NULL) AS INT) AS strand_distance FROM x GROUP BY ALL), r AS (SELECT {c._key}, count(*) AS fm, count(*) FILTER (strand = 'R') AS rv FROM reads GROUP BY ALL) SELECT strand_distance, count(*) AS n_families FROM d JOIN r USING ({c._key}) WHERE rv > 0 AND rv < fm AND strand_distance IS NOT NULL GROUP BY strand_distance")
def strand_distance_hist(spark: SparkSession, d: str) -> DataFrame:
    """Duplex families by the distance between their strands."""
    r = reads_once(spark, d).withColumn("strand", F.when(F.col("strand") == "R", "R").otherwise("F"))
    return collapse.strand_distances(collapse.collapse_families(r, c.FAMILY, "read_id"))


@query("family_counters", with_("reads", extra="m AS (SELECT count(*) AS fm, count(*) FILTER (strand = 'R') AS rv FROM reads GROUP BY library_id, barcode, mate)") + """
SELECT count(*) FILTER (rv > 0 AND rv < fm) AS n_duplex, count(*) FILTER (NOT (rv > 0 AND rv < fm)) AS n_single_strand, count(*) FILTER (NOT (rv > 0 AND rv < fm) AND fm > 1) AS n_single_strand_real,
  CAST(coalesce(sum(fm) FILTER (rv > 0 AND rv < fm), 0) AS BIGINT) AS duplex_reads, CAST(sum(fm) AS BIGINT) AS n_reads FROM m""")
def family_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of collapsed families."""
    return collapse.family_counters(collapse.collapse_families(reads_once(spark, d), c.FAMILY, "read_id"))


@query("collapse_marked_files", c.SQL["family_consensus_duplex"].replace("library_id, barcode, mate", "barcode"))
def collapse_marked_files(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as marked FASTQ, read again and collapsed by barcode alone."""
    path = scratch(spark, "marked")
    r = reads_once(spark, d).select(F.col("read_id").cast("string").alias("name"), fastq.marked_comment(F.col("barcode"), F.when(F.col("strand") == "R", "R").otherwise("F"), F.coalesce("fp", F.lit(0))).alias("comment"), "seq", "qual")
    fastq.write_fastq(r, path)
    f = tools.collapse_marked_fastq(spark, path)
    return f.select("barcode", "fm", "rv", "dr", F.round("nf", 6).alias("nf"), "seq", "qual", F.array_join("fa", ",").alias("fa"), F.array_join("pv", ",").alias("pv"))


# ---------------------------------------------------------------- errors


@query("err_contig", with_("bases", extra=c._cube_of("contig = 'N'")) + "SELECT mate, base, qual, cycle, obs, err FROM cube")
def err_contig(spark: SparkSession, d: str) -> DataFrame:
    """The cube of one contig."""
    return errors.error_cube(alignments(spark, d), reference(spark), contig="N")


@query("err_full_rates", c._cube + ", g AS (SELECT * FROM (SELECT DISTINCT cycle FROM cube), (SELECT unnest([1, 2]) AS mate), (SELECT unnest(['A', 'C', 'G', 'T']) AS base), (SELECT unnest(range(2, 47)) AS qual)) SELECT mate, base, CAST(qual AS INT) AS qual, cycle, round(CASE WHEN obs > 0 THEN err / obs ELSE -1337 END, 6) AS rate, coalesce(obs, 0) AS obs FROM g LEFT JOIN cube USING (mate, base, qual, cycle)")
def err_full_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of all cells, the sentinel where nothing was seen."""
    return errors.full_rates(c._error_cube(spark, d)).select("mate", "base", "qual", "cycle", *_r6("rate"), "obs")


@query("err_trimmed", c._cube + ", n AS (SELECT cycle FROM cube GROUP BY cycle HAVING sum(obs) >= 20) SELECT mate, base, qual, cycle, obs, err FROM cube WHERE cycle <= (SELECT max(cycle) FROM n)")
def err_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The cube up to the last cycle with enough observations."""
    return errors.trim_cycles(c._error_cube(spark, d), min_obs=20)


@query("err_offsets", c._impute + "SELECT mate, base, cycle, shift FROM d")
def err_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Shifts of measured against promised qualities."""
    return errors.quality_offsets(c._error_cube(spark, d), min_obs=100)


@query("rescaled_reads", c._impute + f", r AS (SELECT read_id, CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, i, {views.LETTER.format(i='i')} AS base, {views.QUAL.format(i='i')} AS qual FROM (SELECT *, unnest(range(0, len)) AS i FROM aln WHERE NOT is_rev)) SELECT read_id, CAST(sum(CASE WHEN r.base = 'N' THEN 2 ELSE coalesce(new_qual, r.qual) END) AS BIGINT) AS qual_sum, CAST(sum(CASE WHEN r.base = 'N' THEN 2 ELSE coalesce(new_qual, r.qual) END * (i + 1)) AS BIGINT) AS placed_sum FROM r LEFT JOIN t ON t.mate = r.mate AND t.cycle = i AND t.base = r.base AND t.qual = r.qual GROUP BY read_id")
def rescaled_reads(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads with recalibrated qualities."""
    t = fasta.check_rescaler(errors.impute_quality(c._error_cube(spark, d), min_obs=100))
    a = alignments(spark, d).where(~any_of(F.col("flag"), REVERSE)).select("read_id", F.when(any_of(F.col("flag"), READ2), 2).otherwise(1).alias("mate"), "seq", "qual")
    q = F.transform(F.split("qual", ""), lambda x: F.ascii(x) - 33)
    total = lambda f: F.aggregate(F.transform(q, f), F.lit(0).cast("bigint"), lambda s, x: s + x)
    per = barcodes.rescale_reads(a, t).select("read_id", total(lambda x, i: x).alias("q"), total(lambda x, i: x * (i + 1)).alias("p"))
    return per.groupBy("read_id").agg(F.sum("q").alias("qual_sum"), F.sum("p").alias("placed_sum"))


# ---------------------------------------------------------------- pile-ups and variants

_stacked = ", " + c._alleles("u", "al").replace("CAST(coalesce(sum(dr)", "count(*) FILTER (NOT (fm < 2 OR pv < 30 OR fa < 2 OR fa / fm < 0.5 OR mapq < 6) AND is_rev) AS n_rev, CAST(coalesce(sum(dr)")


@query("stack_reference_order", with_("bases", extra=c._obs_sql + _stacked + f", am AS (SELECT contig, ref_pos, CAST(count(*) FILTER (base = 'N') AS BIGINT) AS ambig FROM u GROUP BY ALL), rf AS (SELECT *, substring('ACGT', CAST({views._ref_index.format(r='ref_pos')} AS INT) + 1, 1) = base AS is_ref FROM al)") + """
SELECT contig, ref_pos, base, CAST(is_ref AS INT) AS is_ref, CAST(row_number() OVER (PARTITION BY contig, ref_pos ORDER BY is_ref DESC, base) - 1 AS INT) AS allele_order, ambig, round(n_rev / nullif(n_pass, 0), 6) AS reverse_fraction FROM rf JOIN am USING (contig, ref_pos)""")
def stack_reference_order(spark: SparkSession, d: str) -> DataFrame:
    """Alleles of every position, the reference's first, with unclear observations and strand balance."""
    a = pileup.allele_counts(c._obs(spark, d), reference(spark), c._T)
    return a.select("contig", "ref_pos", "base", F.col("is_ref").cast("int").alias("is_ref"), "allele_order", "ambig", *_r6("reverse_fraction"))


_md = f"(SELECT a.*, len(list_filter(range(0, len), lambda i: (read_id * 7 + i * 5) % 41 <> 0 AND {views.LETTER.format(i='i')} <> substring('ACGT', CAST({views._ref_index.format(r='(pos + i)')} AS INT) + 1, 1))) AS md FROM aln a)"


@query("stack_md", with_("aln", extra=f"m AS {_md}").rstrip() + ", " + views.CTE["bases"].replace("FROM aln)", "FROM m)") + f""", g AS (SELECT contig, ref_pos, qname, max(md) AS md FROM bases WHERE (flag & 3844) = 0 GROUP BY ALL), {c._obs_sql.strip()}
SELECT contig, ref_pos, base, count(*) AS n_obs, count(*) FILTER (md >= 4) AS md_failed, count(*) FILTER (md < 4 AND fm >= 2) AS n_pass FROM u JOIN g USING (contig, ref_pos, qname) WHERE base <> 'N' GROUP BY ALL""")
def stack_md(spark: SparkSession, d: str) -> DataFrame:
    """Allele counts under a limit of mismatches around an observation."""
    a = alignments(spark, d)
    o = pileup.observations(pileup.mismatch_density(a, reference(spark), a.columns), skip_flags=3844)
    return pileup.allele_counts(o, None, pileup.Thresholds(md_threshold=4, min_fm=2)).select("contig", "ref_pos", "base", "n_obs", "md_failed", "n_pass")


@query("stack_gates", with_("aln", extra="g AS (SELECT CASE WHEN (flag & 1796) <> 0 THEN 'flag' WHEN (flag & 2) = 0 THEN 'improper' WHEN shape = 2 AND (len - 2) / len < 0.95 THEN 'aligned_fraction' ELSE 'pass' END AS reason, shape, len FROM aln)") + "SELECT reason, count(*) AS n_reads, CAST(sum(CASE WHEN shape = 2 THEN len - 2 ELSE len END) AS BIGINT) AS n_bases FROM g GROUP BY reason UNION ALL SELECT 'deletion', count(*), count(*) FILTER (shape = 3) FROM g WHERE reason = 'pass'")
def stack_gates(spark: SparkSession, d: str) -> DataFrame:
    """Alignments and letters that each gate of a pile-up refuses."""
    return pileup.gate_counts(c.alignments(spark, d, bases=False), skip_flags=1796, skip_improper=True, min_aligned_fraction=0.95)


@query("allele_sizes_at_loci", with_("bases", "variants", extra=c._obs_sql) + "SELECT contig, ref_pos, base, fm, count(*) AS n FROM u WHERE EXISTS (SELECT 1 FROM variants v WHERE v.contig = u.contig AND v.pos = u.ref_pos) GROUP BY ALL")
def allele_sizes_at_loci(spark: SparkSession, d: str) -> DataFrame:
    """Family sizes behind each letter at the variants' positions."""
    loci = variants(spark, d).select("contig", F.col("pos").alias("ref_pos")).distinct()
    return pileup.base_family_sizes(c._obs(spark, d, loci=loci))


_vet = c.SQL["vet_variants"].split("\nSELECT variant_id, allele_index")[0]


@query("vet_in_regions", _vet.replace("WITH ", "WITH " + views.CTE["bed"] + ", ", 1) + """, iv AS (SELECT v.*, snv AND EXISTS (SELECT 1 FROM bed b WHERE b.contig = v.contig AND v.pos < b.end_pos + 3 AND v.pos + 1 > b.start_pos - 3) AS inside FROM va v)
SELECT variant_id, allele_index, allele, CASE WHEN inside AND co.contig IS NOT NULL THEN coalesce(n_obs, 0) END AS n_obs, CASE WHEN inside AND co.contig IS NOT NULL THEN CAST(coalesce(pass, false) AS INT) END AS vet_pass
FROM iv LEFT JOIN co ON co.contig = iv.contig AND co.ref_pos = iv.pos LEFT JOIN al ON al.contig = iv.contig AND al.ref_pos = iv.pos AND al.base = iv.allele""")
def vet_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """Known variants checked inside regions; all others are passed on."""
    known = variants(spark, d)
    v = pileup.vet_variants(known, c._obs(spark, d, loci=pileup.variant_loci(known)), c._T, regions=bed(spark, d), padding=3)
    return v.select("variant_id", "allele_index", "allele", "n_obs", F.col("vet_pass").cast("int").alias("vet_pass"))


@query("vet_records", _vet + f""", dd AS (SELECT contig, ref_pos, CAST(sum(dr) FILTER (NOT {c._fails}) AS BIGINT) AS dup, CAST(coalesce(sum(overlap) FILTER (base = 'N'), 0) AS BIGINT) AS dis FROM u GROUP BY ALL),
w AS (SELECT variant_id, va.contig, pos, allele_index, allele, snv AND co.contig IS NOT NULL AS use, n_pass, n_failed, n_duplex, n_overlap, quantity, qss, pass FROM va LEFT JOIN co ON co.contig = va.contig AND co.ref_pos = va.pos LEFT JOIN al ON al.contig = va.contig AND al.ref_pos = va.pos AND al.base = va.allele)
SELECT variant_id, w.contig, pos AS ref_pos, string_agg(allele, ',' ORDER BY allele_index) AS alleles, """ + ", ".join(f"string_agg(CASE WHEN use THEN CAST(coalesce({x}, 0) AS VARCHAR) ELSE '.' END, ',' ORDER BY allele_index) AS {n}" for n, x in (("n_pass", "n_pass"), ("n_failed", "n_failed"), ("n_duplex", "n_duplex"), ("n_overlap", "n_overlap"), ("quantity", "quantity"), ("qss", "qss"))) + """,
  max(CASE WHEN use THEN coalesce(dup, 0) END) AS depth_duplex, max(CASE WHEN use THEN coalesce(dis, 0) END) AS disc_overlap FROM w LEFT JOIN dd ON dd.contig = w.contig AND dd.ref_pos = w.pos GROUP BY variant_id, w.contig, pos""")
def vet_records(spark: SparkSession, d: str) -> DataFrame:
    """One row a variant with the numbers of its alleles in order."""
    known = variants(spark, d)
    v = pileup.vet_records(pileup.vet_variants(known, c._obs(spark, d, loci=pileup.variant_loci(known)), c._T))
    text = lambda f: F.array_join(F.transform(f, lambda x: x.cast("string")), ",", ".").alias(f)
    return v.select("variant_id", "contig", "ref_pos", F.array_join("allele", ",").alias("alleles"), *[text(f) for f in ("n_pass", "n_failed", "n_duplex", "n_overlap", "quantity", "qss")], "depth_duplex", "disc_overlap")


_ucs_key = "contig, su, rev, len, second, mu, lm"


@query("rescue_unclipped", with_("aln", extra=f"m AS (SELECT *, {c._ucs} AS su, (flag & 128) <> 0 AS second FROM aln), j AS (SELECT a.*, b.su AS mu, b.len AS lm FROM m a LEFT JOIN m b ON a.qname = b.qname AND a.second <> b.second AND (b.flag & 2304) = 0), n AS (SELECT DISTINCT contig, su, is_rev AS rev, len, second, mu, lm, barcode FROM j WHERE (flag & 2304) = 0)") + f"""
SELECT {', '.join('a.' + k for k in _ucs_key.split(', '))}, a.barcode, min(b.barcode) AS parent FROM n a JOIN n b ON a.contig = b.contig AND a.su = b.su AND a.rev = b.rev AND a.len = b.len AND a.second = b.second AND a.mu IS NOT DISTINCT FROM b.mu AND a.lm IS NOT DISTINCT FROM b.lm
AND a.barcode < b.barcode AND hamming(a.barcode, b.barcode) <= 2 GROUP BY ALL""")
def rescue_unclipped(spark: SparkSession, d: str) -> DataFrame:
    """Barcodes that nearly agree among reads whose ends agree before clipping, their mates' too."""
    a = reads.mark_pairs(alignments(spark, d).withColumn("sa", F.lit(None).cast("string"))).withColumn("mate_contig", F.col("contig"))
    a, sig = rescue.with_signature(a.where(~any_of(F.col("flag"), 2304)), unclipped=True)
    p = rescue.rescue_parents(a, sig, "barcode")
    return p.select(F.col("sig_0").alias("contig"), F.col("sig_1").alias("su"), F.col("sig_2").alias("rev"), F.col("sig_3").alias("len"), F.col("sig_4").alias("second"), F.col("sig_6").alias("mu"), F.col("sig_8").alias("lm"), "barcode", "parent")


# ---------------------------------------------------------------- round trips through files


@query("io_fastq", with_("reads") + "SELECT read_id, coalesce(seq, '') AS seq, coalesce(qual, '') AS qual FROM reads")
def io_fastq(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as gzip FASTQ and read again."""
    path = scratch(spark, "fastq")
    fastq.write_fastq(reads_once(spark, d).select(F.col("read_id").cast("string").alias("name"), F.lit(None).cast("string").alias("comment"), "seq", "qual"), path, compression="gzip")
    return fastq.read_fastq(spark, path).select(F.col("name").cast("bigint").alias("read_id"), "seq", "qual")


@query("io_sam", with_("aln") + "SELECT qname, flag, contig, pos, mapq, cigar, isize, fm, rv, fp, np, dr, CAST(fm AS DOUBLE) / 4 AS nf, read_id FROM aln")
def io_sam(spark: SparkSession, d: str) -> DataFrame:
    """Alignments written as SAM with tags and read again."""
    path = scratch(spark, "sam")
    none = F.lit(None).cast("string")
    a = alignments(spark, d).withColumns({"mate_contig": none, "mate_pos": F.lit(-1), "nf": F.col("fm") / 4.0, "aux": F.create_map(F.lit("XI"), F.col("read_id").cast("string"))})
    sam.write_sam(a, path, header=["@HD\tVN:1.6"])
    return sam.read_sam(spark, path).select("qname", "flag", "contig", "pos", "mapq", "cigar", "isize", "fm", "rv", "fp", "np", "dr", "nf", F.col("aux")["XI"].cast("bigint").alias("read_id"))


@query("io_bed", "SELECT contig, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, coalesce(region_name, 'NO_ID') AS region_name FROM regions WHERE end_pos > start_pos")
def io_bed(spark: SparkSession, d: str) -> DataFrame:
    """Regions written as tab-separated text and read as BED."""
    path = scratch(spark, "bed")
    r = table(spark, d, "regions")
    r.select(F.concat_ws("\t", "contig", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "region_name").alias("value")).write.text(path)
    return bed_files.read_bed(spark, path, named=True)[0]


@query("io_vcf", with_("bases", extra=c._obs_sql + _stacked) + f", rf AS (SELECT contig, ref_pos, base, n_pass, CAST(pass AS INT) AS ok, substring('ACGT', CAST({views._ref_index.format(r='ref_pos')} AS INT) + 1, 1) <> base AS o FROM al), g AS (SELECT contig, ref_pos, string_agg(base, ',' ORDER BY o, base) AS b, string_agg(n_pass, ',' ORDER BY o, base) AS n, string_agg(ok, ',' ORDER BY o, base) AS k, bool_and(o) AS lacks FROM rf GROUP BY ALL) SELECT contig, ref_pos AS pos, CASE WHEN lacks THEN 'N,' || b ELSE b END AS alleles, CASE WHEN lacks THEN '0,' || n ELSE n END AS n_pass, CASE WHEN lacks THEN '0,' || k ELSE k END AS passes FROM g")
def io_vcf(spark: SparkSession, d: str) -> DataFrame:
    """Calls of every position written as VCF with header and FORMAT columns and read again."""
    path = scratch(spark, "vcf")
    rec = vcf.variant_records(pileup.allele_counts(c._obs(spark, d), reference(spark), c._T), fields=("n_pass",))
    vcf.write_vcf(rec, path, header=vcf.vcf_header(["pass", "n_pass"], ["Sample"]))
    return vcf.read_vcf(spark, path).select("contig", "pos", F.array_join("alleles", ",").alias("alleles"), F.get("samples", F.lit(0)).alias("n_pass"), F.col("info")["PASS"].alias("passes"))


@query("io_regions", with_("aln", "bed") + f"SELECT read_id, contig, pos, endpos FROM aln a WHERE {c._ov(7)}")
def io_regions(spark: SparkSession, d: str) -> DataFrame:
    """Alignments stored by contig and position and read by region."""
    path = scratch(spark, "alignments")
    reports.write_alignments(alignments(spark, d, bases=False), path, program="io_regions")
    return reports.read_regions(spark, path, bed(spark, d), padding=7).select("read_id", "contig", "pos", "endpos")


@query("io_rescaler", c._impute + ", gg AS (SELECT * FROM (SELECT unnest(range(0, (SELECT max(cycle) + 1 FROM t))) AS cycle), (SELECT unnest([1, 2]) AS mate), (SELECT unnest(['A', 'C', 'G', 'T']) AS base), (SELECT unnest(range(2, 47)) AS qual)) SELECT mate, CAST(cycle AS INT) AS cycle, CAST(qual AS INT) AS qual, base, CAST(least(93, coalesce(new_qual, qual)) AS INT) AS new_qual FROM gg LEFT JOIN t USING (mate, cycle, base, qual)")
def io_rescaler(spark: SparkSession, d: str) -> DataFrame:
    """The rescaler table written in its text form and read again."""
    path = scratch(spark, "rescaler")
    cube = cut(c._error_cube(spark, d), "cube")  # read twice below
    fasta.write_rescaler(errors.impute_quality(cube, min_obs=100), path)
    drop_cut(cube)
    return fasta.read_rescaler(spark, path)


@query("io_fasta", f"WITH p AS (SELECT unnest(['A', 'N', 'R']) AS contig), l AS (SELECT contig, unnest(range(0, {views.REF_LEN})) AS r FROM p) SELECT contig, 0 AS piece, string_agg(substring('ACGT', CAST({views._ref_index.format(r='r')} AS INT) + 1, 1), '' ORDER BY r) AS letters FROM l GROUP BY contig")
def io_fasta(spark: SparkSession, d: str) -> DataFrame:
    """The reference written as FASTA and read in pieces."""
    path = scratch(spark, "fasta")
    reference(spark).select(F.concat(F.lit(">"), F.col("contig"), F.lit(" x\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.text(path)
    return fasta.read_fasta_pieces(spark, path)
