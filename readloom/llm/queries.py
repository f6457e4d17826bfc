"""Queries of the training-data problems over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.groups import link_groups
from readloom.llm.mixing import mix_sources
from readloom.llm.near_dup import near_duplicates
from readloom.llm.percentiles import combine, exact_percentiles, summarise
from readloom.llm.survivor import Field, choose_survivors, surviving_values
from readloom.llm.tokens import encode_corpus, token_counts
from readloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from readloom.session import cut, table


def spelled(c: str) -> Column:
    """Barcodes and sequences in one spelling: upper case, without blanks around."""
    return F.upper(F.trim(F.col(c)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reads of one molecule: barcodes within 2 edits (as they are or rotated), 6-letter sets half alike."""
    reads = table(spark, sf_dir, "reads_marked")
    got = near_duplicates(reads, "read_id", ["library_id", "mate"], spelled("barcode"), F.upper("seq"))
    return got.select(F.col("id_a").alias("read_id_a"), F.col("id_b").alias("read_id_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every barcode of barcode_matches in its library."""
    m = table(spark, sf_dir, "barcode_matches")
    side = lambda c: F.when(F.col(c).isNotNull() & F.col("library_id").isNotNull(), F.struct(F.col("library_id").alias("l"), spelled(c).alias("b")))
    g = link_groups(m.select(side("barcode_a").alias("x"), side("barcode_b").alias("y")), "x", "y")
    return g.select(F.col("member.l").alias("library_id"), F.col("member.b").alias("barcode"), F.col("group.b").alias("group_barcode"))


#: Trust in a family's QC letter, worst to best; the statement of the problem ranks it before size and age.
QC_TRUST = {"0": 0.5, "1": 1.0}


#: The day from which the age of a record is counted.
AS_OF, HALF_LIFE_DAYS = "2024-01-01", 90.0


def _kingfisher(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> tuple[DataFrame, dict[str, Column], Column, Column]:
    """The records with their barcode spelled alike, soundness of the three value fields, trust and age in days."""
    k = table(spark, sf_dir, "kingfisher").withColumn("barcode", spelled("barcode"))
    want = F.col("readlen") * 5
    full = lambda c: (F.size(c) == want) & F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()) & ((F.array_max(c) != 0) | (F.array_min(c) != 0))
    sound = {
        "nuc_counts": full("nuc_counts"),
        "phred_sums": full("phred_sums"),
        "max_phreds": (F.length("max_phreds") == want) & F.col("max_phreds").rlike("[^#]"),
    }
    trust = F.when(F.col("pass_fail") == "1", QC_TRUST["1"]).when(F.col("pass_fail") == "0", QC_TRUST["0"]).otherwise(0.0)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("written_at")).cast("double")
    return k, sound, trust, age


def _survivors(spark: SparkSession, sf_dir: str, ranked: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    k, sound, trust, age = _kingfisher(spark, sf_dir)
    fields = [Field(n, c, F.col(n)) for n, c in sound.items()]
    prefer = [trust, F.col("fm"), F.col("written_at")] if ranked else []
    return k, choose_survivors(k, ["library_id", "barcode"], "kf_id", fields, prefer=prefer, trust=trust, age_days=age, half_life_days=HALF_LIFE_DAYS), list(sound)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record each field of a family survives from: trust of the QC letter, then size, then recency before the votes."""
    _, got, names = _survivors(spark, sf_dir, True)
    return got.select("library_id", "barcode", *[F.col(f"{n}_id").alias(f"{n}_kf") for n in names])


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each family, built field by field; arrays as text."""
    k, got, names = _survivors(spark, sf_dir, True)
    r = surviving_values(k, got, ["library_id", "barcode"], "kf_id", [(n, n) for n in names])
    return r.select("library_id", "barcode", F.array_join("nuc_counts", ",").alias("nuc_counts"), F.array_join("phred_sums", ",").alias("phred_sums"), "max_phreds")


def p2_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors by votes alone: trust times recency decay, summed per equal value of a field."""
    _, got, names = _survivors(spark, sf_dir, False)
    return got.select("library_id", "barcode", *[F.col(f"{n}_id").alias(f"{n}_kf") for n in names], *[F.round(f"{n}_votes", 6).alias(f"{n}_votes") for n in names])


PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
DEPTHS = ["raw_counts", "collapsed_counts", "singleton_counts"]


def _depth_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per counted value: library, contig, run day, field, value. A row delivered twice counts once.

    The arrays are made distinct by row and written once; the passes read them from there.
    """
    d = table(spark, sf_dir, "depth_aux").select("depth_id", "library_id", "contig", F.to_date("run_at").alias("run_day"), *DEPTHS)
    once = cut(d.dropDuplicates(["depth_id"]).drop("depth_id"), "depths")
    long = once.select("library_id", "contig", "run_day", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("a")) for c in DEPTHS])).alias("x"))
    return long.select("library_id", "contig", "run_day", "x.field", F.explode("x.a").alias("value"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the three depth fields per library and contig; the error is 0."""
    got = exact_percentiles(_depth_values(spark, sf_dir), ["library_id", "contig", "field"], "value", PERCENTILES)
    return got.select("library_id", "contig", "field", "q", "n", "value", F.lit(0).cast("bigint").alias("rank_error"))


def p5_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from summaries of single run days; the error is 0 too."""
    keys = ["library_id", "contig", "field"]
    days = cut(summarise(_depth_values(spark, sf_dir), keys, ["run_day"], "value"), "days")
    return combine(days, keys, PERCENTILES).select(*keys, "q", "n", "value", "rank_error")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every post by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    sized = token_counts(docs, ["doc_id", "source"], "text").withColumnRenamed("n_tokens", "size")
    return mix_sources(cut(sized, "sizes"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest selection of posts in which every source present holds its target share of the tokens."""
    return _mixed(spark, sf_dir)[0].select("doc_id", "source", F.col("size").alias("n_tokens"), "repeats")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that p7_mix reaches."""
    return _mixed(spark, sf_dir)[1].withColumnRenamed("available", "available_tokens").withColumnRenamed("taken", "taken_tokens")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of abuse, hate or sexual content for every post."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "doc_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts whose score reaches the threshold."""
    return p8_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and flagged posts per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    flagged = p8_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id", F.lit(1).alias("f"))
    n = F.count("*").alias("n_docs")
    bad = F.coalesce(F.sum("f"), F.lit(0)).alias("n_flagged")
    return docs.join(flagged, "doc_id", "left").groupBy("source").agg(n, bad).withColumn("rate", F.col("n_flagged") / F.col("n_docs"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p2_votes": p2_votes,
    "p3_found": p3_found,
    "p5_percentiles": p5_percentiles,
    "p5_combined_days": p5_combined_days,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

SQL = {
    "p2_found": """
WITH k AS (
  SELECT DISTINCT kf_id, library_id, upper(trim(barcode)) AS barcode, fm, written_at, nuc_counts, phred_sums, max_phreds,
    CASE pass_fail WHEN '1' THEN 1.0 WHEN '0' THEN 0.5 ELSE 0.0 END AS trust, datediff('day', CAST(written_at AS DATE), DATE '2024-01-01') AS age,
    len(nuc_counts) = 5 * readlen AND len(list_filter(nuc_counts, lambda x: x IS NULL)) = 0 AND (list_max(nuc_counts) <> 0 OR list_min(nuc_counts) <> 0) AS s0,
    len(phred_sums) = 5 * readlen AND len(list_filter(phred_sums, lambda x: x IS NULL)) = 0 AND (list_max(phred_sums) <> 0 OR list_min(phred_sums) <> 0) AS s1,
    length(max_phreds) = 5 * readlen AND trim(max_phreds, '#') <> '' AS s2
  FROM kingfisher WHERE library_id IS NOT NULL AND barcode IS NOT NULL
)
SELECT g.library_id, g.barcode, nuc_counts_kf, phred_sums_kf, max_phreds_kf
FROM (SELECT library_id, barcode FROM k GROUP BY ALL HAVING count(DISTINCT kf_id) > 1) g
LEFT JOIN (SELECT library_id, barcode, arg_max(kf_id, row(trust, coalesce(fm, -1), written_at, kf_id)) AS nuc_counts_kf FROM k WHERE s0 GROUP BY ALL) f0 USING (library_id, barcode)
LEFT JOIN (SELECT library_id, barcode, arg_max(kf_id, row(trust, coalesce(fm, -1), written_at, kf_id)) AS phred_sums_kf FROM k WHERE s1 GROUP BY ALL) f1 USING (library_id, barcode)
LEFT JOIN (SELECT library_id, barcode, arg_max(kf_id, row(trust, coalesce(fm, -1), written_at, kf_id)) AS max_phreds_kf FROM k WHERE s2 GROUP BY ALL) f2 USING (library_id, barcode)
""",
    "p2_votes": """
WITH k AS (
  SELECT DISTINCT kf_id, library_id, upper(trim(barcode)) AS barcode, fm, written_at, nuc_counts, phred_sums, max_phreds,
    CASE pass_fail WHEN '1' THEN 1.0 WHEN '0' THEN 0.5 ELSE 0.0 END AS trust, datediff('day', CAST(written_at AS DATE), DATE '2024-01-01') AS age,
    len(nuc_counts) = 5 * readlen AND len(list_filter(nuc_counts, lambda x: x IS NULL)) = 0 AND (list_max(nuc_counts) <> 0 OR list_min(nuc_counts) <> 0) AS s0,
    len(phred_sums) = 5 * readlen AND len(list_filter(phred_sums, lambda x: x IS NULL)) = 0 AND (list_max(phred_sums) <> 0 OR list_min(phred_sums) <> 0) AS s1,
    length(max_phreds) = 5 * readlen AND trim(max_phreds, '#') <> '' AS s2
  FROM kingfisher WHERE library_id IS NOT NULL AND barcode IS NOT NULL
)
SELECT g.library_id, g.barcode, nuc_counts_kf, phred_sums_kf, max_phreds_kf, nuc_counts_votes, phred_sums_votes, max_phreds_votes
FROM (SELECT library_id, barcode FROM k GROUP BY ALL HAVING count(DISTINCT kf_id) > 1) g
LEFT JOIN (SELECT library_id, barcode, arg_max(id, row(v, id)) AS nuc_counts_kf, round(max(v), 6) AS nuc_counts_votes FROM (
  SELECT library_id, barcode, nuc_counts, sum(w) AS v, arg_max(kf_id, row(w, kf_id)) AS id FROM (SELECT *, trust * power(2.0, -greatest(age, 0) / 90.0) AS w FROM k) WHERE s0 GROUP BY ALL) GROUP BY ALL) f0 USING (library_id, barcode)
LEFT JOIN (SELECT library_id, barcode, arg_max(id, row(v, id)) AS phred_sums_kf, round(max(v), 6) AS phred_sums_votes FROM (
  SELECT library_id, barcode, phred_sums, sum(w) AS v, arg_max(kf_id, row(w, kf_id)) AS id FROM (SELECT *, trust * power(2.0, -greatest(age, 0) / 90.0) AS w FROM k) WHERE s1 GROUP BY ALL) GROUP BY ALL) f1 USING (library_id, barcode)
LEFT JOIN (SELECT library_id, barcode, arg_max(id, row(v, id)) AS max_phreds_kf, round(max(v), 6) AS max_phreds_votes FROM (
  SELECT library_id, barcode, max_phreds, sum(w) AS v, arg_max(kf_id, row(w, kf_id)) AS id FROM (SELECT *, trust * power(2.0, -greatest(age, 0) / 90.0) AS w FROM k) WHERE s2 GROUP BY ALL) GROUP BY ALL) f2 USING (library_id, barcode)
""",
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT library_id, upper(trim(barcode_a)) AS a, upper(trim(barcode_b)) AS b FROM barcode_matches
  WHERE barcode_a IS NOT NULL AND barcode_b IS NOT NULL AND library_id IS NOT NULL
), u AS (SELECT library_id, a, b FROM e UNION SELECT library_id, b, a FROM e),
r AS (
  SELECT library_id, a AS barcode, a AS other FROM u
  UNION
  SELECT r.library_id, r.barcode, u.b FROM r JOIN u ON u.library_id = r.library_id AND u.a = r.other
)
SELECT library_id, barcode, min(other) AS group_barcode FROM r GROUP BY ALL
""",
    "p5_percentiles": """
WITH d AS (SELECT DISTINCT depth_id, library_id, contig, raw_counts, collapsed_counts, singleton_counts FROM depth_aux),
v AS (
  SELECT library_id, contig, 'raw_counts' AS field, unnest(raw_counts) AS value FROM d
  UNION ALL SELECT library_id, contig, 'collapsed_counts', unnest(collapsed_counts) FROM d
  UNION ALL SELECT library_id, contig, 'singleton_counts', unnest(singleton_counts) FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY library_id, contig, field ORDER BY value) AS k, count(*) OVER (PARTITION BY library_id, contig, field) AS n
  FROM v WHERE value IS NOT NULL AND library_id IS NOT NULL AND contig IS NOT NULL
)
SELECT library_id, contig, field, q, n, value, CAST(0 AS BIGINT) AS rank_error
FROM r, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q) WHERE k = greatest(1, ceil(q * n))
""",
}
SQL["p5_combined_days"] = SQL["p5_percentiles"]  # exact, however the values are spread over the days
_chosen = SQL["p2_found"].strip()
SQL["p2_records"] = f"""
SELECT f.library_id, f.barcode, array_to_string(a.nuc_counts, ',') AS nuc_counts, array_to_string(b.phred_sums, ',') AS phred_sums, c.max_phreds
FROM ({_chosen}) f LEFT JOIN (SELECT DISTINCT kf_id, nuc_counts FROM kingfisher) a ON a.kf_id = nuc_counts_kf
LEFT JOIN (SELECT DISTINCT kf_id, phred_sums FROM kingfisher) b ON b.kf_id = phred_sums_kf LEFT JOIN (SELECT DISTINCT kf_id, max_phreds FROM kingfisher) c ON c.kf_id = max_phreds_kf
"""
SQL["p1_found"] = """
WITH u AS (SELECT DISTINCT ON (read_id) read_id, library_id, mate, upper(trim(barcode)) AS b, upper(seq) AS s FROM reads_marked WHERE read_id IS NOT NULL AND library_id IS NOT NULL AND mate IS NOT NULL),
t AS (SELECT *, length(b) AS n, b[length(b) // 2 + 1 :] || b[: length(b) // 2] AS r FROM u WHERE length(b) > 0 AND length(s) >= 6),
d AS (SELECT library_id, mate, b, any_value(r) AS r, any_value(n) AS n FROM t GROUP BY ALL),
near AS (
  SELECT x.library_id, x.mate, x.b AS bx, y.b AS by FROM d x JOIN d y ON x.library_id = y.library_id AND x.mate = y.mate AND x.b <= y.b AND abs(x.n - y.n) <= 2
  WHERE levenshtein(x.b, y.b) <= 2 OR levenshtein(x.r, y.b) <= 2 OR levenshtein(x.b, y.r) <= 2
),
p AS (
  SELECT DISTINCT least(x.read_id, y.read_id) AS a, greatest(x.read_id, y.read_id) AS c FROM near q JOIN t x ON x.library_id = q.library_id AND x.mate = q.mate AND x.b = q.bx
  JOIN t y ON y.library_id = q.library_id AND y.mate = q.mate AND y.b = q.by WHERE x.read_id <> y.read_id
),
g AS (SELECT read_id, list_distinct([s[i : i + 5] for i in range(1, length(s) - 4)]) AS g FROM t),
w AS (SELECT a, c, x.g AS gx, y.g AS gy, len(list_intersect(x.g, y.g)) AS k FROM p JOIN g x ON x.read_id = a JOIN g y ON y.read_id = c)
SELECT a AS read_id_a, c AS read_id_b FROM w WHERE 2 * k >= len(gx) + len(gy) - k
"""
