"""VCF text: scan to one row a variant, and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.reports import write_header


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (0-based), id, alleles (reference first), qual, filter, info (flags have an empty value), format, samples."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    dot = lambda c: F.when(c != ".", c)
    info = F.when(g(7).isNull() | (g(7) == "."), F.create_map().cast("map<string,string>")).otherwise(F.transform_values(F.str_to_map(g(7), F.lit(";"), F.lit("=")), lambda k, v: F.coalesce(v, F.lit(""))))
    alts = F.when((g(4) == ".") | g(4).isNull(), F.array().cast("array<string>")).otherwise(F.split(g(4), ","))
    return raw.select(g(0).alias("contig"), (g(1).try_cast("int") - 1).alias("pos"), dot(g(2)).alias("id"), F.concat(F.array(g(3)), alts).alias("alleles"), F.expr("try_cast(get(f, 5) as double)").alias("qual"), dot(g(6)).alias("filter"), info.alias("info"), g(8).alias("format"), F.when(F.size("f") > 9, F.slice("f", F.lit(10), F.size("f"))).otherwise(F.array().cast("array<string>")).alias("samples"))


#: Fields of the records that this package writes, with number and type as the header names them (fixed values of the format).
FIELDS = {
    "pass": ("INFO", "R", "Integer", "1 if the allele passes the thresholds"), "n_pass": ("FORMAT", "R", "Integer", "unique observations that pass"), "n_failed": ("FORMAT", "R", "Integer", "unique observations that fail"),
    "n_duplex": ("FORMAT", "R", "Integer", "duplex observations"), "n_overlap": ("FORMAT", "R", "Integer", "overlapping mates"), "quantity": ("FORMAT", "R", "Integer", "estimated quantity"), "qss": ("FORMAT", "R", "Integer", "sum of qualities"),
    "allele_fraction": ("FORMAT", "R", "Float", "share of the observations"), "reverse_fraction": ("FORMAT", "R", "Float", "share on the reverse strand"), "ambig": ("FORMAT", "1", "Integer", "observations of N"), "depth": ("FORMAT", "1", "Integer", "observations"),
}


def vcf_header(fields: list[str], samples: list[str], *, contigs: list[tuple[str, int]] = (), program: str = "readloom") -> list[str]:
    """Header lines of a VCF file: version, program, contigs, the fields (names of FIELDS) and the column line."""
    lines = ["##fileformat=VCFv4.2", f"##source={program}", *[f"##contig=<ID={c},length={n}>" for c, n in contigs]]
    for f in fields:
        kind, number, type_, text = FIELDS[f]
        lines.append(f'##{kind}=<ID={f.upper()},Number={number},Type={type_},Description="{text}">')
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]


def variant_records(calls: DataFrame, sample: str | None = None, *, fields: tuple[str, ...] = ("n_pass", "n_failed", "n_duplex", "n_overlap", "quantity", "qss", "allele_fraction")) -> DataFrame:
    """Allele counts (with is_ref and allele_order, see ``pileup.allele_counts``) as VCF records: contig, pos, alleles, info, format, samples.

    One record a position, the reference's letter first ('N' where it wasn't seen), one column a sample in the order of
    their names; an allele that a sample lacks has 0. A position has few letters and samples.
    """
    c = calls.withColumn("_s", F.col(sample) if sample else F.lit("Sample"))
    own = c.groupBy("contig", "ref_pos", "base").agg(F.max("is_ref").alias("is_ref"), F.max(F.col("pass").cast("int")).alias("ok"), F.map_from_entries(F.collect_list(F.struct("_s", F.struct(*fields)))).alias("by"))
    names = sorted(r[0] for r in c.select("_s").distinct().collect())  # one name a sample
    order = lambda x, y: F.when(x["o"] != y["o"], F.when(x["o"], 1).otherwise(-1)).when(x["base"] < y["base"], -1).when(x["base"] > y["base"], 1).otherwise(0)
    g = own.groupBy("contig", "ref_pos").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_ref")).alias("o"), "base", "ok", "by")), order).alias("_a"))
    g = g.withColumn("_a", F.when(F.get("_a", F.lit(0))["o"], F.concat(F.array(F.struct(F.lit(False).alias("o"), F.lit("N").alias("base"), F.lit(0).alias("ok"), F.lit(None).cast(own.schema["by"].dataType).alias("by"))), F.col("_a"))).otherwise(F.col("_a")))
    text = lambda x, f: F.when(x[f].isNotNull(), F.format_string("%.6f", x[f]) if dict(calls.dtypes)[f] == "double" else x[f].cast("string")).otherwise("0")
    cell = lambda n, f: F.array_join(F.transform("_a", lambda a: text(F.try_element_at(a["by"], F.lit(n)), f)), ",")
    return g.select(
        "contig", F.col("ref_pos").alias("pos"), F.transform("_a", lambda a: a["base"]).alias("alleles"), F.create_map(F.lit("PASS"), F.array_join(F.transform("_a", lambda a: a["ok"].cast("string")), ",")).alias("info"),
        F.lit(":".join(f.upper() for f in fields)).alias("format"), F.array(*[F.concat_ws(":", *[cell(n, f) for f in fields]) for n in names]).alias("samples"),
    )


def write_vcf(variants: DataFrame, path: str, *, header: list[str] = (), mode: str = "errorifexists") -> None:
    """Write contig, pos, alleles, an ``info`` map and, where present, format and samples as VCF lines by position.

    ``header`` (see :func:`vcf_header`) goes to a file that sorts before all parts, so the parts in order are one VCF file.
    """
    info = F.when(F.size("info") > 0, F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")).otherwise(".")
    alts = F.when(F.size("alleles") > 1, F.array_join(F.slice("alleles", F.lit(2), F.size("alleles")), ",")).otherwise(".")
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(".")) if n in variants.columns else F.lit(".")
    more = [F.col("format"), F.when(F.size("samples") > 0, F.array_join("samples", "\t"))] if {"format", "samples"} <= set(variants.columns) else []
    line = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), c("id"), F.element_at("alleles", 1), alts, c("qual"), c("filter"), info, *more)
    variants.orderBy("contig", "pos").select(line.alias("value")).write.mode(mode).text(path)
    write_header(variants.sparkSession, path, header)


def passing(variants: DataFrame, info_key: str) -> DataFrame:
    """Variants of which any other than the reference allele has a 1 in the array ``info[info_key]`` (one value an allele, reference first)."""
    f = F.split(F.col("info")[info_key], ",")
    return variants.where(F.exists(F.slice(f, F.lit(2), F.greatest(F.size(f), F.lit(1))), lambda x: x == "1"))


def allele_table(variants: DataFrame, key: str, *, sample: int = 0) -> DataFrame:
    """One row an allele: contig, pos, allele, allele_index, value: the FORMAT array ``key`` of a sample beside its alleles; null where absent."""
    at = F.array_position(F.split("format", ":"), key)
    cell = F.when(at > 0, F.get(F.split(F.get("samples", F.lit(sample)), ":"), (at - 1).cast("int")))
    v = variants.select("contig", "pos", F.posexplode("alleles").alias("allele_index", "allele"), F.split(cell, ",").alias("_v"))
    return v.select("contig", "pos", "allele", "allele_index", F.get("_v", F.col("allele_index")).try_cast("double").alias("value"))
