"""Report sinks: tab-separated text of small report tables, and tables with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.intervals import overlaps, pad_regions


def write_tsv(report: DataFrame, path: str, *, decimals: int = 12, order: list[str] = (), mode: str = "errorifexists") -> None:
    """A report as tab-separated text with a header; doubles with a fixed number of decimals, null as empty text."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in report.dtypes]
    out = report.select(*[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(report.columns, cols)])
    (out.orderBy(*order) if order else out).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_alignments(aln: DataFrame, path: str, *, program: str, mode: str = "errorifexists") -> None:
    """Alignments as Parquet by contig, sorted by position inside each file so that ranges prune row groups; the program that made them beside."""
    aln.withColumn("program", F.lit(program)).repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.mode(mode).partitionBy("contig").parquet(path)


#: Regions whose bounds are pushed to the scan one by one; more are pushed as one range a contig.
PUSHED = 200


def read_regions(spark: SparkSession, path: str, regions: DataFrame, *, padding: int = 0) -> DataFrame:
    """Alignments of :func:`write_alignments` that overlap a region, read by region: other contigs, files and row groups aren't touched.

    The bounds of the regions (or, of many, the range of each contig) become predicates of the scan, which prune contigs by
    folder and row groups by the statistics of pos and endpos; the exact test is the overlap semi-join on what is left.
    """
    r = pad_regions(regions, padding).select("contig", "start_pos", "end_pos")
    bounds = r.limit(PUSHED + 1).collect()
    if len(bounds) > PUSHED:
        bounds = r.groupBy("contig").agg(F.min("start_pos"), F.max("end_pos")).collect()  # one row a contig
    near = F.lit(False)
    for contig, start, end in bounds:
        near = near | ((F.col("contig") == contig) & (F.col("pos") < end) & (F.col("endpos") > start))
    return overlaps(spark.read.parquet(path).where(near), r)


def write_header(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write header lines to a file of the folder that sorts before its parts; nothing without lines."""
    if not lines:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/00-header")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    finally:
        out.close()


def write_split(aln: DataFrame, passed, path: str, *, mode: str = "errorifexists") -> None:
    """Passing and refused records in one pass: Parquet partitioned by ``passed``."""
    aln.withColumn("passed", F.coalesce(passed, F.lit(False))).write.mode(mode).partitionBy("passed").parquet(path)
