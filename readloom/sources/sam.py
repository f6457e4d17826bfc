"""SAM text: scan with typed tags, header lines, and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.reports import write_header

#: Tags with a column of their own.
INT_TAGS, ARRAY_TAGS, TEXT_TAGS = ("FM", "FP", "RV", "DR", "NC", "NP", "SU", "MU", "LM"), ("FA", "PV"), ("SA",)


def _sam_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select("value", F.split("value", "\t").alias("f"))


def _record() -> Column:
    """Is the line a record: eleven fields at least, whole numbers where there must be?"""
    ok = F.size("f") >= 11
    for i in (1, 3, 4, 7, 8):
        ok = ok & F.get("f", F.lit(i)).try_cast("int").isNotNull()
    return ok


def _last_of_a_key(entries: Column) -> Column:
    """Tags of which only the last of a name is kept."""
    names = F.transform(entries, lambda e: e["col1"])
    return F.filter(entries, lambda e, i: F.array_position(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), e["col1"]) == 0)


def bad_sam_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of SAM files that are neither header nor record."""
    return _sam_lines(spark, path).where(~F.coalesce(_record(), F.lit(False))).select("value")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM files, position 0-based: the mandatory fields, known tags as columns, all others in ``aux``.

    '*' becomes null for contig, cigar, seq and qual; the mate's '=' becomes the contig. Lines that aren't records are left
    out; :func:`bad_sam_lines` lists them. A tag that isn't what its name says is null.
    """
    raw = _sam_lines(spark, path).where(_record()).select("f")
    g = lambda i: F.get("f", F.lit(i))
    star = lambda c: F.when(c != "*", c)
    tags = F.map_from_entries(_last_of_a_key(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t))))))
    return typed_tags(raw.select(
        g(0).alias("qname"), g(1).try_cast("int").alias("flag"), star(g(2)).alias("contig"), (g(3).try_cast("int") - 1).alias("pos"), g(4).try_cast("int").alias("mapq"), star(g(5)).alias("cigar"),
        F.when(g(6) == "=", g(2)).otherwise(star(g(6))).alias("mate_contig"), (g(7).try_cast("int") - 1).alias("mate_pos"), g(8).try_cast("int").alias("isize"), star(g(9)).alias("seq"), star(g(10)).alias("qual"),
        F.when(F.size("f") > 11, tags).otherwise(F.create_map().cast("map<string,string>")).alias("t"),
    ))


def typed_tags(p: DataFrame) -> DataFrame:
    """Records with their tags as a map ``t`` of texts: the known tags as columns of their types, all others in ``aux``."""
    tag = lambda n: F.col("t")[n]
    known = [*INT_TAGS, *ARRAY_TAGS, *TEXT_TAGS, "NF", "MF"]
    return p.select(
        *[c for c in p.columns if c != "t"],
        *[tag(n).try_cast("int").alias(n.lower()) for n in INT_TAGS],
        *[F.transform(F.split(F.regexp_replace(tag(n), r"^[a-zA-Z],", ""), ","), lambda x: x.try_cast("int")).alias(n.lower()) for n in ARRAY_TAGS],
        *[tag(n).alias(n.lower()) for n in TEXT_TAGS], tag("NF").try_cast("double").alias("nf"), tag("MF").try_cast("double").alias("mf"),
        F.map_filter("t", lambda k, v: ~k.isin(*known)).alias("aux"),
    )


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines: record type and text."""
    return spark.read.text(path).where(F.col("value").startswith("@")).select(F.substring("value", 2, 2).alias("type"), F.col("value").alias("line")).distinct()


def merged_header(spark: SparkSession, paths: list[str], *, program: str, command: str = "") -> list[str]:
    """The header of several SAM inputs together: @HD once, every sequence, read group and program once, and this program's line.

    A sequence, group or program of one name that differs between inputs is an error. Headers have a line a contig or group.
    """
    seen: dict[tuple[str, str], str] = {}
    first = "@HD\tVN:1.6\tSO:unknown"
    for path in paths:
        for r in read_header(spark, path).collect():
            fields = dict(x.split(":", 1) for x in r.line.split("\t")[1:] if ":" in x)
            if r.type == "HD":
                first = r.line
                continue
            key = (r.type, fields.get("SN") or fields.get("ID") or r.line)
            if seen.setdefault(key, r.line) != r.line:
                raise ValueError(f"the inputs differ in {key[0]} {key[1]}")
    last = [k[1] for k in seen if k[0] == "PG"][-1:]
    mine = f"@PG\tID:{program}\tPN:{program}" + "".join(f"\tPP:{x}" for x in last) + (f"\tCL:{command}" if command else "")
    order = {"SQ": 0, "RG": 1, "PG": 2, "CO": 3}
    return [first, *[seen[k] for k in sorted(seen, key=lambda k: order.get(k[0], 4))], mine]


def merge_alignments(inputs: list[DataFrame]) -> DataFrame:
    """Alignments of several inputs together; a column that one lacks is null there. Order is a matter of the sink."""
    out = inputs[0]
    for d in inputs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def write_sam(aln: DataFrame, path: str, *, header: list[str] = (), mode: str = "errorifexists") -> None:
    """Write alignments as SAM lines with all their tags.

    ``header`` (see :func:`merged_header`) goes to a file that sorts before all parts, so the parts in order are one SAM file.
    Tags of ``aux`` are written with the type that their text shows (whole number, number, else text).
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    have = set(aln.columns)
    tag = lambda t, kind, text: F.when(F.col(t.lower()).isNotNull(), F.concat(F.lit(f"{t}:{kind}:"), text))
    tags = [tag(t, "i", F.col(t.lower()).cast("string")) for t in INT_TAGS if t.lower() in have]
    tags += [tag(t, "B", F.concat(F.lit("I,"), F.array_join(t.lower(), ","))) for t in ARRAY_TAGS if t.lower() in have]
    tags += [tag(t, "Z", F.col(t.lower())) for t in TEXT_TAGS if t.lower() in have]
    tags += [tag(t, "f", F.col(t.lower()).cast("string")) for t in ("NF", "MF") if t.lower() in have]
    if "aux" in have:
        kind = lambda v: F.when(v.rlike(r"^[+-]?\d{1,9}$"), "i").when(v.rlike(r"^[+-]?\d*\.?\d+([eE][+-]?\d+)?$"), "f").when(v.rlike(r"^[cCsSiIf](,[+-]?[0-9.eE+-]+)+$"), "B").otherwise("Z")
        more = F.array_join(F.transform(F.array_sort(F.map_entries("aux")), lambda e: F.concat(e["key"], F.lit(":"), kind(e["value"]), F.lit(":"), e["value"])), "\t")
        tags.append(F.when(F.size("aux") > 0, more))
    num = lambda c, d: F.coalesce((F.col(c) + d).cast("string"), F.lit("0"))
    line = F.concat_ws("\t", s("qname"), num("flag", 0), s("contig"), num("pos", 1), num("mapq", 0), s("cigar"), F.when(F.col("mate_contig") == F.col("contig"), "=").otherwise(s("mate_contig")), num("mate_pos", 1), num("isize", 0), s("seq"), s("qual"), *tags)
    aln.select(line.alias("value")).write.mode(mode).text(path)
    write_header(aln.sparkSession, path, header)
