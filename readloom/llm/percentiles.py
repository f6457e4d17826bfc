"""Exact percentiles of very large numeric columns by bisection of value intervals, and day-wise summaries that combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from readloom.session import cut, drop_cut

#: A pass places this many equally spaced midpoints in each interval at once: eight bisections.
MIDPOINTS = 256


def _numbers(df: DataFrame, value: str) -> tuple[Column, Column, Column]:
    """The column as bigint or double, the interval of the first pass that it falls in, and the way back for a number ``v``.

    Decimals of up to 18 digits are whole numbers of their last place. Doubles begin in intervals of one sign and power of
    two (found by comparison, so never wrong by rounding), within which equal steps narrow fast; NaN counts as null.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.col(value).cast("bigint"), F.lit(0), F.col("v").cast(kind)
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        unit = 10**kind.scale
        return (F.col(value) * F.lit(unit).cast("decimal(19,0)")).cast("bigint"), F.lit(0), (F.col("v").cast("decimal(19,0)") / F.lit(unit).cast("decimal(19,0)")).cast(kind)
    if isinstance(kind, (DoubleType, FloatType)):
        v = F.when(~F.isnan(value), F.col(value).cast("double"))
        size = F.abs(F.col("v"))
        guess = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))).cast("int")
        power = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when(size < F.pow(F.lit(2.0), guess), -1).otherwise(0)
        power = F.when(size == 0, 0).when(size == float("inf"), 3000).otherwise(power + 1500)
        return v, F.when(F.col("v") < 0, -power).otherwise(power).cast("int"), F.col("v").cast(kind)
    raise TypeError(f"percentiles of {kind.simpleString()} aren't defined")


def _weighted_percentiles(values: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Percentiles of a table (keys, v, c, e): value v, in first interval e, occurring c times. (keys, q, n, rank, v)."""
    ends = cut(values.groupBy(*keys, "e").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ends")
    by = Window.partitionBy(*keys)  # one row a power of two at most
    upto = ends.withColumn("n", F.sum("c").over(by)).withColumn("upto", F.sum("c").over(by.orderBy("lo")))
    each = upto.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("bigint"))
    state = cut(each.where("rank > upto - c and rank <= upto").select(*keys, "q", "n", "rank", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")), "intervals")
    drop_cut(ends)
    whole = dict(values.dtypes)["v"] == "bigint"
    step = F.expr(f"(hi div {MIDPOINTS} - lo div {MIDPOINTS}) + 1") if whole else F.col("hi") / MIDPOINTS - F.col("lo") / MIDPOINTS
    while True:
        open_ = state.where("lo < hi")
        if not open_.limit(1).count():
            return state.select(*keys, "q", "n", "rank", F.col("lo").alias("v"))
        # count the rows below the midpoints of each interval: the buckets between neighbouring midpoints, with their own ends;
        # a group's intervals are one row, as many as percentiles at most, each the same as another or apart from it
        iv = open_.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("lo", "hi", step.alias("w")))).alias("iv"))
        probe = cut(iv.select(*keys, *[F.get("iv", F.lit(i))[c].alias(f"{c}{i}") for i in range(len(qs)) for c in ("lo", "hi", "w")]), "probe")  # written, so that Spark knows its size

        def own(c: str) -> Column:
            out = F.lit(None)
            for i in range(len(qs) - 1, -1, -1):
                out = F.when((F.col("v") >= F.col(f"lo{i}")) & (F.col("v") <= F.col(f"hi{i}")), F.col(f"{c}{i}")).otherwise(out)
            return out

        met = values.join(probe, keys).select(*keys, "v", "c", *[own(c).alias(c) for c in ("lo", "hi", "w")]).where(F.col("lo").isNotNull())
        slot = F.expr("v div w - lo div w") if whole else F.least(F.lit(MIDPOINTS), F.floor(F.col("v") / F.col("w") - F.col("lo") / F.col("w")))
        # the greatest value has a slot of its own, so each pass narrows by one value at least whatever rounding does
        slot = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), 4 * MIDPOINTS).otherwise(slot)
        hits = met.groupBy(*keys, "lo", "hi", slot.alias("b")).agg(F.sum("c").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        order = Window.partitionBy(*keys, "lo", "hi").orderBy("b")  # at most MIDPOINTS + 3 rows
        cum = hits.withColumn("upto", F.sum("c").over(order)).withColumn("before", F.col("upto") - F.col("c")).select(*keys, "lo", "hi", "blo", "bhi", "upto", "before")
        moved = open_.join(cum, [*keys, "lo", "hi"]).where("rank - below > before and rank - below <= upto").select(
            *keys, "q", "n", "rank", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), (F.col("below") + F.col("before")).alias("below")
        )
        nxt = cut(state.where("lo = hi").unionByName(moved), "intervals")
        drop_cut(state)
        drop_cut(probe)
        state = nxt


def _present(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with a value and no null key: keys, all other columns but the value, v and e."""
    v, first, _ = _numbers(values, value)
    k = values
    for c in keys:
        k = k.where(F.col(c).isNotNull())
    return k.withColumn("v", v).where(F.col("v").isNotNull()).withColumn("e", first)


def exact_percentiles(values: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact percentiles per group: ``keys``, ``q``, ``n`` (values counted), ``rank``, ``value`` (the rank-th least value).

    rank = max(1, ceil(q * n)), so ``value`` is a value of the column and the error is 0. Value intervals are kept per
    group and percentile; each pass counts the rows below the midpoints of every interval straight from the column and
    keeps the part in which the rank falls, narrowed to the values that occur in it, until one value is left. ``values``
    is read once a pass, so it should be a scan or a written table. It meets one row of intervals a group, which Spark broadcasts if its
    written size allows (beyond, it joins by shuffle and splits hot groups); what is aggregated are at most 259 sums an
    interval and task, so a hot group or a continuous column costs no more. The number of passes is at most the bits of
    the value range over 8.

    Integers, decimals of up to 18 digits, floats and doubles. Nulls and NaN count for nothing; a group without values
    has no row; rows with a null key are left out; empty inputs give no row; other columns are ignored.
    """
    return _percentiles(values.select(*keys, value), keys, value, F.lit(1), qs)


def _percentiles(values: DataFrame, keys: list[str], value: str, count: Column, qs: list[float]) -> DataFrame:
    back = _numbers(values, value)[2]
    k = [f"_k{i}" for i in range(len(keys))]  # whatever the keys are called
    named = values.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(value).alias("_x"), count.cast("bigint").alias("c"))
    long = _present(named, k, "_x").select(*k, "v", "e", "c")
    got = _weighted_percentiles(long, k, qs)
    return got.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "q", "n", "rank", back.alias("value"))


def summarise(values: DataFrame, keys: list[str], part: list[str], value: str) -> DataFrame:
    """A summary of each part (say a day) of each group that combines with those of other parts.

    ``keys``, ``part``, ``value``, ``c``: how often each value occurs in the part. Nothing is rounded, so a combined percentile
    is exact however the values are spread over the parts; a part has as many rows as different values, not a fixed number.
    Null parts (rows without a day) are a part of their own; null keys are left out as in :func:`exact_percentiles`.
    """
    v = _numbers(values, value)[0]
    known = values.select(*keys, *part, value).where(v.isNotNull())
    for c in keys:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*keys, *part, value).agg(F.count("*").alias("c"))


def combine(summaries: DataFrame, keys: list[str], qs: list[float], *, value: str = "value") -> DataFrame:
    """Percentiles over the parts of a summary: ``keys``, ``q``, ``n``, ``rank``, ``value``, ``rank_error``.

    ``value`` is the rank-th least of all values, as in :func:`exact_percentiles`; ``rank_error`` is 0. The summaries are
    read once a pass and best lie in a table.
    """
    return _percentiles(summaries.select(*keys, value, "c"), keys, value, F.col("c"), qs).withColumn("rank_error", F.lit(0).cast("bigint"))
