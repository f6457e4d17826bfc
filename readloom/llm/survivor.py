"""Best representative of a group of duplicate records, chosen field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field to be survived.

    name: name of the result columns. sound: whether a record's value may be chosen. value: the normalised value for
    which votes are summed.
    """

    name: str
    sound: Column
    value: Column


def choose_survivors(
    records: DataFrame,
    keys: list[str],
    record_id: str,
    fields: list[Field],
    *,
    prefer: list[Column] = (),
    trust: Column | None = None,
    age_days: Column | None = None,
    half_life_days: float = 30.0,
    min_records: int = 2,
) -> DataFrame:
    """For each group of duplicates the surviving record of each field: ``keys``, ``<field>_id``, ``<field>_votes``.

    The fields are unpivoted to long rows (group, field, value, record); each row votes for its normalised value with
    ``trust * 2 ** (-age_days / half_life_days)``; the votes of a value are summed; the winner of a field is taken by
    ``max_by``, and the winners are pivoted back to one row a group. ``prefer`` is a strict order of the records behind a value that
    is compared before the votes (each expression ascending is better, null is worst); without it the votes alone decide.
    Ties go to the greater record id. The id names the best record (by ``prefer``, then vote, then id) that holds the winning value.

    Only ids, votes and 128-bit marks of the values travel: ``sound`` and ``value`` are evaluated where the record is
    read, so that large values are never shuffled; :func:`surviving_values` fetches those of the winners. All aggregates are partial on
    the map side, so a hot group is no hot task.

    Defined cases: groups with a null key are left out; a group with fewer than ``min_records`` different record ids is
    left out; a record delivered twice (same id) votes once; a field with no sound value has a null id and null votes;
    a null trust counts 0, a null age as infinitely old (vote 0), an age below 0 as 0; an empty input gives no row; other columns are ignored.
    """
    if not fields:
        raise ValueError("no fields")
    k = [f"_k{i}" for i in range(len(keys))]
    weight = F.coalesce(trust.cast("double") if trust is not None else F.lit(1.0), F.lit(0.0))
    if age_days is not None:
        weight = weight * F.coalesce(F.pow(F.lit(2.0), -F.greatest(age_days.cast("double"), F.lit(0.0)) / half_life_days), F.lit(0.0))
    rank = F.struct(*[e.alias(f"p{i}") for i, e in enumerate(prefer)], weight.alias("w"), F.col(record_id).alias("id"))
    mark = lambda v: F.struct(F.xxhash64(v).alias("a"), F.xxhash64(v, F.lit(7)).alias("b"))
    one = lambda f: F.when(F.coalesce(f.sound, F.lit(False)), mark(f.value))
    flat = records.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], rank.alias("_rank"), *[one(f).alias(f"_v{i}") for i, f in enumerate(fields)])
    for a in k:
        flat = flat.where(F.col(a).isNotNull())
    flat = flat.where(F.col("_rank.id").isNotNull())
    # unpivot; field -1 counts the records of the group, so that groups of one record can be left out at the end
    long = flat.select(
        *k, "_rank",
        F.explode(F.array(F.struct(F.lit(-1).alias("f"), mark(F.col("_rank.id")).alias("v")), *[F.struct(F.lit(i).alias("f"), F.col(f"_v{i}").alias("v")) for i in range(len(fields))])).alias("_x"),
    ).select(*k, "_rank", "_x.f", "_x.v.a", "_x.v.b").where("a is not null")
    # redelivered records vote once
    long = long.groupBy(*k, "f", "a", "b", F.col("_rank.id").alias("_id")).agg(F.max("_rank").alias("_rank"))
    votes = long.groupBy(*k, "f", "a", "b").agg(F.sum("_rank.w").alias("_votes"), F.max("_rank").alias("_rank"))
    order = F.struct(*[F.col(f"_rank.p{i}").alias(f"p{i}") for i in range(len(prefer))], F.col("_votes").alias("w"), F.col("_rank.id").alias("id"))
    at = lambda i: F.col("f") == i
    picked = votes.groupBy(*k).agg(
        F.sum(F.when(at(-1), 1).otherwise(0)).alias("_n"),
        *[F.max_by(F.struct(F.col("_rank.id").alias("id"), F.col("_votes").alias("v")), F.when(at(i), order)).alias(f"_w{i}") for i in range(len(fields))],
    )
    return picked.where(F.col("_n") >= min_records).select(
        *[F.col(a).alias(c) for c, a in zip(keys, k)],
        *[c for i, f in enumerate(fields) for c in (F.col(f"_w{i}.id").alias(f"{f.name}_id"), F.col(f"_w{i}.v").alias(f"{f.name}_votes"))],
    )


def surviving_values(records: DataFrame, survivors: DataFrame, keys: list[str], record_id: str, values: list[tuple[str, str]]) -> DataFrame:
    """The surviving record of each group, built of the winners' values: ``keys`` and the value columns.

    ``values``: (field, column of ``records``) pairs; ``survivors`` as :func:`choose_survivors` returns them. Only the records that a
    field survives from are fetched. A field without a sound value is null.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    want = survivors.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"{f}_id").alias("id")) for i, (f, _) in enumerate(values)])).alias("_x")).select(*k, "_x.f", "_x.id")
    held = records.select(F.col(record_id).alias("id"), *[F.col(c).alias(f"_v{i}") for i, (_, c) in enumerate(values)])
    got = want.join(held, "id", "left").groupBy(*k).agg(*[F.first(F.when(F.col("f") == i, F.col(f"_v{i}")), ignorenulls=True).alias(c) for i, (_, c) in enumerate(values)])
    return got.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], *[c for _, c in values])
