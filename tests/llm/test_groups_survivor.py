import random

from pyspark.sql import functions as F

from readloom.llm.groups import link_groups
from readloom.llm.survivor import Field, choose_survivors, surviving_values


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


def groups(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, v int, group string")
    return {tuple(r) for r in link_groups(df, "a", "b").collect()}


def test_chains_stars_cliques_and_dirt(spark):
    rng = random.Random(1)
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]  # a long chain
    pairs += [("hub", f"s{i}") for i in range(150)] + [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)]
    pairs += [("self", "self"), (None, "lost"), ("lost2", None), ("z", "y"), ("y", "z"), ("z", "y")]
    rng.shuffle(pairs)
    got = groups(spark, [(a, b, 1, "x") for a, b in pairs])
    assert got == union_find(pairs)
    left = []
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {tuple(r) for r in link_groups(df, "a", "b", report=left).collect()} == got
    assert left[0] == 200 + 150 + 15 + 1 and left[-1] == 0 and all(y <= x / 2 for x, y in zip(left, left[1:]))
    assert ("self", "self") in got and not any("lost" in m for m, _ in got)


def test_empty_and_only_loops(spark):
    assert groups(spark, []) == set()
    assert groups(spark, [("a", "a", 1, "")]) == {("a", "a")}


REC = "fam string, id int, q string, size int, at int, val array<int>, txt string, f int, _k0 int"


def test_priority_field_by_field(spark):
    rows = [
        ("A", 1, "1", 2, 5, [1], None, 0, 0), ("A", 2, "1", 2, 9, None, "x", 0, 0), ("A", 3, "0", 50, 99, [2], "y", 0, 0), ("A", 4, None, 99, 99, [3], "z", 0, 0),
        ("B", 5, "1", 2, 5, [1], "b", 0, 0), ("B", 5, "1", 2, 5, [1], "b", 0, 0),  # delivered twice: one record
        ("C", 6, "1", 2, 5, [1], None, 0, 0), ("C", 7, "1", 2, 5, [9], None, 0, 0), ("C", 8, "1", None, 5, [9], None, 0, 0),  # ties go to the greater id
        (None, 9, "1", 1, 1, [1], "n", 0, 0), (None, 10, "1", 1, 1, [1], "n", 0, 0),
    ]
    df = spark.createDataFrame(rows, REC)
    trust = F.when(F.col("q") == "1", 1.0).when(F.col("q") == "0", 0.5).otherwise(0.0)
    fields = [Field("val", F.col("val").isNotNull(), F.col("val")), Field("txt", F.col("txt") != "", F.col("txt"))]
    chosen = choose_survivors(df, ["fam"], "id", fields, prefer=[trust, F.col("size"), F.col("at")])
    got = {r.fam: (r.val_id, r.txt_id) for r in chosen.collect()}
    assert got == {"A": (1, 2), "C": (7, None)}
    built = {r.fam: (r.val, r.txt) for r in surviving_values(df, chosen, ["fam"], "id", [("val", "val"), ("txt", "txt")]).collect()}
    assert built == {"A": ([1], "x"), "C": ([9], None)}
    assert choose_survivors(df.where("false"), ["fam"], "id", fields).count() == 0


def test_votes_are_summed_per_value(spark):
    rows = [("A", 1, "1", 1, 0, None, "new", 0, 0), ("A", 2, "1", 1, 30, None, "old", 0, 0), ("A", 3, "1", 1, 30, None, "old", 0, 0), ("A", 4, "1", 1, 31, None, "old", 0, 0), ("A", 4, "1", 1, 31, None, "old", 0, 0), ("A", 5, None, 1, None, None, "none", 0, 0)]
    df = spark.createDataFrame(rows, REC)
    r = choose_survivors(df, ["fam"], "id", [Field("txt", F.col("txt").isNotNull(), F.col("txt"))], trust=F.when(F.col("q") == "1", 1.0), age_days=F.col("at"), half_life_days=30.0).first()
    assert r.txt_id == 3 and abs(r.txt_votes - (0.5 + 0.5 + 2 ** (-31 / 30))) < 1e-9
