import random

from pyspark.sql import functions as F

from readloom.operators.spans import spans_and_gaps, unpack_intervals


def brute(rows):
    out = []
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, iv in by.items():
        iv.sort()
        merged = [list(iv[0])]
        for s, e in iv[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "span", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


def test_random_against_brute_force_over_bin_borders(spark):
    rng = random.Random(3)
    rows = []
    for k in ("a", "b", None):
        for _ in range(150):
            s = rng.randrange(0, 3000)
            rows.append((k, s, s + rng.choice([-3, 0, 1, 2, 5, 40, 700])))
    rows += [("a", None, 5), ("a", 5, None), ("void", 7, 7), *rows[:20]]
    df = spark.createDataFrame(rows, "contig string, s bigint, e bigint")
    for bits in (3, 7, 18):
        got = [tuple(r) for r in spans_and_gaps(df, ["contig"], "s", "e", bin_bits=bits).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "panel int, _s string, kind string, start_pos bigint, end_pos bigint")
    assert spans_and_gaps(df, ["panel"]).count() == 0
    one = spark.createDataFrame([(1, "x", "y", 2, 9), (1, "x", "y", 9, 11)], df.schema)
    assert [tuple(r) for r in spans_and_gaps(one, ["panel"]).collect()] == [(1, "span", 2, 11)]


def test_unpack_null_and_large(spark):
    df = spark.createDataFrame([(1, [(7 << 32) + 9, None, (1 << 61) + 3]), (2, None), (3, [])], "k int, a array<bigint>")
    assert sorted(map(tuple, unpack_intervals(df, "a", "k").collect())) == [(1, 7, 9), (1, 1 << 29, 3)]
    assert unpack_intervals(df, "a", "k").where(F.col("k") > 1).count() == 0
