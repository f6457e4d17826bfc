import datetime

from readloom.plans import views


def test_letters_from_tables_are_those_of_the_expressions(spark, tmp_path, monkeypatch):
    day = lambda n: datetime.datetime(1992, 1, 1) + datetime.timedelta(days=n)
    rows = [(o, 1 + o % 8, 7 * o + o % 11, 5 * o + o % 7, float(1 + o * 7 % 52), 0.05, day(o * 3 % 40)) for o in range(700)]
    rows += [(-3, 2, 5, 6, 30.0, 0.1, day(9)), (1 << 40, 3, 3, 4, 50.0, 0.1, day(2500))]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = lambda: sorted(tuple(map(str, r)) for r in views.alignments(spark, str(tmp_path)).select("read_id", "seq", "qual", "fa", "pv").collect())
    fast = got()
    plan = views.alignments(spark, str(tmp_path)).where(views._TABLED)
    assert 400 < plan.count() < len(rows) and "overlay" in plan._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(views, "_TABLED", "false")
    assert got() == fast
