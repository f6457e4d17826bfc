from readloom.streaming.families import family_windows, paired_mates

SCHEMA = "read_id bigint, library_id int, qname string, mate int, barcode string, strand string, fp int, loaded_at timestamp"
ROWS = [
    (1, 1, "a", 1, "AC", "F", 1, "2023-01-01 00:10:00"), (1, 1, "a", 1, "AC", "F", 1, "2023-01-01 00:10:00"), (2, 1, "a", 2, "AC", "F", 1, "2023-01-01 00:20:00"),
    (3, 1, "b", 1, "AC", "R", 0, "2023-01-01 00:30:00"), (4, 1, "late", 1, "GG", "F", 1, "2023-06-01 00:00:00"),
]


def _source(spark, tmp_path):
    import datetime

    rows = [(*r[:7], datetime.datetime.fromisoformat(r[7])) for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_windows_equal_the_batch(spark, tmp_path):
    s = _source(spark, tmp_path)
    q = family_windows(s).writeStream.format("memory").queryName("fw").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.barcode, r.mate): (r.fm, r.rv, r.fp_failed) for r in spark.table("fw").collect()}
    assert got == {("AC", 1): (2, 1, 1), ("AC", 2): (1, 0, 0)}
    batch = {(r.barcode, r.mate): (r.fm, r.rv, r.fp_failed) for r in family_windows(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert batch == {**got, ("GG", 1): (1, 0, 0)}


def test_mates_meet(spark, tmp_path):
    s = _source(spark, tmp_path)
    q = paired_mates(s).writeStream.format("memory").queryName("pm").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("pm").collect()} == {("a", 1, 2)}
