"""OrphanStream over restarts of the driver and repeated batches."""

from orefold.streaming.orphans import OrphanStream

TABLES = ("edges", "metrics")
ROWS = "id string, period int, bits int, gone int"


def test_a_new_object_goes_on_from_the_folder(spark, rows, tmp_path):
    src, folder, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    for data in ([("x", 1, 1, 0), ("y", 1, 2, 0)], [("x", 1, 2, 0), ("z", 2, 4, 0)]):
        spark.createDataFrame(data, ROWS).coalesce(1).write.mode("append").parquet(src)
        OrphanStream(spark, folder, TABLES).start(spark.readStream.schema(ROWS).parquet(src), check).awaitTermination()
    want = [("edges", 1, "y", "unknown"), ("metrics", 2, "z", "unknown")]  # x is declared since before the restart
    assert rows(OrphanStream(spark, folder, TABLES).open_references()) == want
    assert OrphanStream(spark, str(tmp_path / "none"), TABLES).open_references().collect() == []


def test_a_repeated_batch_and_an_incomplete_state(spark, rows, tmp_path):
    stream = OrphanStream(spark, str(tmp_path / "state"), TABLES)
    stream._batch(spark.createDataFrame([("x", 1, 2, 0)], ROWS), 0)
    again = spark.createDataFrame([("x", 1, 0, 1), ("y", 1, 2, 0)], ROWS)
    for _ in range(2):  # the second time state-1 is there already
        stream._batch(again, 1)
        assert rows(stream.open_references()) == [("edges", 1, "x", "unknown"), ("edges", 1, "y", "unknown")]
    (tmp_path / "state" / "state-2").mkdir()  # without _SUCCESS
    late = OrphanStream(spark, str(tmp_path / "state"), TABLES)
    late._batch(spark.createDataFrame([("x", 1, 1, 0)], ROWS), 3)
    assert rows(late.open_references()) == [("edges", 1, "y", "unknown")]
    kept = {p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("state-") and (p / "_SUCCESS").exists()}
    assert kept == {"state-1", "state-3"}  # what a repeated batch needs, and no more
