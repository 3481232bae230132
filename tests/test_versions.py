"""Sets of tables that change at once, and tables kept up by batches."""

import pytest
from pyspark.sql import functions as F

from tamarack.sources.versions import MergedRuns, TableSet
from tamarack.streaming import ratings as stream


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_reader_between_two_steps_sees_the_old_set_whole(spark, tmp_path, monkeypatch):
    tables = TableSet(spark, str(tmp_path))
    tables.write({"a": table(spark, 1), "b": table(spark, 2)})
    old = tables.read("a")
    seen = []
    stage = TableSet.stage

    def watched(self, df, name):
        path = stage(self, df, name)
        reader = TableSet(spark, str(tmp_path))
        seen.append((values(reader.read("a")), values(reader.read("b"))))
        return path

    monkeypatch.setattr(TableSet, "stage", watched)
    tables.write({"a": tables.read("a").union(table(spark, 10)), "b": table(spark)})
    assert seen == [([1], [2])] * 2
    assert values(tables.read("a")) == [1, 10] and values(tables.read("b")) == [] and tables.names() == ["a", "b"]
    assert values(old) == [1] and values(tables.read("b", 1)) == [2]
    tables.prune(1)
    assert values(tables.read("a")) == [1, 10] and tables.numbers() == [2]
    with pytest.raises(FileNotFoundError):
        tables.read("c")


def test_a_failed_write_leaves_the_set_as_it_was(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    tables.write({"a": table(spark, 1)})
    with pytest.raises(Exception):
        tables.write({"a": table(spark, 2), "b": table(spark, 3).select(F.raise_error(F.lit("no")).alias("v"))})
    assert values(tables.read("a")) == [1] and tables.names() == ["a"]
    late = tables.state()
    tables.write({"a": table(spark, 5)})
    with pytest.raises(RuntimeError):
        tables.publish({"a": {"": "data/none"}}, None, late)


def test_slices(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    tables.replace_slice("board", "ml", table(spark, 1, 2))
    tables.replace_slice("board", "lb", table(spark, 7))
    tables.replace_slice("board", "ml", table(spark, 3))
    assert values(tables.read("board")) == [3, 7] and values(tables.read("board", 2)) == [1, 2, 7]


def test_runs_grow_and_are_merged(spark, tmp_path):
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    runs = MergedRuns(spark, str(tmp_path), merge)
    want = {}
    for batch in range(9):
        rows = [(k % (5 + 40 * (batch == 0)), 1) for k in range(batch, batch + (100 if batch == 0 else 4))]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(2):  # a batch that comes again counts once
            runs.add(spark.createDataFrame(rows, "k int, n long"), batch)
        sizes = runs.runs()
        assert all(a >= runs.GROWTH * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert {r.k: r.n for r in runs.read().collect()} == want
    assert len(runs.runs()) > 1 and runs.runs()[0] == 45  # the large run was not written again for small batches


def test_streams_follow_their_batches(spark, tmp_path):
    def arrive(rows, name):
        spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        for f, out in ((stream.keep_latest, "latest"), (stream.live_scores, "live")):
            f(stream.incoming(spark, str(tmp_path / "in"), 1), str(tmp_path / out), str(tmp_path / f"{out}-state")).awaitTermination()

    arrive([(u, u % 7, 3.0, 1) for u in range(50)], "a")
    run()
    arrive([(1, 1, 5.0, 0), (2, 2, 1.0, 9), (3, 3, 9.0, 9)], "b")
    arrive([(None, 2, 1.0, 9), (2, 2, 4.5, 9)], "c")
    run()
    latest = {(r.userId, r.movieId): r.rating for r in stream.latest_table(spark, str(tmp_path / "latest")).read().collect()}
    assert len(latest) == 50 and latest[1, 1] == 3.0 and latest[2, 2] == 4.5 and latest[3, 3] == 3.0
    live = {r.movieId: (r.mean, r.n) for r in stream.live_table(spark, str(tmp_path / "live")).collect()}
    assert live[2] == ((7 * 3.0 + 1.0 + 4.5) / 9, 9) and live[1] == ((7 * 3.0 + 5.0) / 8, 8) and live[3][1] == 7
    assert stream.latest_table(spark, str(tmp_path / "latest")).runs()[0] == 50
