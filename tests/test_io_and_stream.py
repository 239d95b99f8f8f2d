"""Readers, sinks and the streamed replay."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators import simulate
from chronoweave.sources import readers, sinks
from chronoweave.streaming.replay import daily_volume, replay_stream

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_csv_contracts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    (tmp_path / "bad.csv").write_text("a,b\nz,x\n")
    assert [r.a for r in readers.csv_scan(spark, str(tmp_path / "x.csv"), SCHEMA, ["a"]).collect()] == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.csv_scan(spark, str(tmp_path / "bad.csv"), SCHEMA).collect()
    got = readers.csv_tolerant(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [("1", "x", ""), ("2", "", "")]
    df = spark.createDataFrame([(1, "x")], SCHEMA)
    with pytest.raises(ValueError, match="missing.*forbidden"):
        readers.require_columns(df, {"z"}, {"b"})
    digests = {r.name: r.sha256 for r in readers.fingerprints(spark, str(tmp_path), "*.csv").collect()}
    assert digests["x.csv"] == hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()
    prints = {r.name: r.size for r in readers.fingerprints(spark, str(tmp_path), "*.csv").collect()}
    assert prints == {"x.csv": 11, "bad.csv": 8}
    assert sum(r.hits for r in readers.lines_with(spark, str(tmp_path), "X").collect()) == 2
    with pytest.raises(ValueError):
        readers.strict_json('{"a": 1, "a": 2}')


def test_sinks(spark, tmp_path):
    sinks.write_json(spark, str(tmp_path / "p.json"), {"b": 0, "a": 0})
    sinks.write_json(spark, str(tmp_path / "p.json"), {"b": 1, "a": 2})
    with pytest.raises(ZeroDivisionError):
        sinks.write_built(spark, str(tmp_path / "p.json"), lambda: {"a": 1 / 0})
    assert (tmp_path / "p.json").read_text() == '{"a": 2, "b": 1}'
    sinks.write_both(spark, str(tmp_path / "g.json"), str(tmp_path / "q.json"), {"x": None})
    assert (tmp_path / "g.json").read_text() == (tmp_path / "q.json").read_text() == '{"x": null}'
    assert not list(tmp_path.glob("*.tmp"))
    df = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x")], SCHEMA)
    assert sinks.objects(df, ["b", "a"]).count() == 2
    chunked = sinks.chunks(spark.range(10).withColumnRenamed("id", "k"), "k", 4)
    assert sorted(tuple(r) for r in sinks.chunk_index(chunked, "k").collect()) == [(0, 4, 0, 3), (1, 4, 4, 7), (2, 2, 8, 9)]
    old, new = (spark.createDataFrame(x, "id long, sha256 string") for x in ([(1, "p")], [(1, "p"), (2, "q")]))
    assert sinks.upsert(old, new).count() == 2
    with pytest.raises(Exception, match="conflicting content"):
        sinks.upsert(old, spark.createDataFrame([(1, "z")], "id long, sha256 string")).collect()
    sinks.publish({"t": df}, str(tmp_path), "v1")
    said = json.loads((tmp_path / "current.json").read_text())
    assert said["version"] == "v1" and said["tables"]["t"]["rows"] == 3
    assert sinks.republish(spark, str(tmp_path), str(tmp_path / "board")) == "v1"
    assert json.loads((tmp_path / "board/current.json").read_text()) == said
    with pytest.raises(ValueError, match="over its cap"):
        sinks.republish(spark, str(tmp_path), str(tmp_path / "capped"), {"t": 2})
    df.limit(1).write.mode("append").parquet(str(tmp_path / "v1/t"))
    with pytest.raises(ValueError, match="not what its pointer says"):
        sinks.republish(spark, str(tmp_path), str(tmp_path / "other"))
    assert not (tmp_path / "capped").exists() and not (tmp_path / "other").exists()
    assert sinks.dashboard({"t": df}) == {"t": [{"a": 1, "b": "x"}, {"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}


def test_checkpoints(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25)], "event_id long, score double")
    root = str(tmp_path / "cp")
    name = sinks.write_checkpoint(scores, {"m": {"w": [[1.0, 2.0]]}}, {"seed": 0}, root)
    assert name == sinks.write_checkpoint(scores.orderBy("score"), {"m": {"w": [[1.0, 2.0]]}}, {"seed": 0}, root)
    assert name != sinks.write_checkpoint(scores, {"m": {"w": [[1.0, 2.5]]}}, {"seed": 0}, root)
    back, models, metadata = sinks.read_checkpoint(spark, root, name)
    assert sorted(map(tuple, back.collect())) == [(1, 0.5), (2, 0.25)] and models == {"m": {"w": [[1.0, 2.0]]}} and metadata == {"seed": 0}
    sinks.write_json(spark, f"{root}/{name}/models/m.json", {"w": [[9.0]]})
    with pytest.raises(ValueError, match="model m"):
        sinks.read_checkpoint(spark, root, name)


def test_scans_of_ids_and_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n1,y\n")
    path = str(tmp_path / "x.csv")
    assert sorted(r.b for r in readers.id_column(spark, path, "b").collect()) == ["x", "y"]
    assert [r.a for r in readers.id_column(spark, path, "a", spark.createDataFrame([("2",), ("7",)], "a string")).collect()] == ["2"]
    spark.range(2).write.parquet(str(tmp_path / "second"))
    assert readers.first_of(spark, str(tmp_path / "first"), str(tmp_path / "second")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_of(spark, str(tmp_path / "first"))
    records = spark.createDataFrame([("node", "b"), ("node", "a"), ("edge", "c")], "record_type string, canonical_id string")
    members = spark.createDataFrame([("k1", "node", "a"), ("k1", "node", "b"), ("k2", "node", "a"), ("k2", "edge", "c")], "community_key string, record_type string, canonical_id string")
    got = readers.active_records(records, members, spark.createDataFrame([("k1",)], "community_key string"))
    assert [r["canonical_id"] for r in got] == ["a", "b"]


def test_streamed_replay_equals_the_batch(spark, tmp_path):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(i, i, f"p{i * 7 % 5}", days[i % 3], i % 3 != 1, (i * 37 % 11) / 11) for i in range(30)]
    pool = spark.createDataFrame(rows, "row_ix long, event_id long, identity string, day timestamp, hidden boolean, s double")
    for i, day in enumerate(days):
        pool.where(F.col("day") == day).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/d{i}"))
    source = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    caught = spark.createDataFrame([("p1", days[0] + dt.timedelta(hours=5)), ("p3", days[2])], "identity string, caught_time timestamp")
    q = replay_stream(source, ("s",), (3,), caught).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.day: (r.inspected, r.found) for r in spark.table("replayed").collect()}
    inspections, found, _ = simulate.replay(pool, caught, ("s",), (3,))
    spent = {r.day: r["count"] for r in inspections.groupBy("day").count().collect()}
    hits = {r.found_day: r["count"] for r in found.groupBy("found_day").count().collect()}
    assert got == {d: (spent.get(d, 0), hits.get(d, 0)) for d in got} and set(got) == set(days)
    assert daily_volume(source.withColumnRenamed("day", "t")).isStreaming
