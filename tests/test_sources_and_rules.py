"""Connectors beyond Parquet, schema comparison, streaming runs, as-of joins, and the rules of stage graphs."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomspark.operators.joins import BROADCAST_BYTES, as_of, smaller
from loomspark.plans.compile import compile_sql, graph_dataframe
from loomspark.plans.model import BucketingPolicy, Exchange, Sink, Source, Stage, StageGraph, StageInput
from loomspark.sources import get_sink, get_source
from loomspark.sources.connectors import ParquetSource, snapshot_runs
from loomspark.sources.view import tree, union
from loomspark.streaming import stream_runs

ROWS = [("x", 1), ("y", 2), (None, 3), ("x", None)]
SCHEMA = "k string, v bigint"
t = Source("t", "t", "memory", {"rows": ROWS, "schema": SCHEMA})
u = Source("u", "u", "memory", {"rows": [("x", "a"), (None, "b")], "schema": "k string, w string"})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_folder_of_two_schemas_is_refused(spark, tmp_path):
    spark.createDataFrame([(1,)], "id bigint").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("x",)], "other string").write.mode("append").parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="different schemas"):
        ParquetSource([str(tmp_path / "a")]).read(spark)
    spark.createDataFrame([(i,) for i in range(9)], "id bigint").repartition(3).write.parquet(str(tmp_path / "b"))
    assert ParquetSource([str(tmp_path / "b")]).read(spark).count() == 9


def test_zero_row_partitions(spark, tmp_path):
    for i, part in enumerate(([("a", 10), ("b", 20)], [], [("a", 30), ("c", 40)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    q = compile_sql(spark, "SELECT k, SUM(v) AS s FROM p GROUP BY k", [Source("p", "p", "parquet", {"uris": [str(tmp_path / "p")]})])
    assert rows(q.dataframe()) == [("a", 40), ("b", 20), ("c", 40)]


@pytest.mark.parametrize("kind", ["csv", "json", "orc"])
def test_text_and_orc_sources(spark, tmp_path, kind):
    out = str(tmp_path / kind)
    spark.createDataFrame(ROWS, SCHEMA).write.format(kind).save(out)
    source = get_source(kind)([out], schema=SCHEMA)
    assert rows(source.read(spark)) == sorted(ROWS, key=repr)
    assert source.estimate_rows(spark) is None and source.estimate_bytes(spark) > 0


class _Lines(DataSource):
    @classmethod
    def name(cls):
        return "loom_lines"

    def writer(self, schema, overwrite):
        return _LineWriter(self.options["folder"])


class _LineWriter(DataSourceWriter):
    def __init__(self, folder):
        self.folder = folder

    def write(self, iterator):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{r[0]}\n" for r in iterator)
        return WriterCommitMessage()


def test_custom_sink(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module
    out = get_sink("python")(_Lines, folder=str(tmp_path)).write(spark.createDataFrame(ROWS, SCHEMA), "r")
    found = [x.strip() for f in os.listdir(tmp_path) for x in open(f"{tmp_path}/{f}")]
    assert out["rows"] == 4 and sorted(found) == ["None", "x", "x", "y"]


def test_runs_that_end_together_both_count(spark, tmp_path):
    base = str(tmp_path / "s")
    sink = get_sink("snapshot")(base)
    df = spark.createDataFrame(ROWS, SCHEMA)
    sink.write(df, "a")
    os.rename(f"{base}/_commits/a.json", f"{tmp_path}/a.json")  # as another run would have seen it
    sink.write(df, "b")
    os.rename(f"{tmp_path}/a.json", f"{base}/_commits/a.json")
    assert {r["run_key"] for r in snapshot_runs(spark, base)} == {"a", "b"}
    assert get_source("snapshot")(base).read(spark).count() == 8


def test_streamed_batches_are_runs(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        df = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream_runs(df.where("v > 1"), Sink("snapshot", {"table_uri": str(tmp_path / "out")}), "s", str(tmp_path / "ck")).awaitTermination()
    assert rows(get_source("snapshot")(str(tmp_path / "out")).read(spark)) == sorted([("y", 2), (None, 3)], key=repr)


def test_view(spark, tmp_path):
    for name in ("a", "b/c"):
        spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    assert union(spark, str(tmp_path)).count() == 8
    assert tree(spark, str(tmp_path)).count(": 4 rows") == 2


def test_as_of_with_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5), (4, "b", 9), (5, "a", None)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 40), ("b", 10, 1), (None, 1, 7), ("a", None, 8)], "k string, at int, v int")
    assert {r["id"]: r["last_v"] for r in as_of(left, right, "k", "at", ["v"]).collect()} == {1: 50, 2: None, 3: None, 4: None, 5: None}
    assert as_of(left.limit(0), right, "k", "at", ["v"]).count() == 0


def test_broadcasts_are_bounded_in_bytes():
    n = {"l": 5, "r": 9}
    assert smaller("l", "r", n, 10, {"l": BROADCAST_BYTES}) == "l" and smaller("l", "r", n, 10, {"l": BROADCAST_BYTES + 1}) is None


def test_null_keys_and_groups(spark):
    run = lambda sql, *s: rows(compile_sql(spark, sql, list(s)).dataframe())
    assert run("SELECT t.v, u.w FROM t JOIN u ON t.k = u.k", t, u) == sorted([(1, "a"), (None, "a")], key=repr)
    assert run("SELECT k, SUM(v) AS s, COUNT(v) AS n FROM t GROUP BY k", t) == sorted([("x", 1, 1), ("y", 2, 1), (None, 3, 1)], key=repr)


@pytest.mark.parametrize("name", ["Mixed_Case", "with space", "clé", 'has"quote', "select", "group", "current_date", "current_timestamp"])
def test_awkward_key_names(spark, name):
    quoted = '"' + name.replace('"', '""') + '"'
    schema = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], ["x", "v"]).withColumnRenamed("x", name).schema
    src = Source("t", "t", "memory", {"rows": [("a", 10), ("b", 20), ("a", 30)], "schema": schema})
    assert rows(compile_sql(spark, f"SELECT {quoted}, SUM(v) AS s FROM t GROUP BY {quoted}", [src]).dataframe()) == [("a", 40), ("b", 20)]


@pytest.mark.parametrize("sql", ["SELECT nothing FROM t", "SELEC 1", "SELECT t.v FROM t JOIN missing ON t.k = missing.k"])
def test_what_spark_refuses_raises(spark, sql):
    with pytest.raises(PySparkException):
        compile_sql(spark, sql, [t])


def scan(name, source="t", buckets=4, keys=("k",)):
    return Stage(name, "SELECT * FROM t", (StageInput("t", source_id=source),), Exchange("hash_shuffle", keys, buckets))


def last(*stages):
    return Stage("last", "SELECT a.k FROM a JOIN b ON a.k = b.k", tuple(StageInput(n, stage_id=s) for n, s in zip("ab", stages)))


@pytest.mark.parametrize("graph", [
    StageGraph((t, t), (scan("a"),), "a"),
    StageGraph((t,), (scan("a"), scan("a")), "a"),
    StageGraph((t,), (scan("a", source="z"),), "a"),
    StageGraph((t,), (last("a", "b"), scan("a"), scan("b")), "last"),
    StageGraph((t,), (scan("a"), scan("b", buckets=8), last("a", "b")), "last"),
    StageGraph((t,), (scan("a"), scan("b", keys=("k", "v")), last("a", "b")), "last"),
    StageGraph((t,), (scan("a"),), "nothing"),
])
def test_invalid_graphs(graph):
    with pytest.raises(ValueError):
        graph.validate()


@pytest.mark.parametrize("graph", [
    StageGraph((t,), (scan("a"), Stage("b", "SELECT a.k FROM a JOIN t ON a.k = t.k", (StageInput("a", stage_id="a"), StageInput("t", source_id="t")))), "b"),
    StageGraph((t,), (scan("a"), Stage("b", "SELECT * FROM a", (StageInput("a", stage_id="a"),), Exchange("hash_shuffle", ("k",), 4)), Stage("c", "SELECT * FROM b", (StageInput("b", stage_id="b"),))), "c"),
    StageGraph((t,), (scan("a"), scan("b"), Stage("c", "SELECT * FROM a", (StageInput("a", stage_id="a"),))), "c"),
])
def test_graphs_beyond_one_level_of_shuffles(spark, graph):
    with pytest.raises(NotImplementedError):
        graph_dataframe(spark, graph)


def test_lookups_and_defaults():
    graph = StageGraph((t,), (scan("a"), scan("b"), last("a", "b")), "last").validate()
    with pytest.raises(KeyError):
        graph.stage("z")
    with pytest.raises(KeyError):
        graph.source("z")
    assert [s.stage_id for s in graph.consumers("a")] == ["last"]
    p = BucketingPolicy()
    assert (p.strategy, p.target_rows, p.target_bytes, p.width(None, None, None)) == ("static", 1_000_000, 128 << 20, 4)
    with pytest.raises(ValueError):
        Stage("s", "SELECT 1", (StageInput("x", source_id="t"), StageInput("x", source_id="t")))


def test_graph_counts_its_inputs_once_for_a_broadcast(spark):
    graph = StageGraph((t, u), (scan("a"), Stage("b", "SELECT * FROM u", (StageInput("u", source_id="u"),), Exchange("hash_shuffle", ("k",), 4)), Stage("last", "SELECT a.v, b.w FROM a JOIN b ON a.k = b.k", (StageInput("a", stage_id="a"), StageInput("b", stage_id="b")))), "last")
    df = graph_dataframe(spark, graph, broadcast_threshold=10)
    assert "InMemoryTableScan" in df._jdf.queryExecution().toString() and rows(df) == sorted([(1, "a"), (None, "a")], key=repr)


def test_unaliased_aggregate_has_sparks_name(spark):
    assert compile_sql(spark, "SELECT k, COUNT(*), SUM(v) FROM t GROUP BY k", [t]).dataframe().columns == ["k", "count(1)", "sum(v)"]
