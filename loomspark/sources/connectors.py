"""The connectors that come with the engine.

Files are reached through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, uri: str) -> bool:
    fs, p = _path(spark, uri)
    return fs.exists(p)


def _read_text(spark: SparkSession, uri: str) -> str:
    fs, p = _path(spark, uri)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, uri: str, text: str) -> None:
    """Replace a small file by a rename."""
    fs, p = _path(spark, uri)
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{uri}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = rename
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), kinds)


def run_key(run_id: str) -> str:
    """A run id as a path segment; ids that had to be changed stay apart by a hash."""
    key = re.sub(r"[^0-9A-Za-z_-]", "_", run_id) or "run"
    return key if key == run_id else f"{key}-{sha256(run_id.encode()).hexdigest()[:8]}"


class _Files:
    """A source of files; other options go to Spark's reader."""

    format = ""

    def __init__(self, uris: list[str] | str, **options: Any):
        self.uris = [uris] if isinstance(uris, str) else list(uris)
        if not self.uris:
            raise ValueError(f"a {self.format} source needs a uri")
        self.options = options

    def read(self, spark: SparkSession) -> DataFrame:
        schema = self.options.get("schema")
        reader = spark.read.format(self.format).options(**{k: v for k, v in self.options.items() if k != "schema"})
        return (reader.schema(schema) if schema else reader).load(self.uris)

    def partitions(self, spark: SparkSession) -> int:
        return len(self.uris)

    def estimate_rows(self, spark: SparkSession) -> int | None:
        return None

    def estimate_bytes(self, spark: SparkSession) -> int:
        total = 0
        for uri in self.uris:
            fs, p = _path(spark, uri)
            total += fs.getContentSummary(p).getLength()
        return total


class ParquetSource(_Files):
    """Parquet files that must have one schema; Spark itself would fill missing columns with NULL."""

    format = "parquet"

    def read(self, spark: SparkSession) -> DataFrame:
        df = super().read(spark)
        files = df.inputFiles()
        if len(files) > 1:
            found = one_schema(spark, files)
            if len(found) > 1:
                raise ValueError(f"{' and '.join(sorted(found)[:2])} have different schemas")
        return df

    def read_again(self, spark: SparkSession) -> DataFrame:
        """Without comparing the files' schemas once more."""
        return super().read(spark)

    def estimate_rows(self, spark: SparkSession) -> int:
        """From footers only."""
        return spark.read.parquet(*self.uris).count()  # no column is read


def one_schema(spark: SparkSession, files: list[str]) -> list[str]:
    """A file of each schema (names and types in order) that the footers of the files show; one job reads them all.

    Files of a store that only Spark opens are compared by what Spark takes for their schema.
    """

    def footers(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            names = batch.column(0).to_pylist()
            schemas = []
            for name in names:
                try:
                    fs, path = pyarrow.fs.FileSystem.from_uri(name)
                except (pa.ArrowException, OSError, ValueError):
                    schemas.append(None)
                    continue
                schemas.append("; ".join(f"{f.name} {f.type}" for f in pq.read_schema(path, filesystem=fs)))
            yield pa.RecordBatch.from_pydict({"file": names, "schema": pa.array(schemas, pa.string())})

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 200))
    rows = names.mapInArrow(footers, "file string, schema string").groupBy("schema").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n")).collect()  # a row for each schema
    found = {r["schema"]: r["file"] for r in rows}
    if None in found:
        found = {}
        for f in files:
            found.setdefault(spark.read.parquet(f).schema.simpleString(), f)
    return list(found.values())


class CsvSource(_Files):
    format = "csv"


class JsonSource(_Files):
    format = "json"


class OrcSource(_Files):
    format = "orc"


class _Unknown:
    def partitions(self, spark: SparkSession) -> int | None:
        return None

    def estimate_rows(self, spark: SparkSession) -> int | None:
        return None

    def estimate_bytes(self, spark: SparkSession) -> int | None:
        return None


class JdbcSource(_Unknown):
    def __init__(self, **options: Any):
        self.options = options

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options).load()


class MemorySource(_Unknown):
    """Rows given with the declaration; a schema keeps zero rows typed."""

    def __init__(self, rows: list, schema: str):
        self.rows, self.schema = rows, schema

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def partitions(self, spark: SparkSession) -> int:
        return 1

    def estimate_rows(self, spark: SparkSession) -> int:
        return len(self.rows)


class PythonSource:
    """A pyspark DataSource class; its optional methods estimate_rows and estimate_bytes take its options."""

    def __init__(self, cls: type, **options: Any):
        self.cls, self.options = cls, options

    def read(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(self.cls)
        return spark.read.format(self.cls.name()).options(**self.options).load()

    def partitions(self, spark: SparkSession) -> int | None:
        return self._ask("estimate_partitions")

    def estimate_rows(self, spark: SparkSession) -> int | None:
        return self._ask("estimate_rows")

    def estimate_bytes(self, spark: SparkSession) -> int | None:
        return self._ask("estimate_bytes")

    def _ask(self, name: str) -> int | None:
        return getattr(self.cls, name)(self.options) if hasattr(self.cls, name) else None


def _iceberg(spark: SparkSession) -> None:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.iceberg.spark.source.IcebergSource")
    except Exception as e:
        raise RuntimeError("Iceberg's Spark runtime is not on the class path; add its jar and a catalog, or use the 'snapshot' connector") from e


class IcebergSource(_Unknown):
    def __init__(self, table: str):
        self.table = table

    def read(self, spark: SparkSession) -> DataFrame:
        _iceberg(spark)
        return spark.read.format("iceberg").load(self.table)

    def _files(self, spark: SparkSession, column: str) -> int:
        _iceberg(spark)
        return spark.table(f"{self.table}.files").agg(F.sum(column)).first()[0] or 0

    def estimate_rows(self, spark: SparkSession) -> int:
        return self._files(spark, "record_count")

    def estimate_bytes(self, spark: SparkSession) -> int:
        return self._files(spark, "file_size_in_bytes")


class IcebergSink:
    """Appends one snapshot per run; a run that is committed already is left as it is."""

    def __init__(self, table: str, strict: bool = True):
        self.table, self.strict = table, strict

    def write(self, df: DataFrame, run_key: str | None) -> dict:
        spark = df.sparkSession
        _iceberg(spark)
        writer = df.writeTo(self.table)
        if not spark.catalog.tableExists(self.table):
            if self.strict and df.isEmpty():
                raise ValueError("an empty result can't create the table: no run has given it a schema yet")
            df.limit(0).writeTo(self.table).using("iceberg").create()  # the rows follow with the run's key, so a repeated first run finds it
        if run_key and spark.table(f"{self.table}.snapshots").where(F.col("summary")["run_key"] == run_key).count():
            return {"table": self.table, "run_key": run_key, "committed": False}
        else:
            writer.option("snapshot-property.run_key", run_key or uuid.uuid4().hex).append()
        return {"table": self.table, "run_key": run_key, "committed": True}


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class ParquetSink:
    """Writes to <base>/<run key>; a run that is repeated replaces its own output only."""

    def __init__(self, base_uri: str, write_success_marker: bool = False):
        self.base, self.marker = base_uri.rstrip("/"), write_success_marker

    def write(self, df: DataFrame, run_key: str | None) -> dict:
        spark = df.sparkSession
        out = f"{self.base}/{run_key}" if run_key else self.base
        df, seen = _observed(df)
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(self.marker).lower()).parquet(out)
        if self.marker and run_key:
            _write_text(spark, f"{self.base}/_LATEST", run_key)
        return {"base_uri": self.base, "output_uri": out, "partitions": len(spark.read.parquet(out).inputFiles()), "rows": seen.get["rows"]}


def latest(spark: SparkSession, base_uri: str) -> DataFrame:
    """The run that _LATEST names."""
    base = base_uri.rstrip("/")
    return spark.read.parquet(f"{base}/{_read_text(spark, f'{base}/_LATEST').strip()}")


class SnapshotSink:
    """An append-only table of run directories; a run counts once its file stands in _commits, put there by a rename."""

    def __init__(self, table_uri: str, strict: bool = True):
        self.base, self.strict = table_uri.rstrip("/"), strict

    def write(self, df: DataFrame, run_key: str | None) -> dict:
        spark, key = df.sparkSession, run_key or uuid.uuid4().hex
        runs = snapshot_runs(spark, self.base)
        if key in [r["run_key"] for r in runs]:
            return {"table": self.base, "run_key": key, "files_added": 0, "files_already_committed": next(r["files"] for r in runs if r["run_key"] == key), "rows": 0}
        df, seen = _observed(df)
        df.write.mode("overwrite").parquet(f"{self.base}/{key}")
        rows = seen.get["rows"]
        if not rows:
            if not runs and self.strict:
                raise ValueError("an empty result can't create the table: no run has given it a schema yet")
            return {"table": self.base, "run_key": key, "files_added": 0, "files_already_committed": 0, "rows": 0}
        files = len(spark.read.parquet(f"{self.base}/{key}").inputFiles())
        _write_text(spark, f"{self.base}/_commits/{key}.json", json.dumps({"run_key": key, "files": files, "rows": rows}))
        return {"table": self.base, "run_key": key, "files_added": files, "files_already_committed": 0, "rows": rows}


def snapshot_runs(spark: SparkSession, base: str) -> list[dict]:
    """The committed runs, in the order of their commits; each has a file of its own, so runs that end together both count."""
    if not _exists(spark, f"{base}/_commits"):
        return []
    fs, p = _path(spark, f"{base}/_commits")
    files = sorted((f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(p))
    return [json.loads(_read_text(spark, f"{base}/_commits/{name}")) for _, name in files if name.endswith(".json")]


class SnapshotSource:
    def __init__(self, table_uri: str):
        self.base = table_uri.rstrip("/")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*[f"{self.base}/{r['run_key']}" for r in snapshot_runs(spark, self.base)])

    def partitions(self, spark: SparkSession) -> int:
        return sum(r["files"] for r in snapshot_runs(spark, self.base))

    def estimate_rows(self, spark: SparkSession) -> int:
        return sum(r["rows"] for r in snapshot_runs(spark, self.base))

    def estimate_bytes(self, spark: SparkSession) -> int:
        return sum(_path(spark, f"{self.base}/{r['run_key']}")[0].getContentSummary(_path(spark, f"{self.base}/{r['run_key']}")[1]).getLength() for r in snapshot_runs(spark, self.base))


class PythonSink:
    """A pyspark DataSource class with a writer."""

    def __init__(self, cls: type, **options: Any):
        self.cls, self.options = cls, options

    def write(self, df: DataFrame, run_key: str | None) -> dict:
        df.sparkSession.dataSource.register(self.cls)
        df, seen = _observed(df)
        df.write.format(self.cls.name()).options(**self.options, run_key=run_key or "").mode("append").save()
        return {"rows": seen.get["rows"], "run_key": run_key}
