"""Source and sink connectors."""

from .connectors import CsvSource, IcebergSink, IcebergSource, JdbcSource, JsonSource, MemorySource, OrcSource, ParquetSink, ParquetSource, PythonSink, PythonSource, SnapshotSink, SnapshotSource
from .registry import SinkConnector, SourceConnector, get_sink, get_source, register_sink, register_source

for _name, _cls in (("parquet", ParquetSource), ("iceberg", IcebergSource), ("snapshot", SnapshotSource), ("memory", MemorySource), ("python", PythonSource), ("csv", CsvSource), ("json", JsonSource), ("orc", OrcSource), ("jdbc", JdbcSource)):
    register_source(_name, _cls, replace=True)
for _name, _cls in (("parquet", ParquetSink), ("iceberg", IcebergSink), ("snapshot", SnapshotSink), ("python", PythonSink)):
    register_sink(_name, _cls, replace=True)

__all__ = ["CsvSource", "IcebergSink", "IcebergSource", "JdbcSource", "JsonSource", "MemorySource", "OrcSource", "ParquetSink", "ParquetSource", "PythonSink", "PythonSource", "SinkConnector", "SnapshotSink", "SnapshotSource", "SourceConnector", "get_sink", "get_source", "register_sink", "register_source"]
