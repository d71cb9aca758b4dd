"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .operators.joins import as_of
from .plans.compile import compile_sql, graph_dataframe
from .plans.model import BucketingPolicy, Exchange, Sink, Source, Stage, StageGraph, StageInput
from .sources.connectors import latest


def source(sf_dir: str, table: str) -> Source:
    return Source(table, table, "parquet", {"uris": [f"{sf_dir}/{table}.parquet"]})


def _run(sql: str, tables: str, mode: str, rounded: tuple[str, ...], spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    df = compile_sql(spark, sql, [source(sf_dir, t) for t in tables.split()], mode=mode, **how).dataframe()
    return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df


#: Strict statements: name -> (tables, SQL, sums to round).  The oracle is the same text with rounded sums.
STRICT = {
    "scan_all": ("nation", "SELECT * FROM nation", ()),
    "project_alias": ("customer", "SELECT c_name AS name, c_custkey AS id, c_acctbal AS balance FROM customer", ()),
    "filter_gt": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25", ()),
    "filter_compound": ("orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F')) OR o_orderpriority LIKE '1%'", ()),
    "filter_date_range": ("orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'", ()),
    "project_expr": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class, upper(l_returnflag) AS flag, CAST(year(l_shipdate) AS INT) AS y FROM lineitem", ()),
    "filter_none": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice < 0", ()),
    "group_sum": ("orders", "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey", ("total",)),
    "group_count_star": ("orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", ()),
    "group_count_col": ("orders", "SELECT o_orderstatus, COUNT(o_orderdate) AS n FROM orders GROUP BY o_orderstatus", ()),
    "group_min": ("lineitem", "SELECT l_suppkey, MIN(l_extendedprice) AS least FROM lineitem GROUP BY l_suppkey", ()),
    "group_max": ("lineitem", "SELECT l_suppkey, MAX(l_shipdate) AS latest FROM lineitem GROUP BY l_suppkey", ()),
    "group_multi_key": ("lineitem", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, COUNT(*) AS n, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", ("qty",)),
    "group_projection_order": ("orders", "SELECT COUNT(*) AS n, o_orderstatus, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus", ("total",)),
    "group_key_alias": ("orders", "SELECT o_custkey AS customer, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey", ()),
    "group_repeated_agg": ("orders", "SELECT o_custkey, COUNT(*) AS a, COUNT(*) AS b FROM orders GROUP BY o_custkey", ()),
    "group_where": ("lineitem", "SELECT l_suppkey, SUM(l_quantity) AS qty FROM lineitem WHERE l_quantity > 25 GROUP BY l_suppkey", ("qty",)),
    "group_no_agg": ("lineitem", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", ()),
    "group_string_minmax": ("part", "SELECT p_brand, MIN(p_name) AS first_name, MAX(p_type) AS last_type FROM part GROUP BY p_brand", ()),
    "group_events": ("events", "SELECT event_type, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY event_type", ("total",)),
    "group_quoted_identifier": ("orders", 'SELECT o_orderstatus AS "order status", COUNT(*) AS "Größe" FROM orders GROUP BY o_orderstatus', ()),
    "join_inner": ("orders customer", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", ()),
    "join_aliases": ("orders customer", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", ()),
    "join_residual_on": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 AND o_totalprice > c_acctbal", ()),
    "join_dim": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", ()),
}

#: Statements of the extended mode: name -> (tables, SQL[, the oracle's own text]).
EXTENDED = {
    "group_null_key": ("orders", "SELECT NULLIF(o_orderstatus, 'O') AS k, COUNT(*) AS n, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS m FROM orders GROUP BY NULLIF(o_orderstatus, 'O')"),
    "join_using": ("nation supplier", "SELECT s_name, n_name FROM (SELECT s_name, s_nationkey AS nk FROM supplier) JOIN (SELECT n_name, n_nationkey AS nk FROM nation) USING (nk)"),
    "avg": ("lineitem", "SELECT l_returnflag, ROUND(AVG(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag"),
    "count_distinct": ("orders", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "global_agg": ("orders", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, MIN(o_orderdate) AS first_day FROM orders"),
    "agg_expr": ("lineitem", "SELECT l_returnflag, ROUND(SUM(l_quantity * 2), 2) AS twice FROM lineitem GROUP BY l_returnflag"),
    "agg_over": ("orders", "SELECT upper(o_orderstatus) AS s, COUNT(*) + 1 AS n1 FROM orders GROUP BY o_orderstatus"),
    "agg_filter": ("orders", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus"),
    "count_case": ("lineitem", "SELECT l_returnflag, COUNT(CASE WHEN l_quantity > 25 THEN 1 END) AS n FROM lineitem GROUP BY l_returnflag"),
    "stddev": ("lineitem", "SELECT l_returnflag, ROUND(stddev_samp(l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_expr": ("orders", "SELECT CAST(year(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS INT)"),
    "having": ("orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10"),
    "rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "grouping_sets": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "left_join": ("customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "right_join": ("orders customer", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey"),
    "full_join": ("customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50"),
    "semi_join": ("customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)"),
    "anti_join": ("customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 200000)"),
    "cross_join": ("nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "theta_join": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "self_join": ("nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "multi_key_join": ("lineitem", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey"),
    "join_where_group": ("orders customer", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 GROUP BY c_mktsegment"),
    "comma_join": ("nation region", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "three_table_join": ("customer nation region", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cast_key_join": ("lineitem part", "SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_linenumber = p_partkey"),
    "scalar_subquery": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)"),
    "in_subquery": ("customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "exists_subquery": ("customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "select_subquery": ("nation region", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation"),
    "cte": ("orders", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM t GROUP BY n"),
    "derived_table": ("orders", "SELECT o_custkey, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 5"),
    "values_table": ("nation", "SELECT n_name, v.x FROM nation JOIN (VALUES (0, 'a'), (1, 'b')) AS v(k, x) ON n_regionkey = v.k"),
    "distinct": ("customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "order_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "limit_offset": ("customer", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5"),
    "union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("nation customer", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 10"),
    "window_rank": ("orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS d FROM orders"),
    "window_running_sum": ("orders", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders"),
    "window_lag": ("orders", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders"),
    "json_field": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events"),
    "string_functions": ("customer", "SELECT c_custkey, lower(c_name) AS a, substring(c_name, 1, 4) AS b, concat(c_mktsegment, '!') AS c, replace(c_name, '0', 'o') AS d, CAST(length(c_name) AS BIGINT) AS e, trim(c_name) AS f FROM customer"),
    "date_functions": ("orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(month(o_orderdate) AS INT) AS mo FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(month(o_orderdate) AS INT) AS mo FROM orders"),
    "math_functions": ("lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 1) AS a, CAST(floor(l_quantity / 3) AS BIGINT) AS f, CAST(ceil(l_tax) AS BIGINT) AS c, ROUND(sqrt(l_quantity), 6) AS s FROM lineitem"),
    "null_join_keys": ("orders customer", "SELECT o.o_orderkey, c.c_name FROM (SELECT o_orderkey, NULLIF(o_custkey % 7, 0) AS k FROM orders) o JOIN (SELECT c_name, NULLIF(c_custkey, 3) AS k FROM customer) c ON o.k = c.k"),
    "null_keys_left": ("orders customer", "SELECT o.o_orderkey, c.c_name FROM (SELECT o_orderkey, NULLIF(o_custkey % 7, 0) AS k FROM orders) o LEFT JOIN (SELECT c_name, NULLIF(c_custkey, 3) AS k FROM customer) c ON o.k = c.k"),
    "null_safe_join": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON NULLIF(n_regionkey, 1) <=> NULLIF(r_regionkey, 1)", "SELECT n_name, r_name FROM nation JOIN region ON NULLIF(n_regionkey, 1) IS NOT DISTINCT FROM NULLIF(r_regionkey, 1)"),
    "group_all_null": ("orders", "SELECT o_orderstatus, ROUND(SUM(x), 2) AS s, MIN(x) AS lo, MAX(x) AS hi, COUNT(x) AS n, COUNT(*) AS every FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders) GROUP BY o_orderstatus"),
    "group_gone_after_where": ("orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus"),
    "group_unaliased": ("orders", "SELECT o_orderstatus, COUNT(*), MIN(o_orderkey) FROM orders GROUP BY o_orderstatus", 'SELECT o_orderstatus, COUNT(*) AS "count(1)", MIN(o_orderkey) AS "min(o_orderkey)" FROM orders GROUP BY o_orderstatus'),
    "awkward_names": ("orders", 'SELECT "with space", MAX("current_timestamp") AS "has""quote", COUNT("select") AS "clé" FROM (SELECT o_orderstatus AS "with space", o_orderpriority AS "current_timestamp", o_custkey AS "select" FROM orders) GROUP BY "with space"'),
    "agg_two_arguments": ("lineitem", "SELECT l_returnflag, ROUND(corr(l_quantity, l_extendedprice), 6) AS c, ROUND(covar_samp(l_quantity, l_extendedprice), 2) AS v, ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS r FROM lineitem GROUP BY l_returnflag"),
    "agg_median": ("lineitem", "SELECT l_returnflag, ROUND(median(l_quantity), 2) AS m, ROUND(var_pop(l_discount), 8) AS v, bool_or(l_quantity > 49) AS big, ROUND(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag"),
    "agg_collect": ("orders", "SELECT o_orderpriority, array_join(array_sort(collect_set(o_orderstatus)), ',') AS s, max_by(o_orderkey, o_orderkey) AS k FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s, max(o_orderkey) AS k FROM orders GROUP BY o_orderpriority"),
    "agg_sketch": ("lineitem", "SELECT l_returnflag, abs(approx_count_distinct(l_suppkey) - COUNT(DISTINCT l_suppkey)) <= 0.2 * COUNT(DISTINCT l_suppkey) AS near, abs(hll_sketch_estimate(hll_sketch_agg(l_partkey, 14)) - COUNT(DISTINCT l_partkey)) <= 0.1 * COUNT(DISTINCT l_partkey) AS near_hll FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, TRUE AS near, TRUE AS near_hll FROM lineitem GROUP BY l_returnflag"),
    "pivot": ("orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"),
    "range_join": ("part supplier", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_suppkey - 1 AND s_suppkey + 1"),
    "lateral_join": ("nation", "SELECT n_name, t.x FROM nation, LATERAL (SELECT n_regionkey * 2 AS x) t"),
    "lateral_explode": ("customer", "SELECT c_custkey, part FROM customer LATERAL VIEW explode(split(c_name, '#')) t AS part", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer"),
    "sort_in_partitions": ("orders", "SELECT o_orderkey, o_custkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey", "SELECT o_orderkey, o_custkey FROM orders"),
    "array_functions": ("customer", "SELECT c_custkey, array_join(transform(split(c_name, '#'), x -> upper(x)), '-') AS a, CAST(size(split(c_name, '0')) AS BIGINT) AS n, element_at(split(c_name, '#'), 1) AS head FROM customer", "SELECT c_custkey, array_to_string(list_transform(string_split(c_name, '#'), lambda x: upper(x)), '-') AS a, CAST(len(string_split(c_name, '0')) AS BIGINT) AS n, string_split(c_name, '#')[1] AS head FROM customer"),
    "map_struct_functions": ("customer", "SELECT c_custkey, map('k', c_acctbal, 'j', 0.0)['k'] AS m, named_struct('a', c_name, 'b', c_custkey).a AS s FROM customer", "SELECT c_custkey, c_acctbal AS m, c_name AS s FROM customer"),
    "json_struct": ("events", "SELECT event_id, from_json(props, 'k INT').k AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events"),
    "window_more": ("orders", "SELECT o_orderkey, LEAD(o_orderkey) OVER w AS next_key, CAST(NTILE(3) OVER w AS BIGINT) AS third, FIRST_VALUE(o_orderkey) OVER w AS first_key, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS last_near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "window_range": ("orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS near, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS pr FROM orders"),
    "intersect_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "select_alone": ("", "SELECT 1 AS one, 'a' AS letter"),
    "conditional_functions": ("orders", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'O'), 'open') AS s FROM orders"),
}

GROUP = STRICT["group_sum"]
JOIN = STRICT["join_inner"]
POLICIES = {"width_static": BucketingPolicy("static", 3), "width_rows": BucketingPolicy("rows", 8, target_rows=5000), "width_bytes": BucketingPolicy("bytes", 8, target_bytes=100_000), "width_partitions": BucketingPolicy("partitions", 8)}


def _width(policy: BucketingPolicy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(GROUP[1], GROUP[0], "strict", ("total",), spark, sf_dir, bucketing=policy)


def _join(threshold: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(JOIN[1], JOIN[0], "strict", (), spark, sf_dir, broadcast_threshold=threshold)


HASH_JOIN = "SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"


def graph_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = (
        Stage("partial", "SELECT o_custkey, SUM(o_totalprice) AS part, COUNT(*) AS n FROM orders GROUP BY o_custkey", (StageInput("orders", source_id="orders"),), Exchange("hash_shuffle", ("o_custkey",), 4)),
        Stage("final", "SELECT o_custkey, ROUND(SUM(part), 2) AS total, SUM(n) AS n FROM shuffled GROUP BY o_custkey", (StageInput("shuffled", stage_id="partial"),)),
    )
    return graph_dataframe(spark, StageGraph((source(sf_dir, "orders"),), stages, "final"))


def graph_join3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}
    scans = tuple(Stage(f"scan_{t}", f"SELECT * FROM {t}", (StageInput(t, source_id=t),), Exchange("hash_shuffle", (k,), 4)) for t, k in tables.items())
    last = Stage("join", "SELECT n_name, c_custkey, s_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey", tuple(StageInput(t, stage_id=f"scan_{t}") for t in tables))
    return graph_dataframe(spark, StageGraph(tuple(source(sf_dir, t) for t in tables), (*scans, last), "join"))


class _Numbers(DataSource):
    """Numbers by ranges: a custom source."""

    @classmethod
    def name(cls) -> str:
        return "loom_numbers"

    def schema(self) -> str:
        return "id long, square long"

    def reader(self, schema) -> DataSourceReader:
        return _NumberReader(int(self.options["rows"]), int(self.options["parts"]))


class _NumberReader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for first in range(partition.value, self.rows, self.parts * 1024):
            ids = np.arange(first, min(first + self.parts * 1024, self.rows), self.parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids * ids)], ["id", "square"])


def custom_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = Source("numbers", "numbers", "python", {"cls": _Numbers, "rows": "1000", "parts": "4"})
    return compile_sql(spark, "SELECT id, square FROM numbers WHERE id > 10", [numbers]).dataframe()


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    views = events.where("event_type = 'view'").select("user_id", "ts")
    return as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views.withColumn("view_ts", F.col("ts")), "user_id", "ts", ["view_ts"])


def csv_json_orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation through a CSV, a JSON and an ORC folder of the warehouse."""
    base, schema = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loom-formats", "n_nationkey int, n_name string, n_regionkey int"
    for kind in ("csv", "json", "orc"):
        compile_sql(spark, "SELECT * FROM nation", [source(sf_dir, "nation")]).dataframe().write.mode("overwrite").format(kind).save(f"{base}/{kind}")
    sources = [Source(k, k, k, {"uris": [f"{base}/{k}"], "schema": schema}) for k in ("csv", "json", "orc")]
    return compile_sql(spark, "SELECT c.n_nationkey, j.n_name, o.n_regionkey FROM csv c JOIN json j ON c.n_nationkey = j.n_nationkey JOIN orc o ON o.n_nationkey = c.n_nationkey", sources, mode="extended").dataframe()


def snapshot_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into a snapshot table, the first of them twice, read back."""
    uri = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loom-snapshots-{uuid.uuid4().hex}"
    for run in ("one", "one", "two"):
        compile_sql(spark, "SELECT * FROM region", [source(sf_dir, "region")]).run(Sink("snapshot", {"table_uri": uri}), run)
    return compile_sql(spark, "SELECT * FROM t", [Source("t", "t", "snapshot", {"table_uri": uri})]).dataframe()


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a run and reads it back through _LATEST, in a folder of the warehouse."""
    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loom-roundtrip"
    compile_sql(spark, GROUP[1], [source(sf_dir, "orders")]).run(Sink("parquet", {"base_uri": base, "write_success_marker": True}), "roundtrip")
    return latest(spark, base).withColumn("total", F.round("total", 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: partial(_run, sql, tables, "strict", rounded) for n, (tables, sql, rounded) in STRICT.items()}
    out |= {n: partial(_run, x[1], x[0], "extended", ()) for n, x in EXTENDED.items()}
    out |= {n: partial(_width, p) for n, p in POLICIES.items()}
    out |= {"join_broadcast": partial(_join, 10_000_000), "join_merge": partial(_join, 0), "join_shuffle_hash": partial(_run, HASH_JOIN, JOIN[0], "strict", ())}
    return out | {f.__name__: f for f in (graph_group, graph_join3, custom_source_scan, asof_join, csv_json_orc_roundtrip, snapshot_appends, sink_roundtrip)}


def _oracle(sql: str, rounded: tuple[str, ...]) -> str:
    sql = sql.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    for c in rounded:
        head, tail = sql.split(f" AS {c}", 1)
        start = head.rindex("SUM(")
        sql = f"{head[:start]}ROUND({head[start:]}, 2) AS {c}{tail}"
    return sql


def oracle_sql() -> dict[str, str]:
    out = {n: _oracle(sql, rounded) for n, (_, sql, rounded) in STRICT.items()}
    out |= {n: x[-1] for n, x in EXTENDED.items()}
    out |= {n: out["group_sum"] for n in (*POLICIES, "sink_roundtrip")}
    out |= {n: out["join_inner"] for n in ("join_broadcast", "join_merge", "join_shuffle_hash")}
    out["graph_group"] = "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey"
    out["graph_join3"] = "SELECT n_name, c_custkey, s_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey"
    out["asof_join"] = "SELECT p.event_id, p.user_id, p.ts, v.ts AS last_view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"
    out["csv_json_orc_roundtrip"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
    out["snapshot_appends"] = "SELECT * FROM region UNION ALL SELECT * FROM region"
    out["custom_source_scan"] = "SELECT i AS id, i * i AS square FROM range(1000) t(i) WHERE i > 10"
    return out
