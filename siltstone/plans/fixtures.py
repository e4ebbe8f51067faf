"""Tables in the shape of lakehouse metadata and data files, derived from the driver's tables.

Each fixture is one SELECT in the dialect Spark and DuckDB share, over {placeholders} of other fixtures or base tables.
`frame` builds it as a DataFrame, `text` as a SQL subquery, so a query and its SQL stand on the same rows. Integer
arithmetic on key columns only.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events".split()
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_MONTH = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"

FIXTURES = {
    # rows of data files: a file a month, positions in a total order, sequence numbers, a partition
    "data_rows": f"""SELECT {_LINE}, CAST({_MONTH} AS BIGINT) AS file_id, CAST(row_number() OVER (PARTITION BY {_MONTH} ORDER BY {_LINE}) - 1 AS BIGINT) AS pos,
        CAST(1 + ({_MONTH}) % 4 AS BIGINT) AS seq, l_returnflag AS part FROM {{lineitem}}""",
    "file_stats": """SELECT file_id, max(seq) AS seq, CAST(count(*) AS BIGINT) AS rows, CAST(floor(file_id / 12) AS BIGINT) AS manifest_id, CAST(sum(64 + l_linenumber) AS BIGINT) AS bytes,
        min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max, CAST(0 AS BIGINT) AS l_shipdate_nulls,
        min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, CAST(0 AS BIGINT) AS l_quantity_nulls,
        min(l_partkey) AS l_partkey_min, max(l_partkey) AS l_partkey_max, CAST(0 AS BIGINT) AS l_partkey_nulls,
        min(l_orderkey) AS l_orderkey_min, max(l_orderkey) AS l_orderkey_max, CAST(0 AS BIGINT) AS l_orderkey_nulls
        FROM {data_rows} x GROUP BY file_id""",
    "manifest_stats": """SELECT manifest_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS l_shipdate_nulls,
        min(l_shipdate_min) AS l_shipdate_min, max(l_shipdate_max) AS l_shipdate_max FROM {file_stats} x GROUP BY manifest_id""",
    "pos_deletes": """SELECT file_id, pos, 1 + l_orderkey % 5 AS delete_seq, 'b-pos' AS delete_key FROM {data_rows} x WHERE (l_orderkey * 31 + l_linenumber) % 17 = 0""",
    "vectors": """SELECT file_id, pos, 'a-vec' AS delete_key FROM {data_rows} x WHERE (l_partkey + l_linenumber) % 29 = 0""",
    "eq_deletes": """SELECT o_orderkey AS l_orderkey, 1 + o_orderkey % 5 AS delete_seq, 'c-eq' AS delete_key FROM {orders} x WHERE o_orderkey % 13 = 0
        UNION ALL SELECT CAST(NULL AS BIGINT), CAST(5 AS BIGINT), 'c-eq'""",
    "lsm_records": """SELECT user_id AS k, event_id AS s, CAST(CASE WHEN user_id % 10 = 7 THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END)
        ELSE (CASE event_id % 7 WHEN 3 THEN 3 WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END) END AS INT) AS kind, user_id % 4 AS bucket, event_id % 3 AS level,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id * 10 END AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS b,
        event_id % 11 AS ga, event_id % 13 AS gb FROM {events} x""",
    "actions": """SELECT CAST(floor(event_id / 1000.0) AS BIGINT) AS version, event_id AS ord, user_id % 50 AS path, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
        1 + event_id % 97 AS num_records, 1000 + event_id % 5003 AS size FROM {events} x""",
    "snapshots": """SELECT snapshot_id, CASE WHEN snapshot_id = 0 THEN NULL ELSE snapshot_id - 1 END AS parent_id, at_time, added FROM (
        SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS snapshot_id, max(o_orderdate) AS at_time, CAST(count(*) AS BIGINT) AS added
        FROM {orders} x GROUP BY 1) y""",
    "key_ranges": """SELECT p_partkey AS file, p_partkey * 10 AS lo, p_partkey * 10 + p_size AS hi, CAST(p_size AS BIGINT) * 1048576 AS bytes, p_partkey % 4 AS bucket, p_partkey % 6 AS level FROM {part} x""",
    "listing": """SELECT p_partkey AS path, CAST(1000 + p_partkey * 17 AS BIGINT) AS modified, CAST(p_size AS BIGINT) * 1048576 AS size FROM {part} x WHERE p_partkey % 11 <> 0""",
    "referenced": """SELECT p_partkey AS path, p_partkey % 9 AS snapshot_id FROM {part} x WHERE p_partkey % 7 <> 0""",
    "small_files": """SELECT p_partkey AS file, p_partkey % 40 AS part, CAST(1 + p_size AS BIGINT) * 1048576 AS size, p_partkey % 3 AS n_deletes, CAST(p_size AS BIGINT) * 100 AS rows, p_partkey % 20 AS removed FROM {part} x""",
}
_NAME = re.compile(r"\{(\w+)\}")


#: Fixtures that stand for files on disk (data, and the statistics of manifests): written once a session, in file order, and scanned from there.
STORED = {"data_rows": ["file_id", "pos"], "file_stats": ["file_id"]}
_stored: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder for a fixture: in the shared folder of a cluster, else a local one that goes with the process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/siltstone-fixture-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siltstone-fixture-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/t"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in STORED:
        return sql(spark, sf_dir, FIXTURES[name])
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch(spark)
        sql(spark, sf_dir, FIXTURES[name]).repartitionByRange(STORED[name][0]).sortWithinPartitions(*STORED[name]).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def sql(spark: SparkSession, sf_dir: str, query: str, **frames: DataFrame) -> DataFrame:
    """A query over {placeholders}: given frames, fixtures or base tables."""
    for name in set(_NAME.findall(query)) - set(frames):
        frames[name] = frame(spark, sf_dir, name)
    return spark.sql(query, **frames)


def text(query: str) -> str:
    """The same query for the SQL oracle."""
    return _NAME.sub(lambda m: m[1] if m[1] in BASE else f"({text(FIXTURES[m[1]])})", query)
