"""Tables with snapshot-N and schema-N documents, Avro manifests, and index files of deletion vectors."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import binary_row, codecs
from siltstone.functions.parsing import url_path
from siltstone.operators import merge, replay
from siltstone.sources import files
from siltstone.sources.avro import read_avro

SNAPSHOT = "id long, schemaId long, baseManifestList string, deltaManifestList string, changelogManifestList string, commitUser string, commitIdentifier long, commitKind string, timeMillis long, indexManifest string, totalRecordCount long, deltaRecordCount long, changelogRecordCount long"
SCHEMA = "id long, fields array<struct<id:int,name:string,type:string>>, highestFieldId int, partitionKeys array<string>, primaryKeys array<string>, options map<string,string>, comment string, timeMillis long"


def _documents(spark: SparkSession, folder: str, prefix: str, kinds: str) -> DataFrame:
    names = [n for n in files.names(spark, folder) if n.startswith(prefix)]
    rows = spark.read.option("multiLine", True).schema(kinds).json([files.escaped(f"{folder}/{n}") for n in names]) if names else spark.createDataFrame([], kinds)
    return rows


def snapshots(spark: SparkSession, table: str, branch: str | None = None) -> DataFrame:
    return _documents(spark, f"{table}{f'/branch/branch-{branch}' if branch else ''}/snapshot", "snapshot-", SNAPSHOT)


def schemas(spark: SparkSession, table: str) -> DataFrame:
    return _documents(spark, f"{table}/schema", "schema-", SCHEMA)


def tags(spark: SparkSession, table: str) -> DataFrame:
    return _documents(spark, f"{table}/tag", "tag-", SNAPSHOT)


def consumers(spark: SparkSession, table: str) -> DataFrame:
    return _documents(spark, f"{table}/consumer", "consumer-", "nextSnapshot long")


def options(spark: SparkSession, table: str) -> dict[str, str]:
    row = schemas(spark, table).orderBy(F.desc("id")).first()
    return dict(row.options or {}) if row else {}


def highest_field_checks(spark: SparkSession, table: str) -> DataFrame:
    """Recorded against counted: the highest field id of each schema."""
    counted = F.array_max(F.transform("fields", lambda f: f.id))
    return schemas(spark, table).select("id", F.col("highestFieldId").alias("recorded"), counted.alias("counted"), F.col("highestFieldId").eqNullSafe(counted).alias("agrees"))


def as_of(snapshots_: DataFrame, at_ms: int) -> DataFrame:
    return snapshots_.filter(F.col("timeMillis") <= at_ms).agg(F.max("id").alias("id"))


# ---- manifests

STATS = "struct<_MIN_VALUES:string,_MAX_VALUES:string,_NULL_COUNTS:array<bigint>>"
LISTED = f"_FILE_NAME string, _FILE_SIZE bigint, _NUM_ADDED_FILES bigint, _NUM_DELETED_FILES bigint, _PARTITION_STATS {STATS}, _SCHEMA_ID bigint, _MIN_BUCKET int, _MAX_BUCKET int, _MIN_LEVEL int, _MAX_LEVEL int"
ENTRY = f"""_KIND int, _PARTITION string, _BUCKET int, _TOTAL_BUCKETS int, _FILE struct<_FILE_NAME:string,_FILE_SIZE:bigint,_ROW_COUNT:bigint,_MIN_KEY:string,_MAX_KEY:string,_KEY_STATS:{STATS},_VALUE_STATS:{STATS},
_MIN_SEQUENCE_NUMBER:bigint,_MAX_SEQUENCE_NUMBER:bigint,_SCHEMA_ID:bigint,_LEVEL:int,_EXTRA_FILES:array<string>,_DELETE_ROW_COUNT:bigint,_EMBEDDED_FILE_INDEX:string,_VALUE_STATS_COLS:array<string>,_EXTERNAL_PATH:string,_FIRST_ROW_ID:bigint,_WRITE_COLS:array<string>>"""
INDEX_ENTRY = "_KIND int, _PARTITION string, _BUCKET int, _INDEX_TYPE string, _FILE_NAME string, _FILE_SIZE bigint, _ROW_COUNT bigint, _DELETIONS_VECTORS_RANGES array<struct<f0:string,f1:int,f2:int,_CARDINALITY:bigint>>, _EXTERNAL_PATH string"


def _avro(spark: SparkSession, table: str, names: list[str], kinds: str) -> DataFrame:
    """(name, ord, error, ...) of Avro files in the manifest folder; bytes are hex text."""
    if not names:
        return spark.createDataFrame([], f"name string, ord bigint, error string, {kinds}")
    rows = read_avro(spark, [files.escaped(f"{table}/manifest/{n}") for n in names])
    return rows.select(F.element_at(F.split(url_path(F.col("path")), "/"), -1).alias("name"), F.col("row_index").alias("ord"), "error", F.from_json("record", kinds).alias("r")).select("name", "ord", "error", "r.*")


def manifest_lists(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    return _avro(spark, table, names, LISTED)


def manifests(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    return _avro(spark, table, names, ENTRY)


def index_manifests(spark: SparkSession, table: str, names: list[str]) -> DataFrame:
    return _avro(spark, table, names, INDEX_ENTRY)


def cells(data: Column, kinds: list[str]) -> Column:
    """The values of a binary row in hex as texts, null where it isn't a row of these types."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def run(texts):
        show = lambda x: None if x is None or isinstance(x, bytes) else str(x).lower() if isinstance(x, bool) else str(x)
        rows = [None if t is None else binary_row.decode(bytes.fromhex(t), kinds) for t in texts]
        return pd.Series([None if r is None else [show(x) for x in r] for r in rows], dtype=object)

    return run(data)


def data_type(kind: str) -> T.DataType:
    """A field's type as Spark's."""
    if kind.startswith("{"):
        own = json.loads(kind)
        name = own["type"].split(" ")[0]
        text = lambda x: x if isinstance(x, str) else json.dumps(x)
        if name == "ROW":
            return T.StructType([T.StructField(f["name"], data_type(text(f["type"]))) for f in own["fields"]])
        if name == "ARRAY":
            return T.ArrayType(data_type(text(own["element"])))
        if name == "MAP":
            return T.MapType(data_type(text(own["key"])), data_type(text(own["value"])))
        raise ValueError(f"columns of type {name} are not read")
    bare = kind.upper().replace(" NOT NULL", "").strip()
    name = bare.split("(")[0]
    if name == "DECIMAL":
        return T.DataType.fromDDL(bare.replace(" ", "").lower())
    known = {"BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "DATE": "date", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "BYTES": "binary", "BINARY": "binary", "VARBINARY": "binary", "TIMESTAMP": "timestamp_ntz"}
    if "LOCAL TIME ZONE" in bare:
        return T.TimestampType()
    if name not in known:
        raise ValueError(f"columns of type {kind} are not read")
    return T.DataType.fromDDL(known[name])


# ---- a snapshot


@dataclass(frozen=True)
class Version:
    """One snapshot with the schemas its files may have."""

    table: str
    snapshot: object  # a row of snapshots(), or None for an empty table
    schemas: dict  # schema id -> row of schemas()

    @property
    def schema(self):
        at = self.snapshot.schemaId if self.snapshot is not None and self.snapshot.schemaId in self.schemas else max(self.schemas)
        return self.schemas[at]

    @property
    def options(self) -> dict[str, str]:
        return dict(self.schema.options or {})

    def kinds(self, names: list[str]) -> list[str]:
        of = {f.name: f.type for f in self.schema.fields}
        return [of[n] for n in names]


def version(spark: SparkSession, table: str, snapshot_id: int | None = None) -> Version:
    """The newest snapshot, or the one asked for."""
    own = snapshots(spark, table)
    row = own.filter(F.col("id") == snapshot_id).first() if snapshot_id is not None else own.orderBy(F.desc("id")).first()
    if snapshot_id is not None and row is None:
        raise ValueError(f"no snapshot {snapshot_id}")
    return Version(table, row, {r.id: r for r in schemas(spark, table).collect()})


def live_files(spark: SparkSession, v: Version) -> DataFrame:
    """The data files of a snapshot, by replaying the manifests of its base and delta lists in their order: a file is told by
    partition, bucket, level, name and external path. ENTRY's columns with the file's own beside them, part (texts of the
    partition's values), path (as recorded or put together) and at (below the file system's root)."""
    root = files.root_path(spark, v.table)
    names = [n for n in (v.snapshot.baseManifestList, v.snapshot.deltaManifestList) if n] if v.snapshot is not None else []
    listed = manifest_lists(spark, v.table, names).withColumn("list", F.array_position(F.lit(names).cast("array<string>"), F.col("name"))).select("list", "ord", "error", "_FILE_NAME").collect()
    if any(r.error for r in listed):
        raise ValueError(f"a manifest list of {v.table} can't be read: {next(r.error for r in listed if r.error)}")
    order = {}
    for r in sorted(listed, key=lambda r: (r.list, r.ord)):
        order[r._FILE_NAME] = len(order)
    rows = manifests(spark, v.table, list(order))
    rows = rows.withColumn("_KIND", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("a manifest can't be read: "), "error"))).otherwise(F.col("_KIND")))
    places = spark.createDataFrame(list(order.items()), "name string, version long")
    keys = ["partition", "bucket", "level", "file", "external"]
    acts = rows.join(places, "name").select(
        F.col("_PARTITION").alias("partition"), F.col("_BUCKET").alias("bucket"), F.col("_FILE._LEVEL").alias("level"), F.col("_FILE._FILE_NAME").alias("file"), F.coalesce("_FILE._EXTERNAL_PATH", F.lit("")).alias("external"),
        "version", "ord", F.when(F.col("_KIND") == 0, "add").otherwise("remove").alias("action"), F.col("_FILE").alias("meta"),
    )
    parts = list(v.schema.partitionKeys or [])
    own = replay.live_at(acts, keys=keys).withColumn("part", cells(F.col("partition"), v.kinds(parts)) if parts else F.array().cast("array<string>"))
    default = v.options.get("partition.default-name", "__DEFAULT_PARTITION__")
    legacy = v.options.get("partition.legacy-name", "true").lower() == "true"

    def folder(k: int) -> Column:
        value = F.col("part")[k]
        if legacy and v.kinds(parts)[k].startswith("DATE"):  # named by the day's number
            value = F.unix_date(value.cast("date")).cast("string")
        return F.concat(F.lit(f"{parts[k]}="), F.coalesce(value, F.lit(default)))

    home = F.concat_ws("/", F.lit(v.table.rstrip("/")), *[folder(k) for k in range(len(parts))], F.concat(F.lit("bucket-"), F.col("bucket")), F.col("file"))
    path = F.when(F.col("external") != "", F.col("external")).otherwise(home)
    return own.select("partition", "bucket", "level", "file", "part", "meta", path.alias("path"), files.whole_path(path, root).alias("at"), F.col("meta._FILE_SIZE").alias("size"), F.col("meta._ROW_COUNT").alias("rows"))


def vectors(spark: SparkSession, v: Version) -> DataFrame:
    """(partition, bucket, file, pos) that the snapshot's deletion vectors mark. Index files are read once each and decoded on
    the executors."""
    import pandas as pd

    out = "partition string, bucket int, file string, pos bigint"
    if v.snapshot is None or not v.snapshot.indexManifest:
        return spark.createDataFrame([], out)
    root = files.root_path(spark, v.table)
    own = index_manifests(spark, v.table, [v.snapshot.indexManifest]).filter("_KIND = 0 AND upper(_INDEX_TYPE) = 'DELETION_VECTORS'")
    path = F.coalesce("_EXTERNAL_PATH", F.concat(F.lit(f"{v.table.rstrip('/')}/index/"), F.col("_FILE_NAME")))
    own = own.select(F.col("_PARTITION").alias("partition"), F.col("_BUCKET").alias("bucket"), F.col("_DELETIONS_VECTORS_RANGES").alias("ranges"), path.alias("path"), files.whole_path(path, root).alias("at"))
    paths = [r.path for r in own.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], out)
    content = spark.read.format("binaryFile").load([files.escaped(p) for p in paths]).select(files.whole_path(url_path(F.col("path")), root).alias("at"), "content")

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples():
                for x in r.ranges:
                    found = codecs.bucket_vector(bytes(r.content), x["f1"], x["f2"])
                    yield pd.DataFrame({"partition": r.partition, "bucket": r.bucket, "file": x["f0"], "pos": found.astype("int64")})

    return own.join(content, "at").select("partition", "bucket", "ranges", "content").mapInPandas(decode, out)


_ROW, _KEYED = "__row", {"_SEQUENCE_NUMBER": "bigint", "_VALUE_KIND": "tinyint"}


def records(spark: SparkSession, v: Version, live: DataFrame) -> DataFrame:
    """The stored rows of live files under the snapshot's schema: __row, _file, _pos, level, kind and s (the order of a key's
    records), the key columns k0.., and dead, whether a vector marks the row. A file's columns are found by the field ids of
    the schema that wrote it. Parquet files only."""
    if v.options.get("data-evolution.enabled", "false").lower() == "true":
        raise ValueError("rows stitched from files of some columns are not read")
    keys = list(v.schema.primaryKeys or [])
    root, out = files.root_path(spark, v.table), None
    sequence = [c.strip() for c in v.options.get("sequence.field", "").split(",") if c.strip()]
    for r in live.groupBy(F.col("meta._SCHEMA_ID").alias("id")).agg(F.collect_list("path").alias("paths")).collect():  # names of the files to read
        other = {p.rsplit(".", 1)[-1] for p in r.paths} - {"parquet"}
        if other:
            raise ValueError(f"files of format {', '.join(sorted(other))} are not read")
        stored = v.schemas[r.id].fields
        at = {f.id: f.name for f in stored}
        kinds = T.StructType([T.StructField(f.name, data_type(f.type)) for f in stored])
        if keys:
            kinds = T.StructType([*T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in _KEYED.items())), *kinds])
        rows = spark.read.schema(kinds).parquet(*[files.escaped(p) for p in r.paths])
        row = F.struct(*[(F.col(f"`{at[f.id]}`") if f.id in at else F.lit(None)).cast(data_type(f.type)).alias(f.name) for f in v.schema.fields])
        more = [F.col("_VALUE_KIND").cast("int").alias("kind"), F.col("_SEQUENCE_NUMBER").alias("number")] if keys else [F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("number")]
        rows = rows.select(row.alias(_ROW), F.col("_metadata.row_index").alias("_pos"), files.whole_path(url_path(F.col("_metadata.file_path")), root).alias("at"), *more)
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        row = T.StructType([T.StructField(f.name, data_type(f.type)) for f in v.schema.fields])
        out = spark.createDataFrame([], T.StructType([T.StructField(_ROW, row), *T.StructType.fromDDL("_pos bigint, at string, kind int, number bigint")]))
    out = out.join(live.select("at", "partition", "bucket", "level", "file", F.col("path").alias("_file")), "at")
    dead = vectors(spark, v).select("partition", "bucket", "file", F.col("pos").alias("_pos"), F.lit(True).alias("dead"))
    out = out.join(dead, ["partition", "bucket", "file", "_pos"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    order = F.struct(*[F.col(_ROW).getField(c).alias(f"s{n}") for n, c in enumerate(sequence)], F.col("number")) if sequence else F.col("number")
    return out.select(_ROW, "_file", "_pos", "level", "kind", order.alias("s"), *[F.col(_ROW).getField(k).alias(f"k{n}") for n, k in enumerate(keys)], "dead")


def row_fates(spark: SparkSession, table: str, snapshot_id: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Every stored row of a snapshot (or of `only`, some of its live files) with its _file, _pos and _fate: VECTOR_DELETED;
    without a primary key LIVE; with one what the merge engine makes of it: LIVE, SUPERSEDED, MERGED, RETRACTION or SKIPPED."""
    v = version(spark, table, snapshot_id)
    own = records(spark, v, only if only is not None else live_files(spark, v))
    keys = [f"k{n}" for n in range(len(v.schema.primaryKeys or []))]
    marked = own.filter("dead").withColumn("fate", F.lit("VECTOR_DELETED"))
    kept = own.filter("NOT dead")
    if keys:
        rule = merge.merge_rule(v.options)
        read = kept.filter("level > 0") if rule.skips_level_0 else kept
        state = merge.latest_per_key(read.filter(~F.col("kind").isin(*rule.ignores)) if rule.ignores else read, keys, rule.removing)
        low = kept.filter("level = 0").withColumn("fate", F.lit("SKIPPED")) if rule.skips_level_0 else None
        kept = merge.row_fates(read, state, keys, rule).select(*own.columns, "fate")
        kept = kept.unionByName(low) if low is not None else kept
    else:
        kept = kept.withColumn("fate", F.lit("LIVE"))
    return kept.unionByName(marked).select(*[F.col(_ROW).getField(f.name).alias(f.name) for f in v.schema.fields], "_file", "_pos", F.col("fate").alias("_fate"))


def rows(spark: SparkSession, table: str, snapshot_id: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """What a read of a snapshot returns."""
    v = version(spark, table, snapshot_id)
    names = [f.name for f in v.schema.fields]
    rule = merge.merge_rule(v.options, bool(v.schema.primaryKeys))
    if rule.keep != "COMBINED":
        return row_fates(spark, table, snapshot_id, only).filter("_fate = 'LIVE'").select(*[F.col(f"`{n}`") for n in names])
    if v.options.get("merge-engine") != "partial-update" or rule.sequence_groups:
        raise ValueError("rows of aggregations and sequence groups are folded by operators/merge, not read here")
    own = records(spark, v, only if only is not None else live_files(spark, v)).filter("NOT dead AND level > 0" if rule.skips_level_0 else "NOT dead")
    if rule.ignores:
        own = own.filter(~F.col("kind").isin(*rule.ignores))
    keys = [f"k{n}" for n in range(len(v.schema.primaryKeys))]
    values = {n: f"v{k}" for k, n in enumerate(names) if n not in v.schema.primaryKeys}
    own = own.withColumns({c: F.col(_ROW).getField(n) for n, c in values.items()})
    merged = merge.partially_updated(own, keys, list(values.values()), rule.removing)
    at = {**{n: f"k{k}" for k, n in enumerate(v.schema.primaryKeys)}, **values}
    return merged.select(*[F.col(at[n]).alias(n) for n in names])


def plan(spark: SparkSession, table: str, where, snapshot_id: int | None = None) -> DataFrame:
    """The live files with skipped: whether partition values or recorded statistics rule the parsed filter out. Where a
    primary key merges records, only partition and key columns may: another column's older value must still be superseded.
    Statistics count where the file has the snapshot's schema and states them for all columns."""
    from siltstone.operators.pruning import skips, stats_of

    v = version(spark, table, snapshot_id)
    parts, keys = list(v.schema.partitionKeys or []), list(v.schema.primaryKeys or [])
    live, stats = live_files(spark, v), {}
    trimmed = [k for k in keys if k not in parts] if keys else [f.name for f in v.schema.fields]
    group = "meta._KEY_STATS" if keys else "meta._VALUE_STATS"
    known = (F.col("meta._SCHEMA_ID") == v.schema.id) & F.col("meta._VALUE_STATS_COLS").isNull() & F.col("meta._WRITE_COLS").isNull()
    kinds = v.kinds(trimmed)
    own = live.select("*", *[F.when(known, cells(F.col(f"{group}.{c}"), kinds)).alias(f"__{c}") for c in ("_MIN_VALUES", "_MAX_VALUES")], F.when(known, F.col(f"{group}._NULL_COUNTS")).alias("__nulls"))
    columns = {}
    for n, name in enumerate(parts):
        value = F.col("part")[n].try_cast(data_type(v.kinds([name])[0]))
        columns |= {f"{name}_min": value, f"{name}_max": value, f"{name}_nulls": F.when(value.isNull(), F.col("rows")).otherwise(0)}
        stats[name] = stats_of(name, data_type(v.kinds([name])[0]).simpleString())
    plain = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.StringType, T.DecimalType)
    for n, (name, kind) in enumerate(zip(trimmed, kinds, strict=True)):
        if name in parts or kind.startswith("{") or not isinstance(data_type(kind), plain):
            continue
        of = data_type(kind)
        columns |= {f"{name}_min": F.get("___MIN_VALUES", F.lit(n)).try_cast(of), f"{name}_max": F.get("___MAX_VALUES", F.lit(n)).try_cast(of), f"{name}_nulls": F.get("__nulls", F.lit(n))}
        stats[name] = stats_of(name, of.simpleString(), not isinstance(of, T.StringType))
    facts = own.select(F.struct(*live.columns).alias("__file"), F.col("rows"), *[c.alias(n) for n, c in columns.items()])
    return facts.withColumn("skipped", F.coalesce(skips(where, stats), F.lit(False))).select("__file.*", "skipped")
