"""Transaction logs of JSON commits and Parquet checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.parsing import url_path
from siltstone.sources import files

VECTOR = "struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
ACTIONS = f"""add struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,dataChange:boolean,stats:string,deletionVector:{VECTOR},baseRowId:bigint,defaultRowCommitVersion:bigint,tags:map<string,string>,clusteringProvider:string>,
remove struct<path:string,deletionTimestamp:bigint,dataChange:boolean,partitionValues:map<string,string>,size:bigint,deletionVector:{VECTOR}>,
cdc struct<path:string,partitionValues:map<string,string>,size:bigint,dataChange:boolean>,
metaData struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:bigint>,
protocol struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>,writerFeatures:array<string>>,
txn struct<appId:string,version:bigint,lastUpdated:bigint>,
domainMetadata struct<domain:string,configuration:string,removed:boolean>,
commitInfo struct<timestamp:bigint,operation:string,operationParameters:map<string,string>,operationMetrics:map<string,string>,inCommitTimestamp:bigint>"""
_COMMIT = re.compile(r"(\d{20})\.json$")
_CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?(?:\.[0-9a-f-]+)?\.(parquet|json)$")


def log(spark: SparkSession, table: str) -> DataFrame:
    """The log's files: (name, version, kind, part, parts); a multi-part checkpoint lacking a part is kind INCOMPLETE."""
    rows = []
    for name in files.names(spark, f"{table}/_delta_log"):
        if m := _COMMIT.fullmatch(name):
            rows.append((name, int(m[1]), "COMMIT", None, None))
        elif m := _CHECKPOINT.fullmatch(name):
            rows.append((name, int(m[1]), "CHECKPOINT", int(m[2]) if m[2] else None, int(m[3]) if m[3] else None))
    have: dict = {}
    for _, version, kind, part, parts in rows:
        if kind == "CHECKPOINT" and parts:
            have.setdefault((version, parts), set()).add(part)
    rows = [(n, v, "INCOMPLETE" if k == "CHECKPOINT" and ps and len(have[v, ps]) < ps else k, p, ps) for n, v, k, p, ps in rows]
    return spark.createDataFrame(rows, "name string, version long, kind string, part int, parts int")


def commits(spark: SparkSession, table: str, low: int = 0, high: int | None = None) -> DataFrame:
    """One row for each action, with version and its order in the commit; one scan over the commits of the range."""
    paths = [files.escaped(f"{table}/_delta_log/{r.name}") for r in log(spark, table).filter("kind = 'COMMIT'").collect() if r.version >= low and (high is None or r.version <= high)]
    if not paths:
        return spark.createDataFrame([], T.StructType.fromDDL(f"{ACTIONS}, version bigint, ord bigint"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("ord"))
    return lines.select(F.from_json("value", ACTIONS).alias("a"), F.regexp_extract("f", r"^(\d+)", 1).cast("long").alias("version"), "ord").select("a.*", "version", "ord")


def file_actions(actions: DataFrame) -> DataFrame:
    """Adds and removes as (path, vector, version, ord, action, size, num_records, data_change, ...)."""
    both = actions.filter("add IS NOT NULL OR remove IS NOT NULL")
    entry = lambda f: F.coalesce(F.col(f"add.{f}"), F.col(f"remove.{f}"))
    vector = entry("deletionVector")
    vector_id = F.when(vector.isNotNull(), F.concat_ws("@", vector.storageType, vector.pathOrInlineDv, vector.offset.cast("string")))
    stats = F.from_json("add.stats", "numRecords bigint")
    return both.select(
        url_path(entry("path")).alias("path"), F.coalesce(vector_id, F.lit("")).alias("vector_id"), vector.alias("vector"), "version", "ord", F.when(F.col("add").isNotNull(), "add").otherwise("remove").alias("action"),
        F.coalesce(entry("size"), F.lit(0)).alias("size"), stats.numRecords.alias("num_records"), entry("dataChange").alias("data_change"), entry("partitionValues").alias("partition_values"), F.col("add.stats").alias("stats"), F.col("add.baseRowId").alias("base_row_id"),
    )


def latest(actions: DataFrame, kind: str) -> DataFrame:
    """The newest protocol or metadata."""
    own = actions.filter(F.col(kind).isNotNull())
    return own.agg(F.max_by(kind, F.struct("version", "ord")).alias(kind)).select(f"{kind}.*")


def transactions(actions: DataFrame) -> DataFrame:
    return actions.filter("txn IS NOT NULL").groupBy("txn.appId").agg(F.max_by("txn.version", F.struct("version", "ord")).alias("version"))


def domains(actions: DataFrame) -> DataFrame:
    own = actions.filter("domainMetadata IS NOT NULL").groupBy("domainMetadata.domain").agg(F.max_by("domainMetadata", F.struct("version", "ord")).alias("d"))
    return own.filter("NOT coalesce(d.removed, false)").select("domain", "d.configuration")


def checkpoint_files(spark: SparkSession, table: str, version: int | None = None) -> tuple[int, list[str]] | None:
    """The newest complete checkpoint at or before a version (all if None), as its version and names: one file, or all parts."""
    rows = [r for r in log(spark, table).filter("kind = 'CHECKPOINT'").collect() if version is None or r.version <= version]
    if not rows:
        return None
    top = max(r.version for r in rows)
    one = min((r for r in rows if r.version == top), key=lambda r: (r.parts or 0, r.name))
    return top, sorted(r.name for r in rows if r.version == top and r.parts == one.parts and (one.parts or r.name == one.name))


def checkpoint(spark: SparkSession, table: str, version: int) -> DataFrame | None:
    """The actions of a complete checkpoint with its sidecars, or None."""
    found = checkpoint_files(spark, table, version)
    if not found or found[0] != version:
        return None
    paths = [files.escaped(f"{table}/_delta_log/{n}") for n in found[1]]
    kinds = T.StructType.fromDDL(f"{ACTIONS}, sidecar struct<path:string,sizeInBytes:bigint,modificationTime:bigint>")
    rows = spark.read.schema(kinds).format("parquet" if paths[0].endswith("parquet") else "json").load(paths)
    side = [r.path for r in rows.filter("sidecar IS NOT NULL").select("sidecar.path").collect()]  # a name for millions of actions
    if side:
        rows = rows.unionByName(spark.read.schema(kinds).parquet(*[files.escaped(p if "/" in p else f"{table}/_delta_log/_sidecars/{p}") for p in side]))
    return rows.drop("sidecar")


def actions(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """What decides the state at a version: the newest complete checkpoint at or before it (ord -1) and the commits after
    that, all commits where there is none. A log that lacks one of those commits is refused."""
    base = checkpoint_files(spark, table, version)
    low = 0 if base is None else base[0] + 1
    have = sorted(r.version for r in log(spark, table).filter("kind = 'COMMIT'").select("version").distinct().collect() if r.version >= low and (version is None or r.version <= version))
    top = version if version is not None else (have[-1] if have else low - 1)
    if top < 0 or have != list(range(low, top + 1)):
        raise ValueError(f"version {top} can't be read: the log has no checkpoint and commits that lead to it")
    rows = commits(spark, table, low, top)
    if base is not None:
        rows = checkpoint(spark, table, base[0]).withColumns({"version": F.lit(base[0]).cast("long"), "ord": F.lit(-1).cast("long")}).unionByName(rows)
    return rows


def state(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Live files at a version, by replaying the newest checkpoint and the commits after it."""
    from siltstone.operators.replay import live_at

    return live_at(file_actions(actions(spark, table, version)), version, ["path", "vector_id"])


def schema(actions: DataFrame) -> T.StructType | None:
    import json

    row = latest(actions, "metaData").first()
    return T.StructType.fromJson(json.loads(row.schemaString)) if row and row.schemaString else None


def dead_positions(live: DataFrame, table: str) -> DataFrame:
    """(path, pos) of the rows that live files' vectors delete. Vectors are decoded on the executors; a file of vectors is
    read once, whatever number of data files share it."""
    import pandas as pd

    from siltstone.functions import codecs

    spark = live.sparkSession
    owned = live.filter("vector IS NOT NULL").select("path", "vector.*")

    @F.pandas_udf("string")
    def place(kind, text):
        return pd.Series([vector_path(k, t) for k, t in zip(kind, text, strict=True)])

    root = files.root_path(spark, table)
    owned = owned.withColumn("at", files.whole_path(url_path(place("storageType", "pathOrInlineDv")), root))
    shared = [r.at for r in owned.filter("storageType <> 'i'").select("at").distinct().collect()]  # files of vectors, each for many data files
    scheme = table[: len(table) - len(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", table))]
    contents = spark.createDataFrame([], "file string, content binary")
    if shared:
        contents = spark.read.format("binaryFile").load([files.escaped(scheme + p) for p in shared]).select(files.whole_path(url_path(F.col("path")), root).alias("file"), "content")
    joined = owned.join(contents, F.col("at") == F.col("file"), "left")

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples():
                if r.storageType == "i":
                    found = codecs.inline_vector(r.pathOrInlineDv, r.sizeInBytes)
                else:
                    start = int(r.offset) if r.offset == r.offset and r.offset is not None else 1
                    found = codecs.vector_blob_raw(bytes(r.content[start : start + int(r.sizeInBytes) + 8]))
                yield pd.DataFrame({"path": r.path, "pos": found.astype("int64")})

    return joined.select("path", "storageType", "pathOrInlineDv", "offset", "sizeInBytes", "content").mapInPandas(decode, "path string, pos long")


def vector_path(kind: str, text: str) -> str:
    """Where a vector is stored: `u` names a file of the table by a prefix and an encoded UUID, `p` gives the path."""
    import uuid

    from siltstone.functions import codecs

    if kind == "i":
        return ""
    if kind == "p":
        return text
    prefix, encoded = text[:-20], text[-20:]
    return f"{prefix + '/' if prefix else ''}deletion_vector_{uuid.UUID(bytes=codecs.z85_decode(encoded))}.bin"


def row_fates(spark: SparkSession, table: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Every row of the live files (or of `only`, some of them) of a table without column mapping, with partition values as
    constants, and its _file, _pos and _fate: LIVE or DELETED_BY_VECTOR. Files are told by their whole paths."""
    own = actions(spark, table, version)
    kinds, meta = schema(own), latest(own, "metaData").first()
    parts = meta.partitionColumns or []
    live = only if only is not None else state(spark, table, version)
    root = files.root_path(spark, table)
    paths = [r.path for r in live.select("path").distinct().collect()]  # what a reader must be given: one name a file
    if not paths:
        return spark.createDataFrame([], T.StructType([*kinds, *T.StructType.fromDDL("_file string, _pos long, _fate string")]))
    stored = T.StructType([f for f in kinds if f.name not in parts])
    whole = lambda p: p if p.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", p) else f"{table}/{p}"
    data = spark.read.schema(stored).parquet(*[files.escaped(whole(p)) for p in paths])
    data = data.select("*", F.col("_metadata.row_index").alias("__pos"), files.whole_path(url_path(F.col("_metadata.file_path")), root).alias("__file"))
    facts = live.select(F.col("path").alias("__path"), F.col("partition_values").alias("__values"), files.whole_path(F.col("path"), root).alias("__at"))
    data = data.join(facts, F.col("__file") == F.col("__at"))
    dead = dead_positions(live, table).select(F.col("path").alias("__of"), F.col("pos").alias("__dead"))
    data = data.join(dead, (F.col("__path") == F.col("__of")) & (F.col("__pos") == F.col("__dead")), "left")
    value = lambda f: F.col("__values")[f.name].cast(f.dataType).alias(f.name) if f.name in parts else F.col(f"`{f.name}`")
    fate = F.when(F.col("__dead").isNotNull(), "DELETED_BY_VECTOR").otherwise("LIVE")
    return data.select(*[value(f) for f in kinds], F.col("__path").alias("_file"), F.col("__pos").alias("_pos"), fate.alias("_fate"))


def rows(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Live rows of a table: files less their vectors, with partition values as constants."""
    return row_fates(spark, table, version).filter("_fate = 'LIVE'").drop("_file", "_pos", "_fate")


def with_stats(live: DataFrame, kinds: T.StructType, parts: list[str]) -> tuple[DataFrame, dict]:
    """live with <column>_min, _max, _nulls and rows, and what the pruning rules need to know of them. A partition value is
    both bounds of its column; other bounds come from the add's statistics, null where they lack."""
    from siltstone.operators.pruning import stats_of

    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.StringType, T.DecimalType)
    own = [f for f in kinds if isinstance(f.dataType, plain)]
    stored = [f for f in own if f.name not in parts]
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in stored)
    nulls = ",".join(f"`{f.name}`:bigint" for f in stored)
    parsed = F.from_json("stats", f"numRecords bigint, minValues struct<{fields}>, maxValues struct<{fields}>, nullCount struct<{nulls}>") if stored else F.from_json("stats", "numRecords bigint")
    live = live.withColumn("__s", parsed)
    columns = {"rows": F.col("__s.numRecords")}
    for f in own:
        if f.name in parts:
            value = F.col("partition_values")[f.name].cast(f.dataType)
            columns |= {f"{f.name}_min": value, f"{f.name}_max": value, f"{f.name}_nulls": F.when(value.isNull(), F.col("__s.numRecords")).otherwise(0)}
        else:
            columns |= {f"{f.name}_{end}": F.col("__s")[group][f.name] for end, group in (("min", "minValues"), ("max", "maxValues"), ("nulls", "nullCount"))}
    return live.withColumns(columns).drop("__s"), {f.name: stats_of(f.name, f.dataType.simpleString(), not isinstance(f.dataType, T.StringType)) for f in own}


def plan(spark: SparkSession, table: str, where, version: int | None = None) -> DataFrame:
    """The live files with skipped: whether their statistics rule the parsed filter out."""
    from siltstone.operators.pruning import skips

    own = actions(spark, table, version)
    live, stats = with_stats(state(spark, table, version), schema(own), latest(own, "metaData").first().partitionColumns or [])
    return live.withColumn("skipped", F.coalesce(skips(where, stats), F.lit(False)))
