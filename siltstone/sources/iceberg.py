"""Tables with metadata.json, Avro manifest lists and manifests."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.parsing import metadata_version, url_path
from siltstone.sources import files
from siltstone.sources.avro import read_avro

METADATA = """`format-version` int, `table-uuid` string, location string, `last-updated-ms` bigint, `last-column-id` int, `last-sequence-number` bigint, `current-schema-id` int, `default-spec-id` int, `current-snapshot-id` bigint,
properties map<string,string>, snapshots array<struct<`snapshot-id`:bigint,`parent-snapshot-id`:bigint,`sequence-number`:bigint,`timestamp-ms`:bigint,`manifest-list`:string,`schema-id`:int,summary:map<string,string>>>,
`snapshot-log` array<struct<`timestamp-ms`:bigint,`snapshot-id`:bigint>>, refs map<string,struct<`snapshot-id`:bigint,type:string,`min-snapshots-to-keep`:int,`max-snapshot-age-ms`:bigint,`max-ref-age-ms`:bigint>>,
schemas array<struct<`schema-id`:int,fields:array<struct<id:int,name:string,required:boolean,type:string>>>>,
`partition-specs` array<struct<`spec-id`:int,fields:array<struct<`source-id`:int,`field-id`:int,name:string,transform:string>>>>,
`partition-statistics` array<struct<`snapshot-id`:bigint,`statistics-path`:string,`file-size-in-bytes`:bigint>>"""


def versions(spark: SparkSession, table: str) -> DataFrame:
    """Every metadata version, plain or gzipped, in order of version, time and name."""
    names = [n for n in files.names(spark, f"{table}/metadata") if ".metadata.json" in n]
    rows = spark.read.option("multiLine", True).schema(METADATA).json([files.escaped(f"{table}/metadata/{n}") for n in names])
    return rows.select(metadata_version(F.col("_metadata.file_name")).alias("version"), F.col("_metadata.file_name").alias("name"), "*").orderBy(F.col("version").asc_nulls_last(), "last-updated-ms", "name")


def newest(spark: SparkSession, table: str) -> DataFrame:
    return versions(spark, table).orderBy(F.col("version").desc_nulls_last(), F.desc("last-updated-ms")).limit(1)


def snapshots(metadata: DataFrame) -> DataFrame:
    """(snapshot_id, parent_id, sequence, at_ms, manifest_list, summary) of metadata rows, each snapshot once."""
    s = metadata.select(F.explode("snapshots").alias("s"))
    own = s.select(F.col("s.snapshot-id").alias("snapshot_id"), F.col("s.parent-snapshot-id").alias("parent_id"), F.col("s.sequence-number").alias("sequence"), F.col("s.timestamp-ms").alias("at_ms"), F.col("s.manifest-list").alias("manifest_list"), F.col("s.summary").alias("summary"))
    return own.dropDuplicates(["snapshot_id"])


def refs(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.explode("refs")).select(F.col("key").alias("ref"), F.col("value.snapshot-id").alias("snapshot_id"), F.col("value.type").alias("type"))


def snapshot_log(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.posexplode("snapshot-log")).select(F.col("pos").cast("long").alias("ord"), F.col("col.snapshot-id").alias("snapshot_id"), F.col("col.timestamp-ms").alias("at_ms"))


def manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifest-list entries, errors kept."""
    rows = read_avro(spark, paths)
    kinds = "manifest_path string, manifest_length long, partition_spec_id int, content int, sequence_number long, min_sequence_number long, added_snapshot_id long, added_files_count int, existing_files_count int, deleted_files_count int, added_rows_count long, existing_rows_count long, deleted_rows_count long"
    return rows.select("path", "error", F.from_json("record", kinds).alias("m")).select("path", "error", "m.*")


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifest entries; the partition stays JSON, as its shape is the spec's."""
    rows = read_avro(spark, paths)
    kinds = "status int, snapshot_id long, sequence_number long, data_file struct<content:int,file_path:string,file_format:string,record_count:bigint,file_size_in_bytes:bigint,sort_order_id:int>"
    parsed = rows.select("path", F.col("row_index").alias("ord"), "error", F.from_json("record", kinds).alias("e"), F.get_json_object("record", "$.data_file.partition").alias("partition"))
    return parsed.select("path", "ord", "error", "e.status", "e.snapshot_id", "e.sequence_number", "e.data_file.*", "partition")


def resolve(recorded: str, table: str, exists) -> tuple[str, str]:
    """The recorded path if it is there, else the one beside the opened table; and which."""
    if exists(recorded):
        return recorded, "RECORDED"
    for folder in ("/metadata/", "/data/"):
        if folder in recorded:
            return table.rstrip("/") + folder + recorded.split(folder, 1)[1], "RELATIVE"
    return recorded, "MISSING"


# ---- columns by field id


def name_mapping(text: str) -> dict[str, int]:
    """name -> field id of a default name mapping, nested names dotted."""
    out: dict[str, int] = {}

    def walk(fields, prefix):
        for f in fields:
            for n in f.get("names", []):
                if "field-id" in f:
                    out[prefix + n] = f["field-id"]
                walk(f.get("fields", []), f"{prefix}{n}.")

    walk(json.loads(text), "")
    return out


def place(columns: dict[str, int | None], mapping: dict[str, int] | None = None) -> dict[int, str]:
    """Field id -> file column, by its own id or else by the mapping."""
    out = {}
    for name, own in columns.items():
        k = own if own is not None else (mapping or {}).get(name)
        if k is not None:
            out.setdefault(k, name)
    return out


def project(columns: dict[str, int | None], fields: list[tuple[int, str, str, object]], mapping: dict[str, int] | None = None) -> list[Column]:
    """fields (id, name, type, initial default) as a select list: the column with the id, else the default, else null."""
    at = place(columns, mapping)
    return [(F.col(f"`{at[k]}`") if k in at else F.lit(default)).cast(kind).alias(name) for k, name, kind, default in fields]


def provenance(columns: dict[str, int | None], fields: list[tuple[int, str, str, object]], mapping: dict[str, int] | None = None) -> dict[str, str]:
    """FILE, INITIAL_DEFAULT or ABSENT for each field."""
    at = place(columns, mapping)
    return {name: "FILE" if k in at else "INITIAL_DEFAULT" if default is not None else "ABSENT" for k, name, _, default in fields}


def field_rows(schema: dict, prefix: str = "") -> list[tuple[str, int, str, bool]]:
    """(path, id, type, required) of a nested schema."""
    out = []
    for f in schema.get("fields", []):
        kind, path = f["type"], prefix + f["name"]
        out.append((path, f["id"], kind if isinstance(kind, str) else kind["type"], f.get("required", False)))
        if isinstance(kind, dict):
            if kind["type"] == "struct":
                out += field_rows(kind, path + ".")
            elif kind["type"] == "list":
                out.append((path + ".element", kind["element-id"], kind["element"] if isinstance(kind["element"], str) else kind["element"]["type"], kind.get("element-required", False)))
                if isinstance(kind["element"], dict):
                    out += field_rows(kind["element"], path + ".element.")
            elif kind["type"] == "map":
                out += [(path + ".key", kind["key-id"], str(kind["key"]), True), (path + ".value", kind["value-id"], kind["value"] if isinstance(kind["value"], str) else kind["value"]["type"], kind.get("value-required", False))]
    return out


# ---- rows of a snapshot

_PLAIN = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "binary", "binary": "binary"}


def data_type(kind) -> T.DataType:
    """A column type as Spark's, with the field ids the Parquet reader goes by."""
    if isinstance(kind, str) and kind.startswith("{"):
        kind = json.loads(kind)
    if isinstance(kind, str):
        if kind in _PLAIN or kind.startswith(("decimal", "fixed")):
            return T.DataType.fromDDL(_PLAIN.get(kind) or ("binary" if kind.startswith("fixed") else kind.replace(" ", "")))
        raise ValueError(f"columns of type {kind} are not read")
    if kind["type"] == "struct":
        return T.StructType([_field(f["name"], f["id"], f["type"]) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(data_type(kind["element"]))
    return T.MapType(data_type(kind["key"]), data_type(kind["value"]))


def _field(name: str, field_id: int, kind) -> T.StructField:
    return T.StructField(name, data_type(kind), True, {"parquet.field.id": field_id})


@dataclass(frozen=True)
class Version:
    """What the metadata says about one snapshot of a table."""

    table: str
    location: str
    manifest_list: str | None
    fields: list  # (id, name, type) of the current schema
    every: dict  # field id -> (name, type) of any schema, the newest first
    specs: dict  # spec id -> [(name, source id, transform)]

    def moved(self, path: Column) -> Column:
        """A recorded path as it is now, if the table was copied from its recorded location to where it was opened."""
        old = self.location.rstrip("/") + "/"
        return F.when(path.startswith(old), F.concat(F.lit(self.table.rstrip("/") + "/"), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path) if self.location else path


def version(spark: SparkSession, table: str, snapshot_id: int | None = None) -> Version:
    """The current snapshot, or the one asked for; a table without snapshots has no manifest list."""
    meta = newest(spark, table).first()
    want = snapshot_id if snapshot_id is not None else meta["current-snapshot-id"]
    own = {s["snapshot-id"]: s for s in meta.snapshots or []}
    if snapshot_id is not None and snapshot_id not in own:
        raise ValueError(f"no snapshot {snapshot_id}")
    schemas = {x["schema-id"]: x.fields for x in meta.schemas or []}
    chosen = own[want] if want in own else None
    at = chosen["schema-id"] if snapshot_id is not None and chosen["schema-id"] in schemas else meta["current-schema-id"]
    fields = [(f.id, f.name, f.type) for f in schemas.get(at, schemas[max(schemas)] if schemas else [])]
    every = {f.id: (f.name, f.type) for k in sorted(schemas) for f in schemas[k]}
    specs = {x["spec-id"]: [(f.name, f["source-id"], f.transform) for f in x.fields] for x in meta["partition-specs"] or []}
    return Version(table, meta.location or "", chosen["manifest-list"] if chosen else None, fields, every, specs)


FILE = """content int, file_path string, file_format string, record_count bigint, file_size_in_bytes bigint, equality_ids array<int>, referenced_data_file string, content_offset bigint, content_size_in_bytes bigint,
lower_bounds array<struct<key:int,value:string>>, upper_bounds array<struct<key:int,value:string>>, null_value_counts array<struct<key:int,value:bigint>>, nan_value_counts array<struct<key:int,value:bigint>>"""


def live_files(spark: SparkSession, v: Version) -> DataFrame:
    """Data and delete files of a snapshot: FILE's columns, spec_id, partition (JSON), sequence and at, the path below the
    file system's root. Entries without a sequence number inherit their manifest's. The driver holds the manifests' names."""
    empty = f"{FILE}, spec_id int, partition string, sequence bigint, at string"
    if v.manifest_list is None:
        return spark.createDataFrame([], empty)
    root = files.root_path(spark, v.table)
    listed = manifests(spark, [files.escaped(spark.range(1).select(v.moved(F.lit(v.manifest_list))).first()[0])])
    listed = listed.select(v.moved(F.col("manifest_path")).alias("manifest"), "partition_spec_id", F.coalesce("sequence_number", F.lit(0)).alias("listed"), "error").collect()
    if any(r.error for r in listed):
        raise ValueError(f"the manifest list of {v.table} can't be read: {next(r.error for r in listed if r.error)}")
    if not listed:
        return spark.createDataFrame([], empty)
    rows = read_avro(spark, [files.escaped(r.manifest) for r in listed])
    parsed = rows.select("path", "error", F.from_json("record", f"status int, sequence_number bigint, data_file struct<{_struct(FILE)}>").alias("e"), F.get_json_object("record", "$.data_file.partition").alias("partition"))
    parsed = parsed.withColumn("e", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("a manifest can't be read: "), "error"))).otherwise(F.col("e")))
    names = spark.createDataFrame([(r.manifest, r.partition_spec_id, r.listed) for r in listed], "manifest string, spec_id int, listed long").withColumn("manifest", files.whole_path(F.col("manifest"), root))
    own = parsed.filter("e.status <> 2").withColumn("manifest", files.whole_path(url_path(F.col("path")), root)).join(names, "manifest")
    out = own.select("e.data_file.*", "spec_id", "partition", F.coalesce("e.sequence_number", "listed").alias("sequence"))
    return out.withColumn("content", F.coalesce("content", F.lit(0))).withColumn("at", files.whole_path(v.moved(F.col("file_path")), root))


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def _parquet(spark: SparkSession, paths: list[str], fields: list[T.StructField]) -> DataFrame:
    """One scan by field ids: columns are found by id whatever their name, and are null in files that lack them. The two
    settings are the session's; they concern only reads whose schema has field ids."""
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    return spark.read.schema(T.StructType(fields)).parquet(*[files.escaped(p) for p in paths])


def _checked(rows: list, kind: str = "PARQUET") -> list:
    other = {r.file_format.upper() for r in rows} - {kind}
    if other:
        raise ValueError(f"files of format {', '.join(sorted(other))} are not read")
    return rows


def vectors(spark: SparkSession, v: Version, live: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(file_id, pos, delete_key) of deletion vectors, decoded on the executors; a file of vectors is read once. paths: those
    files, if they are known."""
    import pandas as pd

    from siltstone.functions import codecs

    root = files.root_path(spark, v.table)
    own = live.filter("content = 1 AND content_offset IS NOT NULL").select("at", F.struct(files.whole_path(v.moved(F.col("referenced_data_file")), root).alias("of"), "content_offset", "content_size_in_bytes").alias("r"), v.moved(F.col("file_path")).alias("path"))
    paths = [r.path for r in own.select("path").distinct().collect()] if paths is None else paths
    if not paths:
        return spark.createDataFrame([], "file_id string, pos long, delete_key string")
    content = spark.read.format("binaryFile").load([files.escaped(p) for p in paths]).select(files.whole_path(url_path(F.col("path")), root).alias("at"), "content")
    grouped = own.groupBy("at").agg(F.collect_list("r").alias("ranges")).join(content, "at")  # a range for each data file it serves

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples():
                for x in r.ranges:
                    start = x["content_offset"]
                    found = codecs.vector_blob(bytes(r.content[start : start + x["content_size_in_bytes"]]))
                    yield pd.DataFrame({"file_id": x["of"], "pos": found.astype("int64"), "delete_key": r.at})

    return grouped.select("at", "ranges", "content").mapInPandas(decode, "file_id string, pos long, delete_key string")


def row_fates(spark: SparkSession, table: str, snapshot_id: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Every row of a snapshot's data files (or of `only`, some of its live files) with its _file, _pos and _fate: LIVE,
    VECTOR_DELETED, POSITION_DELETED or EQUALITY_DELETED. Equality deletes of a partitioned spec reach their partition, others
    every file; a file with a vector has no other positional deletes. Identity partition values stand in for columns that the
    files lack. Parquet files only."""
    from siltstone.operators import deletes

    v = version(spark, table, snapshot_id)
    kinds = [_field(name, k, kind) for k, name, kind in v.fields]
    live = live_files(spark, v)
    root = files.root_path(spark, table)
    data = (only if only is not None else live).filter("content = 0")
    named = _checked(data.select(v.moved(F.col("file_path")).alias("path"), "file_format").distinct().collect())
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in kinds], *T.StructType.fromDDL("_file string, _pos bigint, _fate string")])
    if not named:
        return spark.createDataFrame([], out)
    rows = _parquet(spark, [r.path for r in named], kinds)
    rows = rows.select(F.struct(*[F.col(f"`{f.name}`") for f in kinds]).alias("__row"), files.whole_path(url_path(F.col("_metadata.file_path")), root).alias("file_id"), F.col("_metadata.row_index").alias("pos"))
    facts = data.select(F.col("at").alias("file_id"), F.col("sequence").alias("seq"), "spec_id", F.coalesce("partition", F.lit("{}")).alias("partition"), F.col("file_path").alias("__path")).distinct()
    rows = rows.join(facts, "file_id")

    removing = live.filter("content <> 0").select("content", v.moved(F.col("file_path")).alias("path"), "file_format", "equality_ids", "spec_id", F.col("content_offset").isNotNull().alias("vector"))
    removing = removing.distinct().collect()  # names of delete files
    dead = vectors(spark, v, live, sorted({r.path for r in removing if r.content == 1 and r.vector}))
    places = live.filter("content = 1 AND content_offset IS NULL").select("at", "sequence")
    positions = None
    if found := sorted({r.path for r in _checked([r for r in removing if r.content == 1 and not r.vector])}):
        stored = spark.read.schema("file_path string, pos bigint").parquet(*[files.escaped(p) for p in found])
        stored = stored.select(files.whole_path(v.moved(F.col("file_path")), root).alias("file_id"), "pos", files.whole_path(url_path(F.col("_metadata.file_path")), root).alias("at"))
        positions = stored.join(places.select("at", F.col("sequence").alias("delete_seq")).distinct(), "at").withColumnRenamed("at", "delete_key")
        if any(r.vector for r in removing):
            covered = live.filter("content = 1 AND content_offset IS NOT NULL").select(files.whole_path(v.moved(F.col("referenced_data_file")), root).alias("file_id")).distinct()
            positions = positions.join(covered, "file_id", "left_anti")
    rows = deletes.with_fate(rows, dead, positions, None).withColumnRenamed("fate", "__f0")
    fates = ["__f0"]

    own = live.filter("content = 2").select("at", "sequence", "spec_id", F.coalesce("partition", F.lit("{}")).alias("partition"))
    groups: dict[tuple, list[str]] = {}
    for r in _checked([r for r in removing if r.content == 2]):
        groups.setdefault((tuple(sorted(r.equality_ids)), not v.specs.get(r.spec_id)), []).append(r.path)
    current = {k: name for k, name, _ in v.fields}
    for n, ((ids, everywhere), paths) in enumerate(sorted(groups.items()), 1):
        lost = [k for k in ids if k not in current]
        if lost:
            raise ValueError(f"equality deletes on dropped columns {lost} are not applied")
        stored = _parquet(spark, paths, [_field(f"e{k}", k, v.every[k][1]) for k in ids])
        stored = stored.select("*", files.whole_path(url_path(F.col("_metadata.file_path")), root).alias("at"))
        scope = [] if everywhere else ["spec_id", "partition"]
        stored = stored.join(own.select("at", F.col("sequence").alias("delete_seq"), *scope).distinct(), "at").withColumnRenamed("at", "delete_key")
        keyed = rows.withColumns({f"e{k}": F.col("__row").getField(current[k]) for k in ids})
        rows = deletes.with_fate(keyed, None, None, stored, [f"e{k}" for k in ids] + scope).drop(*[f"e{k}" for k in ids]).withColumnRenamed("fate", f"__f{n}")
        fates.append(f"__f{n}")

    identity = {source: (spec, name) for spec, parts in v.specs.items() for name, source, transform in parts if transform == "identity"}

    def cell(k: int, f: T.StructField) -> Column:
        value = F.col("__row").getField(f.name)
        if k not in identity or isinstance(f.dataType, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
            return value.alias(f.name)
        spec, name = identity[k]
        text = F.get_json_object("partition", f"$['{name}']")
        known = F.date_from_unix_date(text.cast("int")) if isinstance(f.dataType, T.DateType) else text.cast(f.dataType)
        return F.coalesce(value, F.when(F.col("spec_id") == spec, known)).alias(f.name)

    fate = F.coalesce(*[F.when(F.col(c) != deletes.LIVE, F.col(c)) for c in fates], F.lit(deletes.LIVE))
    return rows.select(*[cell(k, f) for (k, _, _), f in zip(v.fields, kinds, strict=True)], F.col("__path").alias("_file"), F.col("pos").alias("_pos"), fate.alias("_fate"))


def plan(spark: SparkSession, table: str, where, snapshot_id: int | None = None) -> DataFrame:
    """The live data files with path, size, rows and skipped: whether their bounds rule the parsed filter out. Bounds of
    floating columns count only where the file has no NaN."""
    import pandas as pd

    from siltstone.functions import codecs
    from siltstone.operators.predicates import terms
    from siltstone.operators.pruning import skips, stats_of

    def bound(kind: str, of: T.DataType):
        @F.pandas_udf(of)
        def decoded(texts):
            return pd.Series([None if t is None else codecs.single_value(bytes.fromhex(t), kind) for t in texts], dtype=object)

        return decoded

    v = version(spark, table, snapshot_id)
    live = live_files(spark, v).filter("content = 0")
    asked, stats, columns = {t.column for t in terms(where)}, {}, {"rows": F.col("record_count")}
    for k, name, kind in v.fields:
        if name not in asked or kind.startswith("{") or _PLAIN.get(kind) == "binary" or kind.startswith("fixed"):
            continue
        of = data_type(kind)
        decoded = bound(kind.replace(" ", ""), of)
        at = lambda c, k=k: F.get(F.filter(c, lambda x: x.key == k), F.lit(0))["value"]
        sound = F.coalesce(at("nan_value_counts"), F.lit(-1)) == 0 if kind in ("float", "double") else F.lit(True)
        columns |= {f"{name}_min": F.when(sound, decoded(at("lower_bounds"))), f"{name}_max": F.when(sound, decoded(at("upper_bounds"))), f"{name}_nulls": at("null_value_counts")}
        stats[name] = stats_of(name, of.simpleString(), kind != "string")
    live = live.select("*", *[c.alias(f"__{n}") for n, c in columns.items()]).withColumnRenamed("record_count", "__record_count")
    bounds = live.select("*", *[F.col(f"__{n}").alias(n) for n in columns])
    skipped = bounds.withColumn("skipped", F.coalesce(skips(where, stats), F.lit(False)))
    return skipped.select(*[c for c in live.columns if c not in [f"__{n}" for n in columns] + ["__record_count"]], F.col("rows"), F.col("file_path").alias("path"), F.col("file_size_in_bytes").alias("size"), "skipped")


# ---- partition statistics

PARTITION_STATISTICS = "spec_id int, data_record_count bigint, data_file_count int, total_data_file_size_in_bytes bigint, position_delete_record_count bigint, position_delete_file_count int, equality_delete_record_count bigint, equality_delete_file_count int, total_record_count bigint, last_updated_at bigint, last_updated_snapshot_id bigint"


def partition_statistics(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the partition-statistics files that the newest metadata names: snapshot_id, partition as name=value text,
    the specification's figures, and how the file's path was resolved. A file that is gone gives one row, MISSING, without
    figures."""
    meta = newest(spark, table).first()
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration())
    exists = lambda p: fs(p).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    figures = T.StructType.fromDDL(PARTITION_STATISTICS)
    out = spark.createDataFrame([], T.StructType([*T.StructType.fromDDL("snapshot_id bigint, resolution string, partition string"), *figures]))
    for r in meta["partition-statistics"] or []:
        path, how = resolve(r["statistics-path"], table, exists)
        head = [F.lit(r["snapshot-id"]).cast("bigint").alias("snapshot_id")]
        if not exists(path):
            out = out.unionAll(spark.range(1).select(*head, F.lit("MISSING"), F.lit(None).cast("string"), *[F.lit(None).cast(f.dataType) for f in figures]))
            continue
        rows = spark.read.parquet(files.escaped(path))
        parts = rows.schema["partition"].dataType.names if "partition" in rows.columns else []
        text = F.concat_ws("/", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col("partition").getField(n).cast("string"), F.lit("null"))) for n in parts])
        cells = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in figures]
        out = out.unionAll(rows.select(*head, F.lit(how), text, *cells))
    return out
