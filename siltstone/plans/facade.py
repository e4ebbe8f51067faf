"""Opening a table of any of the three formats, and the verbs over it: summary, check, lookup, plan, export.

Nothing is written to a table. A table is a set of lazy DataFrames; a verb is one plan over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import checks, planners, predicates, replay
from siltstone.sources import delta, files, iceberg, paimon


@dataclass
class Table:
    spark: SparkSession
    path: str
    format: str

    # ---- what it is made of

    def snapshots(self) -> DataFrame:
        """(snapshot_id, parent_id, at_ms)."""
        if self.format == files.ICEBERG:
            return iceberg.snapshots(iceberg.newest(self.spark, self.path)).select("snapshot_id", "parent_id", "at_ms")
        if self.format == files.PAIMON:
            rows = paimon.snapshots(self.spark, self.path)
            return rows.select(F.col("id").alias("snapshot_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.col("timeMillis").alias("at_ms"))
        own = delta.commits(self.spark, self.path)
        at = F.max(F.coalesce("commitInfo.inCommitTimestamp", "commitInfo.timestamp"))
        return own.groupBy(F.col("version").alias("snapshot_id")).agg(at.alias("at_ms")).select("snapshot_id", F.when(F.col("snapshot_id") > 0, F.col("snapshot_id") - 1).alias("parent_id"), "at_ms")

    def live_files(self, version: int | None = None) -> DataFrame:
        """(path, size, rows) of the data files that stand."""
        if self.format == files.DELTA:
            return delta.state(self.spark, self.path, version).select("path", "size", F.col("num_records").alias("rows"))
        if self.format == files.ICEBERG:
            rows = iceberg.live_files(self.spark, iceberg.version(self.spark, self.path, version)).filter("content = 0")
            return rows.select(F.col("file_path").alias("path"), F.col("file_size_in_bytes").alias("size"), F.col("record_count").alias("rows")).distinct()
        return paimon.live_files(self.spark, paimon.version(self.spark, self.path, version)).select("path", "size", "rows")

    def rows(self, version: int | None = None) -> DataFrame:
        if self.format == files.PAIMON:
            return paimon.rows(self.spark, self.path, version)
        if self.format == files.DELTA:
            return delta.rows(self.spark, self.path, version)
        return iceberg.row_fates(self.spark, self.path, version).filter("_fate = 'LIVE'").drop("_file", "_pos", "_fate")

    # ---- verbs

    def summary(self) -> DataFrame:
        """(figure, value)."""
        snapshots = self.snapshots()
        out = snapshots.agg(F.count(F.lit(1)).cast("string").alias("snapshots"), F.max("snapshot_id").cast("string").alias("newest"))
        cells = F.array(F.struct(F.lit("format").alias("figure"), F.lit(self.format).alias("value")), *[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in out.columns])
        head = out.select(F.explode(cells).alias("cell")).select("cell.*")
        sums = self.live_files().agg(F.count(F.lit(1)).cast("string").alias("files"), F.sum("size").cast("string").alias("bytes"), F.sum("rows").cast("string").alias("rows"))
        cells = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in sums.columns])
        return head.unionAll(sums.select(F.explode(cells).alias("cell")).select("cell.*"))

    def as_of(self, at_ms: int) -> int | None:
        """The newest snapshot at or before a time."""
        row = self.snapshots().filter(F.col("at_ms") <= at_ms).agg(F.max_by("snapshot_id", F.struct("at_ms", "snapshot_id")).alias("s")).first()
        return row.s

    def check(self) -> DataFrame:
        """Recorded figures against counted ones."""
        if self.format == files.PAIMON:
            rows = paimon.highest_field_checks(self.spark, self.path)
            return checks.report([checks.check(rows, "schema", F.col("id"), {"highestFieldId": (F.col("recorded"), F.col("counted"))})])
        if self.format == files.DELTA:
            own = delta.commits(self.spark, self.path)
            counted = checks.commit_metrics(delta.file_actions(own))
            metrics = F.col("commitInfo.operationMetrics")
            recorded = own.filter("commitInfo IS NOT NULL").select("version", metrics["numFiles"].cast("long").alias("added"), metrics["numRemovedFiles"].cast("long").alias("removed"), metrics["numOutputRows"].cast("long").alias("added_rows"))
            return checks.report([checks.against(recorded, counted, ["version"], ["added", "removed", "added_rows"], "commit")])
        newest = iceberg.newest(self.spark, self.path)
        counted = F.array_max(F.flatten(F.transform("schemas", lambda s: F.transform(s.fields, lambda f: f.id))))
        last = F.array_max(F.transform("snapshots", lambda s: s["sequence-number"]))
        return checks.report([checks.check(newest, "metadata", F.col("name"), {"last-column-id": (F.col("last-column-id"), counted), "last-sequence-number": (F.col("last-sequence-number"), last)})])

    def _source(self):
        return {files.DELTA: delta, files.ICEBERG: iceberg, files.PAIMON: paimon}[self.format]

    def scan_plan(self, where: str, version: int | None = None) -> DataFrame:
        """(path, size, rows, skipped) of the live files: what a filter can leave unread."""
        return self._source().plan(self.spark, self.path, predicates.parse(where), version).select("path", "size", "rows", "skipped")

    def fates(self, where: str, version: int | None = None) -> DataFrame:
        """Rows a filter matches in the files it can't skip, dead ones too, with _file, _pos and _fate."""
        parsed = predicates.parse(where)
        kept = self._source().plan(self.spark, self.path, parsed, version).filter("NOT skipped")
        return self._source().row_fates(self.spark, self.path, version, kept).filter(predicates.to_column(parsed))

    def lookup(self, where: str, version: int | None = None) -> DataFrame:
        """Rows a filter matches at a version."""
        if self.format == files.PAIMON:  # a combined row may match where none of its records does
            parsed = predicates.parse(where)
            kept = paimon.plan(self.spark, self.path, parsed, version).filter("NOT skipped")
            return paimon.rows(self.spark, self.path, version, kept).filter(predicates.to_column(parsed))
        return self.fates(where, version).filter("_fate = 'LIVE'").drop("_file", "_pos", "_fate")

    def changes(self, low: int = 0, high: int | None = None) -> DataFrame:
        """The change feed's file-level changes of a range of versions."""
        own = delta.file_actions(delta.commits(self.spark, self.path, low, high))
        top = high if high is not None else own.agg(F.max("version")).first()[0] or 0
        return replay.change_feed(own, low, top)

    def plan(self, procedure: str, now_ms: int, **options) -> DataFrame:
        """A dry run: vacuum, orphans, optimize or expire."""
        if procedure in ("vacuum", "orphans"):
            root = self.path.rstrip("/") + "/"
            listed = files.listing(self.spark, self.path).withColumn("path", F.element_at(F.split("path", root.replace(".", r"\.")), -1))
            return planners.vacuum(listed, self.live_files(), now_ms - options.get("retain_ms", 7 * 86_400_000), options.get("partitions", []))
        if procedure == "optimize":
            own = delta.state(self.spark, self.path)
            removed = F.coalesce("vector.cardinality", F.lit(0))
            own = own.select(F.col("path").alias("file"), F.to_json("partition_values").alias("part"), "size", F.col("num_records").alias("rows"), removed.alias("removed"))
            return planners.optimize(own, options.get("target", 1 << 30))
        if procedure == "expire":
            ids = self.snapshots().select(F.col("snapshot_id").alias("id"), "at_ms")
            return planners.expire_by_count(ids, now_ms, options.get("retain_ms", 3_600_000), options.get("least", 10), options.get("most", 2**31))
        raise ValueError(f"unknown procedure {procedure}")

    def inventory(self) -> DataFrame:
        return self.live_files().withColumn("format", F.element_at(F.split("path", r"\."), -1))


def open_table(spark: SparkSession, path: str) -> Table:
    kind = files.detect(spark, path)
    if kind == files.UNKNOWN:
        raise ValueError(f"no table in {path}")
    return Table(spark, path, kind)
