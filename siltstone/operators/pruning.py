"""File skipping as expressions over statistics, and the two-stage scan plan.

Statistics of a column are four expressions: least, greatest, nulls and rows. `skips` turns a filter into one boolean that
is true only where no row can match, so a plan over a table of files is a projection: no file is opened and nothing loops
on the driver. An And skips if one part does, an Or if all do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.predicates import And, Filter, Term, push_negation, terms


@dataclass(frozen=True)
class Stats:
    """The columns of one column's statistics. exact: the bounds are values that occur, not truncated ones."""

    name: str
    kind: str = "string"
    exact: bool = True
    rows_name: str = "rows"

    @property
    def least(self) -> Column:
        return F.col(f"{self.name}_min")

    @property
    def greatest(self) -> Column:
        return F.col(f"{self.name}_max")

    @property
    def nulls(self) -> Column:
        return F.col(f"{self.name}_nulls")

    @property
    def rows(self) -> Column:
        return F.col(self.rows_name)


def stats_of(name: str, kind: str, exact: bool = True, rows: str = "rows") -> Stats:
    """Statistics kept in columns <name>_min, <name>_max and <name>_nulls."""
    return Stats(name, kind, exact, rows)


def _prefix_skips(t: Term, s: Stats) -> Column:
    """LIKE 'abc%' is decided over the shorter of prefix and bound, so truncated bounds stay sound."""
    body = t.value
    prefix = body[: min((body.index(c) for c in "%_" if c in body), default=len(body))]
    if not prefix:
        return F.lit(False)
    if t.op == "not like":  # only abc%, and only if every value starts with the prefix
        if body != prefix + "%" or not s.exact:
            return F.lit(False)
        return s.least.startswith(prefix) & s.greatest.startswith(prefix)
    n = F.lit(len(prefix))
    cut = lambda bound: F.substring(bound, F.lit(1), F.least(n, F.length(bound)))
    head = lambda bound: F.substring(F.lit(prefix), F.lit(1), F.least(n, F.length(bound)))
    return (cut(s.greatest) < head(s.greatest)) | (cut(s.least) > head(s.least))


def term_skips(t: Term, s: Stats, all_null_negation: bool = False) -> Column:
    """True where the statistics prove that no row matches the term; unknown statistics prove nothing."""
    if t.op == "is null":
        out = s.nulls == 0
    elif t.op == "is not null":
        out = s.nulls == s.rows
    else:
        all_null = s.nulls == s.rows
        if t.op in ("like", "not like"):
            out = _prefix_skips(t, s)
        else:
            v = F.lit(t.value).try_cast(s.kind)
            out = {"=": (v < s.least) | (v > s.greatest), "<>": (s.least == v) & (s.greatest == v) if s.exact else F.lit(False), "<": s.least >= v, "<=": s.least > v, ">": s.greatest <= v, ">=": s.greatest < v}[t.op]
        if t.op not in ("<>", "not like") or all_null_negation:
            out = F.coalesce(all_null, F.lit(False)) | F.coalesce(out, F.lit(False))
    return F.coalesce(out, F.lit(False))


def skips(f: Filter, stats: dict[str, Stats], all_null_negation: bool = False) -> Column:
    f = push_negation(f)
    if isinstance(f, Term):
        return term_skips(f, stats[f.column], all_null_negation) if f.column in stats else F.lit(False)
    found = [skips(p, stats, all_null_negation) for p in f.parts]
    out = F.lit(not isinstance(f, And) and bool(found))
    for c in found:
        out = out | c if isinstance(f, And) else out & c
    return out


def outcomes(f: Filter, stats: dict[str, Stats]) -> Column:
    """Each term's effect: SKIPS, KEEPS, or NOT_EVALUATED with the reason."""
    rows = []
    for t in terms(push_negation(f)):
        effect = F.lit("NOT_EVALUATED") if t.column not in stats else F.when(term_skips(t, stats[t.column]), "SKIPS").otherwise("KEEPS")
        rows.append(F.struct(F.lit(f"{t.column} {t.op}").alias("term"), effect.alias("effect"), F.lit(None if t.column in stats else "no statistics").alias("reason")))
    return F.array(*rows)


def column_statistics(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One aggregate for all files: <c>_min, <c>_max (NaN left out), <c>_nulls, <c>_nans and rows."""
    kinds = dict(rows.dtypes)
    out = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        own = F.col(c)
        if kinds[c] in ("double", "float"):
            out.append(F.count_if(F.isnan(own)).alias(f"{c}_nans"))
            own = F.when(~F.isnan(own), own)
        out += [F.min(own).alias(f"{c}_min"), F.max(own).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    return rows.groupBy(*by).agg(*out)


def scan_plan(files: DataFrame, manifests: DataFrame, f: Filter, manifest_stats: dict[str, Stats], file_stats: dict[str, Stats]) -> DataFrame:
    """files with their fate: NOT_REACHED (the manifest is skipped), SKIPPED or WOULD_BE_READ."""
    skipped = manifests.select("manifest_id", skips(f, manifest_stats).alias("manifest_skipped"))
    joined = files.withColumn("file_skipped", skips(f, file_stats)).join(skipped, "manifest_id")
    fate = F.when(F.col("manifest_skipped"), "NOT_REACHED").when(F.col("file_skipped"), "SKIPPED").otherwise("WOULD_BE_READ")
    return joined.withColumn("fate", fate).drop("manifest_skipped", "file_skipped")


def ruled_out(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("fate").isin("SKIPPED", "NOT_REACHED"))


def by_bucket(files: DataFrame, f: Filter, stats: dict[str, Stats], keys: list[str], bucket: list[str], skip_level_0: bool = False, by_value: bool = True) -> DataFrame:
    """Files of a merged table. Conjuncts on key columns prune each file; the whole filter prunes a bucket only if every
    file of it is skipped, since rows merge across files; folding engines never prune by value."""
    own = [t for t in (push_negation(f).parts if isinstance(push_negation(f), And) else (push_negation(f),)) if isinstance(t, Term) and t.column in keys]
    by_key = F.lit(False)
    for t in own:
        by_key = by_key | term_skips(t, stats[t.column])
    out = files.withColumn("by_key", by_key).withColumn("may_match", ~skips(f, stats))
    from pyspark.sql import Window

    whole = F.max("may_match").over(Window.partitionBy(*bucket))
    fate = F.when(F.col("by_key"), "SKIPPED_BY_KEY")
    if skip_level_0:
        fate = fate.when(F.col("level") == 0, "LEVEL_0")
    if by_value:
        fate = fate.when(~whole, "BUCKET_SKIPPED")
    return out.withColumn("fate", fate.otherwise("WOULD_BE_READ")).drop("by_key", "may_match")


def prunable_columns(stages: dict[str, DataFrame]) -> DataFrame:
    """(column_name, stages): the columns a filter could prune on, and where."""
    out = None
    for stage, df in stages.items():
        names = sorted({c[: -len("_min")] for c in df.columns if c.endswith("_min")})
        rows = df.sparkSession.createDataFrame([(n, stage) for n in names], "column_name string, stage string")
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))
