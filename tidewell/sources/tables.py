"""Tables: merging writes, appends, deletes and imports, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TITLE_SEPARATOR, root_title


def upserted(base: DataFrame, patch: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """base with patch's values over its own where they are not null, and patch's new keys."""
    values = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in values], F.lit(True).alias("__old"))
    p = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in values])
    out = b.join(p, keys, "full").select(*keys, *[F.coalesce(f"__p_{c}", f"__b_{c}").alias(c) for c in values], F.col("__old").isNull().alias("__new"))
    return out.withColumnRenamed("__new", flag) if flag else out.drop("__new")


def merged_ids(rows: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """One row a key with the sorted distinct union of its id arrays."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("id"))).alias(ids)) if ids not in rows.columns else rows.select(*keys, F.explode(ids).alias("__id")).groupBy(*keys).agg(F.array_sort(F.collect_set("__id")).alias(ids))


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key: the last writer wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def patched(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """base with the columns of patch that are not null."""
    values = [c for c in base.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in values if c in patch.columns])
    return base.join(p, keys, "left").select(*keys, *[F.coalesce(f"__p_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in values])


def without_document(rows: DataFrame, title: str, column: str = "title") -> DataFrame:
    """Rows but for those of a title and its sections."""
    c = F.col(column)
    return rows.where(~F.coalesce((c == title) | c.startswith(title + TITLE_SEPARATOR), F.lit(False)))


def orphans(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Stored rows whose root title is not among the imported titles."""
    keep = imported.select(F.col("title").alias("__root")).distinct()
    return stored.withColumn("__root", root_title(F.col("title"))).join(keep, "__root", "left_anti").drop("__root")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_run(rows: DataFrame, path: str, kind: str, commit: str) -> None:
    """Append an evaluation run: its kind, commit and scores as JSON."""
    struct = F.to_json(F.struct(*rows.columns)).alias("scores")
    append(rows.select(F.lit(kind).alias("eval_type"), F.lit(commit).alias("git_commit"), struct, F.current_timestamp().alias("created_at")), path)


def backfilled(rows: DataFrame, column: str, value) -> DataFrame:
    """A derived column filled in where it is null."""
    return rows.withColumn(column, F.coalesce(F.col(column), value))
