"""From files to index rows: what changed, what to embed, and how the tables are replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(scan: DataFrame, files: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, removed) of every file, by content hash; times do not matter."""
    a = scan.select("path", F.col("content_hash").alias("__now"))
    b = files.select("path", F.col("content_hash").alias("__was"))
    status = F.when(F.col("__now").isNull(), "removed").when(F.col("__was").isNull(), "new").when(F.col("__now") != F.col("__was"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def dirty(scan: DataFrame, files: DataFrame) -> DataFrame:
    return diff(scan, files).filter(F.col("status").isin("new", "changed")).select("path")


def pruned(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the index that are no longer there."""
    return files.select("path").join(scan.select("path"), "path", "left_anti")


def summary(scan: DataFrame, files: DataFrame) -> DataFrame:
    """scanned, dirty and pruned, as counts."""
    s = F.col("status")
    return diff(scan, files).agg(F.count_if(s != "removed").alias("scanned"), F.count_if(s.isin("new", "changed")).alias("dirty"), F.count_if(s == "removed").alias("pruned"))


def with_cache(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached embedding of their content, or null."""
    return chunks.join(cache.select("content_hash", "embedding"), "content_hash", "left")


def misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row for each content that has to be embedded."""
    return chunks.join(cache.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with `rows` in place of those of the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def replace_by_path(table: DataFrame, rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The table without anything of `paths`, and with `rows`."""
    return table.join(paths.select("path").distinct(), "path", "left_anti").unionByName(rows)


def remove_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def latest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by `order`."""
    others = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others])


def is_outside(path: Column, root: str) -> Column:
    """Absolute and not under the root; names are compared as they are."""
    return F.startswith(path, F.lit("/")) & ~F.startswith(path, F.lit(root.rstrip("/") + "/"))


def offenders(chunks: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """How many rows of both tables no relative path can be given."""
    bad = lambda t: t.agg(F.count_if(is_outside(F.col("path"), root)).alias("n"))
    return bad(chunks).union(bad(files)).agg(F.sum("n").alias("offenders"))


def relativised(table: DataFrame, root: str) -> DataFrame:
    """Absolute paths under the root, made relative."""
    base = root.rstrip("/") + "/"
    return table.withColumn("path", F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path")))
