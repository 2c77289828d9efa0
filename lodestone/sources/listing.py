"""The corpus on disk as a DataFrame.  The listing runs in Python, since Spark's file source leaves out empty files and
names that begin with "_"; reading and hashing run on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MediaOptions
from . import policy


def relative_paths(root: str) -> Iterator[tuple[str, int]]:
    """Relative path and size of regular files; links are not followed, and hidden and skipped names are left out."""
    stack = [""]
    while stack:
        folder = stack.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith(".") and e.name not in policy.SKIPPED:
                        stack.append(rel)
                elif e.is_file(follow_symlinks=False) and not e.name.startswith("."):
                    yield rel, e.stat().st_size


def relative_inside(root: str, candidate: str) -> str | None:
    """The path of `candidate`, links resolved, from the root; None if it does not exist or lies outside."""
    base = os.path.realpath(root)
    try:
        real = os.path.realpath(candidate, strict=True)
    except OSError:
        return None
    rel = os.path.relpath(real, base)
    return None if rel == os.pardir or rel.startswith(os.pardir + os.sep) or os.path.isabs(rel) else rel.replace(os.sep, "/")


def listing(spark: SparkSession, root: str, options: MediaOptions | None = None) -> DataFrame:
    """path, media_type and size of the eligible files."""
    o = options or MediaOptions()
    rows = spark.createDataFrame(list(relative_paths(os.path.realpath(root))), "path string, size long")
    kinds = rows.withColumn("media_type", policy.classified(F.col("path"), o))
    return kinds.filter(F.col("media_type").isNotNull() & policy.allowed_size(F.col("media_type"), F.col("size"), o))


def scan(spark: SparkSession, root: str, options: MediaOptions | None = None) -> DataFrame:
    """path, media_type, mtime_ns, content and content_hash of the eligible files, in order of path.

    `root` is a folder that the executors can open.  A file that cannot be read has no content but an `error`; one that
    is gone by now is left out."""
    return scan_paths(listing(spark, root, options).select("path", "media_type"), root, options)


def scan_paths(found: DataFrame, root: str, options: MediaOptions | None = None) -> DataFrame:
    """The same of given eligible files (path, media_type)."""
    o, base = options or MediaOptions(), os.path.realpath(root)

    def one(path: str, kind: str) -> tuple | None:
        try:
            name = os.path.join(base, path)
            if relative_inside(base, name) is None:
                return None
            with open(name, "rb") as f:
                return path, kind, os.fstat(f.fileno()).st_mtime_ns, f.read(), None
        except FileNotFoundError:
            return None
        except OSError as e:
            return path, kind, 0, None, f"{type(e).__name__}: {e.strerror}"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, k in zip(f["path"], f["media_type"], strict=True) if (r := one(p, k))]
            yield pd.DataFrame(rows, columns=["path", "media_type", "mtime_ns", "content", "error"])

    rows = found.mapInPandas(read, "path string, media_type string, mtime_ns long, content binary, error string")
    return rows.withColumn("content_hash", policy.effective_hash(F.col("content"), F.col("media_type"), o)).orderBy("path")


def text_of(content: str = "content"):
    """A file's text; bytes that are no UTF-8 make it empty."""
    return F.coalesce(F.try_validate_utf8(F.col(content).cast("string")), F.lit(""))
