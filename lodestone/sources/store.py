"""Index snapshots.  A version is one manifest: settings, and for each table the folders of Parquet that hold it.  Tables
that belong to paths are cut into buckets by a hash of the path, and a version has new folders for the buckets that a
change touches; all others are those of the version before.

A manifest is written last, under the next number, and only if no other has that number.  The current version is the
highest whole manifest, so whatever step a writer stops at, readers see one version or the other.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PATH_SCHEMA_VERSION, SCHEMA_VERSION, MediaOptions
from ..errors import FingerprintMismatch, SchemaMismatch
from ..operators import retrieval
from ..operators.chunking import chunked
from ..operators.search import Index
from . import embed, ingest, media
from .listing import text_of

CHUNKS = "path string, chunk_idx long, heading string, heading_path string, content string, content_hash string, mtime_ns long, tokens long, media_type string, mime_type string, media_start long, media_end long, media_unit string, truncated boolean"
TABLES = {
    "chunks": f"chunk_id long, {CHUNKS}",
    "vectors": "chunk_id long, embedding array<float>",
    "files": "path string, content_hash string, mtime_ns long, indexed_at long",
    "errors": "path string, error string, failed_at long",
    "cache": "content_hash string, model string, task_type string, dim long, embedding array<float>, created_at long",
}
#: Tables that are cut into buckets; the cache only grows, by a folder a version.
BUCKETED = ("chunks", "vectors", "files", "errors")
BUCKETS = 64
#: What a table of the schema before media lacks: a column, and what stands for it.
ADDED = {"media_type": "text", "truncated": False}


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _load(self, version: int) -> dict | None:
        """A manifest, or None if its writer stopped midway."""
        source = self._fs.open(self._path(f"{self.folder}/versions/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        except ValueError:
            return None
        finally:
            source.close()

    def manifest(self) -> dict:
        numbers = sorted((int(n[:-5]) for n in self._names("versions") if re.fullmatch(r"\d+\.json", n)), reverse=True)
        for n in numbers:
            if (found := self._load(n)) is not None:
                return found
        return {"version": 0, "meta": {}, "tables": {}, "next_id": 0, "buckets": self.buckets}

    def _publish(self, manifest: dict) -> int:
        taken = [int(n[:-5]) for n in self._names("versions") if re.fullmatch(r"\d+\.json", n)]
        number = max([manifest["version"], *(n for n in taken if self._load(n) is None)]) + 1
        # Without overwriting: of two writers that began from one version, the second fails and has to begin again.
        out = self._fs.create(self._path(f"{self.folder}/versions/{number:012d}.json"), False)
        out.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
        out.close()
        return number

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def meta(self) -> dict[str, str]:
        return self.manifest()["meta"]

    def get_meta(self, key: str) -> str | None:
        return self.meta().get(key)

    def set_meta(self, key: str, value: str) -> int:
        now = self.manifest()
        return self._publish(now | {"meta": now["meta"] | {key: value}})

    def file_state(self, path: str) -> tuple[str, int] | None:
        """Content hash and time of an indexed path."""
        row = self.table("files").filter(F.col("path") == path).select("content_hash", "mtime_ns").first()
        return None if row is None else tuple(row)

    # Tables

    def _folders(self, manifest: dict, name: str, buckets: set[int] | None = None) -> list[str]:
        held = manifest["tables"].get(name, {})
        return sorted(f"{self.folder}/{x}" for b, x in held.items() if buckets is None or int(b) in buckets)

    def table(self, name: str, buckets: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
        folders = self._folders(manifest or self.manifest(), name, buckets)
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(*folders)
        return rows.fillna(ADDED) if name == "chunks" else rows

    def bucket(self, path: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets))

    def _put(self, name: str, rows: DataFrame, path: str, buckets: int, work: str) -> dict[str, str]:
        """Writes rows in the buckets of their paths; folder by bucket."""
        to = f"{work}/{name}"
        cut = rows.withColumn("bucket", self.bucket(F.col(path), buckets)).select("bucket", *[c.split()[0] for c in TABLES[name].split(", ")])
        cut.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{to}")
        return {n.partition("=")[2]: f"{to}/{n}" for n in self._names(to) if n.startswith("bucket=")}

    def _work(self) -> str:
        return f"data/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _staged(self, rows: DataFrame, work: str, name: str) -> DataFrame:
        to = f"{self.folder}/{work}/work/{name}"
        rows.write.parquet(to)
        return self.spark.read.schema(rows.schema).parquet(to)

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> int:
        """The next version, with whole tables in place of the old ones; tables that are not given stay as they are.
        Vectors follow the paths of their chunks."""
        now, work = self.manifest(), self._work()
        held, buckets = dict(now["tables"]), now["buckets"]
        if "chunks" in tables and "vectors" not in tables:
            tables = tables | {"vectors": self.table("vectors", manifest=now)}
        for name, rows in tables.items():
            if name == "vectors":
                rows = rows.join(tables.get("chunks", self.table("chunks", manifest=now)).select("chunk_id", "path"), "chunk_id")
            if name in BUCKETED:
                held[name] = self._put(name, rows, "path", buckets, work)
            else:
                rows.write.parquet(f"{self.folder}/{work}/{name}")
                held[name] = {"0": f"{work}/{name}"}
        merged = {"schema_version": SCHEMA_VERSION, "path_schema_version": PATH_SCHEMA_VERSION} | now["meta"] | (meta or {})
        return self._publish(now | {"tables": held, "meta": merged})

    def vacuum(self, older_than_s: float = 3600) -> int:
        """Deletes data folders that the current version does not need and that are older than that; how many."""
        needed = {x.split("/")[1] for held in self.manifest()["tables"].values() for x in held.values()}
        old = [n for n in self._names("data") if n not in needed and int(n.split("-")[0]) < time.time_ns() - older_than_s * 1e9]
        for n in old:
            self._fs.delete(self._path(f"{self.folder}/data/{n}"), True)
        return len(old)

    # Governance

    def open(self, provider: str, model: str, dim: int, reembed: bool = False) -> str:
        """Checks schema and fingerprint: "fresh" (adopted), "match", or "rebuilt" if asked for.  An index of the schema
        before media gets the columns that it lacks."""
        if dim <= 0:
            raise SchemaMismatch("dim must be positive")
        meta, version = self.meta(), self.version
        known = meta.get("schema_version")
        if version and known not in (None, "2", SCHEMA_VERSION):
            raise SchemaMismatch(f"schema {known} is not supported")
        now = {"embedding_provider": provider, "embedding_model": model, "embedding_dim": str(dim), "schema_version": SCHEMA_VERSION}
        outcome = fingerprint(meta, provider, model, dim)
        if outcome == "mismatch":
            was = tuple(meta[k] for k in list(now)[:3])
            if not reembed:
                raise FingerprintMismatch(f"index is {was}, configuration is {tuple(now.values())[:3]}")
            self.commit({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, now)
            return "rebuilt"
        if outcome == "fresh" or known != SCHEMA_VERSION:
            tables = {"cache": self.table("cache").filter(F.col("dim") == dim)}
            self.commit(tables | ({"chunks": self.table("chunks")} if known == "2" else {}), now)
        return outcome

    def migrate_paths(self, root: str) -> tuple[str, int, int]:
        """("current" | "migrated" | "refused", chunks, files): absolute paths become relative, or none does if any is
        outside the root."""
        if not self.version or self.meta().get("path_schema_version") == PATH_SCHEMA_VERSION + "-relative":
            return "current", 0, 0
        chunks, files = self.table("chunks"), self.table("files")
        bad = ingest.offenders(chunks, files, root).first()[0]
        if bad:
            return "refused", bad, 0
        n = [t.filter(F.startswith("path", F.lit("/"))).count() for t in (chunks, files)]
        self.commit({"chunks": ingest.relativised(chunks, root), "files": ingest.relativised(files, root)}, {"path_schema_version": PATH_SCHEMA_VERSION + "-relative"})
        return "migrated", n[0], n[1]

    # Maintenance

    def apply(self, scanned: DataFrame, removed: DataFrame, embedder: embed.Embedder, model: embed.Model, options: MediaOptions | None = None, decoders: media.Decoders | None = None) -> int:
        """One atomic step: `scanned` (path, media_type, mtime_ns, content, content_hash, and error where reading failed)
        replaces what the index has of its paths, `removed` paths go.  Contents in the cache are not embedded again.

        A path that cannot be read, prepared or embedded keeps what the index has of it, and stands in `errors` until it
        succeeds or goes; it holds nothing else up.  Chunks that stay keep their ids, and so does one that takes the
        place of another in its file.  Nothing to change makes no version."""
        now, work = self.manifest(), self._work()
        buckets, clock = now["buckets"], F.unix_timestamp().cast("long")
        if "error" not in scanned.columns:
            scanned = scanned.withColumn("error", F.lit(None).cast("string"))
        read = F.col("error").isNull()
        dirty = ingest.dirty(scanned.filter(read), self.table("files", manifest=now))
        changed = scanned.join(dirty, "path", "left_semi").unionByName(scanned.filter(~read)).dropDuplicates(["path"])
        binary = dict(scanned.dtypes)["content"] == "binary"
        changed = changed.select("path", "media_type", "mtime_ns", "content_hash", "error", (text_of() if binary else F.col("content")).alias("content"), F.when(F.col("media_type") != "text", F.col("content").cast("binary")).alias("data"))
        changed = self._staged(changed, work, "changed")
        good = changed.filter(F.col("error").isNull())
        texts = chunked(good.filter("media_type = 'text'").select("path", "mtime_ns", "media_type", "content"), "content")
        texts = texts.withColumns({c: F.lit(None).cast(t) for c, t in (("mime_type", "string"), ("media_start", "long"), ("media_end", "long"), ("media_unit", "string"), ("parts", media.PARTS), ("error", "string"))}).withColumn("truncated", F.lit(False))
        shown = media.prepared(good.filter("media_type <> 'text'"), model, options or MediaOptions(), decoders or media.Decoders())
        chunks = self._staged(texts.unionByName(shown, allowMissingColumns=True), work, "chunks")
        cache = self.table("cache", manifest=now)
        fresh = self._staged(embed.embedded(ingest.misses(chunks.filter("error IS NULL"), cache), embedder, isolate=True), work, "fresh")
        unembedded = chunks.join(fresh.filter("error IS NOT NULL").select("content_hash", F.col("error").alias("why")), "content_hash").select("path", "why")
        failed = changed.filter("error IS NOT NULL").select("path", "error").unionByName(chunks.filter("error IS NOT NULL").select("path", "error")).unionByName(unembedded.select("path", F.col("why").alias("error")))
        failed = self._staged(failed.groupBy("path").agg(F.min("error").alias("error")), work, "failed")
        applied = good.join(failed, "path", "left_anti").select("path", "content_hash", "mtime_ns")
        gone = self._staged(applied.select("path").union(removed.select("path")).distinct(), work, "gone")
        # Bucket numbers, of which there is a fixed number.
        touched = {r[0] for r in gone.select(self.bucket(F.col("path"), buckets)).distinct().collect()}
        noted = touched | {r[0] for r in failed.select(self.bucket(F.col("path"), buckets)).distinct().collect()}
        if not noted:
            self._fs.delete(self._path(f"{self.folder}/{work}"), True)
            return now["version"]
        old = self.table("chunks", touched, now)
        kept, next_id = ingest.remove_paths(old, gone), now["next_id"]
        same = old.join(applied.select("path"), "path", "left_semi").select("path", "chunk_idx", "chunk_id")
        new = chunks.join(applied.select("path"), "path", "left_semi").join(same, ["path", "chunk_idx"], "left")
        ordered = new.repartitionByRange("path", "chunk_idx").sortWithinPartitions("path", "chunk_idx").withColumn("chunk_id", F.coalesce("chunk_id", F.lit(next_id) + F.monotonically_increasing_id()))
        numbered = self._staged(ordered, work, "numbered")
        columns = [c.split()[0] for c in TABLES["chunks"].split(", ")]
        vectors_of = fresh.filter("error IS NULL").select("content_hash", "embedding").unionByName(cache.select("content_hash", "embedding"))
        own = numbered.select("chunk_id", "path", "content_hash").join(vectors_of, "content_hash").select("chunk_id", "path", "embedding")
        stay = self.table("vectors", touched, now).join(kept.select("chunk_id", "path"), "chunk_id").select("chunk_id", "path", "embedding")
        states = ingest.replace_by_path(self.table("files", touched, now), applied.withColumn("indexed_at", clock), gone)
        errors = ingest.replace_by_path(self.table("errors", noted, now), failed.withColumn("failed_at", clock), gone.union(failed.select("path")))
        held = dict(now["tables"])
        for name, rows, of in (("chunks", kept.select(*columns).unionByName(numbered.select(*columns)), touched), ("vectors", stay.unionByName(own), touched), ("files", states, touched), ("errors", errors, noted)):
            held[name] = {b: x for b, x in held.get(name, {}).items() if int(b) not in of} | self._put(name, rows, "path", buckets, work)
        entries = fresh.filter("error IS NULL").select("content_hash", F.lit(model.name).alias("model"), F.lit(model.doc_task).alias("task_type"), F.lit(embedder.dim).cast("long").alias("dim"), "embedding", clock.alias("created_at"))
        entries.write.parquet(f"{self.folder}/{work}/cache")
        held["cache"] = held.get("cache", {}) | {str(now["version"] + 1): f"{work}/cache"}
        top = numbered.agg(F.max("chunk_id")).first()[0]
        merged = {"schema_version": SCHEMA_VERSION, "path_schema_version": PATH_SCHEMA_VERSION} | now["meta"] | ({"last_reindex_ms": str(time.time_ns() // 1_000_000)} if touched else {})
        self._fs.delete(self._path(f"{self.folder}/{work}/work"), True)
        return self._publish(now | {"tables": held, "meta": merged, "next_id": max(next_id, -1 if top is None else top + 1)})

    @property
    def last_reindex_ms(self) -> int:
        """When a path was last indexed anew or went; 0 if never."""
        return int(self.meta().get("last_reindex_ms", 0))

    def index(self, stem: bool = True) -> Index:
        now = self.manifest()
        chunks = self.table("chunks", manifest=now)
        terms = retrieval.indexed(chunks.filter("media_type = 'text'"), stem=stem)
        return Index(chunks, self.table("vectors", manifest=now), terms, self.table("files", manifest=now), int(now["meta"].get("embedding_dim", 0)), stem)


def fingerprint(meta: dict[str, str], provider: str, model: str, dim: int) -> str:
    """fresh if any part is missing, match if all are equal, else mismatch."""
    was = [meta.get(k) for k in ("embedding_provider", "embedding_model", "embedding_dim")]
    return "fresh" if None in was else "match" if was == [provider, model, str(dim)] else "mismatch"


def fingerprint_of(stored_provider: Column, stored_model: Column, stored_dim: Column, provider: str, model: str, dim: int) -> Column:
    """The same rule over rows of stored settings."""
    known = stored_provider.isNotNull() & stored_model.isNotNull() & stored_dim.isNotNull()
    same = (stored_provider == provider) & (stored_model == model) & (stored_dim == str(dim))
    return F.when(~known, "fresh").when(same, "match").otherwise("mismatch")
