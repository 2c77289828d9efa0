"""The change feed: events (path, kind, ts) become debounced paths, and those keep an index up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MediaOptions
from ..sources import embed, ingest, listing, media, policy
from ..sources.store import Store

KINDS = ("create", "modify", "remove")


def relevant(events: DataFrame, kinds: tuple[str, ...] = KINDS, options: MediaOptions | None = None) -> DataFrame:
    """Events of the given kinds; with `options`, only of paths that the policy allows.  A removed path is judged by its
    name alone; of others, those go that the event says are no files (`is_file`, where events have it)."""
    out = events.filter(F.col("kind").isin(*kinds))
    if options is None:
        return out
    out = out.filter(policy.classified(F.col("path"), options).isNotNull())
    return out.filter((F.col("kind") == "remove") | F.coalesce("is_file", F.lit(True))) if "is_file" in events.columns else out


def debounced(events: DataFrame, idle: str = "5 seconds", streaming: bool | None = None) -> DataFrame:
    """path, start, end and n_events of bursts: events of a path that follow each other within `idle`.

    On a stream, a burst is given out when the watermark, which lags by `idle`, has passed its end."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming if streaming is None else streaming:
        e = e.withWatermark("ts", idle)
    s = e.groupBy("path", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"), F.max_by("kind", "ts").alias("kind"))
    return s.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "last_ts", "kind")


def pending(batch: DataFrame) -> DataFrame:
    """Each path of a batch once."""
    return batch.select("path").dropDuplicates(["path"])


def dirty_union(changed: DataFrame, removed: DataFrame, events: DataFrame) -> DataFrame:
    """Paths to look at: those that a full comparison found, and those of events, each once."""
    return pending(changed.select("path").union(removed.select("path")).union(events.select("path")))


def latest_change(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    return ingest.latest(events.select("path", "kind", "ts"), ["path"], "ts")


def last_change(events: DataFrame) -> DataFrame:
    """One row: when something last changed, to the nearest millisecond (halves away from zero); null if nothing did."""
    micros = F.unix_micros(F.max(F.col("ts").cast("timestamp")))
    return events.agg((F.round(micros, -3) / 1000).cast("long").alias("last_change_ms"))


Read = Callable[[DataFrame], DataFrame]


def maintain(events: DataFrame, store: Store, read: Read, embedder: embed.Embedder, model: embed.Model, checkpoint: str, idle: str = "5 seconds", options: MediaOptions | None = None, decoders: media.Decoders | None = None, every: str | None = None) -> StreamingQuery:
    """Starts the query that applies bursts to the store.  `read` gives the scanned rows of a frame of paths; a path that
    it doesn't return is removed, and one with an error keeps what the index has.  A batch that fails as a whole leaves
    the last version as it was, and is tried again.  `every` is the least time between batches."""

    def step(batch: DataFrame, _: int) -> None:
        paths = pending(batch)
        scanned = read(paths)
        store.apply(scanned, paths.join(scanned.select("path"), "path", "left_anti"), embedder, model, options, decoders)

    writer = debounced(relevant(events, options=options), idle).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer).start()


def reader(spark, root: str, options: MediaOptions | None = None) -> Read:
    """Reads those of the paths that are eligible files under the root now."""
    o = options or MediaOptions()
    return lambda paths: listing.scan_paths(listing.listing(spark, root, o).join(paths, "path", "left_semi").select("path", "media_type"), root, o)


def reconcile(store: Store, root: str, embedder: embed.Embedder, model: embed.Model, options: MediaOptions | None = None, decoders: media.Decoders | None = None) -> int:
    """Brings the index in line with the folder: what changed while nothing watched it is indexed, what is gone goes."""
    scanned = listing.scan(store.spark, root, options)
    return store.apply(scanned, ingest.pruned(scanned, store.table("files")), embedder, model, options, decoders)


def serve(events: DataFrame, store: Store, root: str, embedder: embed.Embedder, model: embed.Model, checkpoint: str, options: MediaOptions | None = None, decoders: media.Decoders | None = None, **how: str) -> StreamingQuery:
    """A full comparison first, then the feed: an index heals itself at every start."""
    reconcile(store, root, embedder, model, options, decoders)
    return maintain(events, store, reader(store.spark, root, options), embedder, model, checkpoint, options=options, decoders=decoders, **how)


def shut_down(query: StreamingQuery, seconds: float = 5.0) -> bool:
    """Stops a feed; whether it ended in time."""
    query.stop()
    return bool(query.awaitTermination(int(seconds)))
