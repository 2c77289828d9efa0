"""A folder as a change feed.  A watcher compares the folder with how it was, and appends what changed to a log of small
JSON files; the log is a streaming source like any other, so a reader resumes where it stopped."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources import listing

EVENTS = "path string, kind string, ts timestamp, is_file boolean"
State = dict[str, tuple[int, int]]


def state(root: str) -> State:
    """Time and size of every file under the root, by relative path; links, hidden and skipped names are left out."""
    out: State = {}
    for path, size in listing.relative_paths(os.path.realpath(root)):
        try:
            out[path] = os.stat(os.path.join(root, path)).st_mtime_ns, size
        except FileNotFoundError:
            continue
    return out


def changes(before: State, after: State) -> list[tuple[str, str]]:
    """path and kind of what differs."""
    out = [(p, "create") for p in after.keys() - before.keys()] + [(p, "remove") for p in before.keys() - after.keys()]
    return sorted(out + [(p, "modify") for p in after.keys() & before.keys() if after[p] != before[p]])


class Watcher:
    """Polls a folder in a thread of its own."""

    def __init__(self, root: str, log: str, seconds: float = 0.5, before: State | None = None):
        self.root, self.log, self.seconds = root, log, seconds
        self.before = state(root) if before is None else before
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        os.makedirs(log, exist_ok=True)

    def poll(self) -> int:
        """Looks once; how many events it appended."""
        after = state(self.root)
        found, now = changes(self.before, after), time.time()
        if found:
            lines = [json.dumps({"path": p, "kind": k, "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now)) + f".{int(now % 1 * 1e6):06d}Z", "is_file": k != "remove"}) for p, k in found]
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
            hidden = os.path.join(self.log, "." + name)
            with open(hidden, "w", encoding="utf-8") as f:
                f.write("\n".join(lines) + "\n")
            os.rename(hidden, os.path.join(self.log, name))
        self.before = after
        return len(found)

    def _run(self) -> None:
        while not self._end.wait(self.seconds):
            self.poll()

    def start(self) -> Watcher:
        self._thread.start()
        return self

    def stop(self, seconds: float = 5.0) -> bool:
        """Whether the thread ended in time."""
        self._end.set()
        self._thread.join(seconds)
        return not self._thread.is_alive()


def source(spark: SparkSession, log: str, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream of events; `files_per_batch` bounds what one batch takes."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(log)
