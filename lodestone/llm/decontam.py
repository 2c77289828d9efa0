"""Benchmark decontamination: windows of benchmark words, held in a broadcast hash set, are looked up in every text.

Lower-casing is ASCII only; a word is a run of digits, letters and characters beyond ASCII.  A window is `size`
consecutive words of one item; an item of fewer words (but not none) is one window.  Hash hits are verified on the
words themselves, so results are exact.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; items that share
a window are all reported; repeated rows are each judged on their own; an empty benchmark hits nothing; items without an
id hit words as others do and are, together, one item without a name.  Columns besides the id and the text are left alone
by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, lean, small_batches
from .textkit import U64, Words, as_string, slices

WINDOW = 13
#: Text of the benchmark that one broadcast set is built from; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 32 << 20
_BITS = 20

SPANS = "id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"


def _in_order(items: set[int | None]) -> list[int | None]:
    """Sorted, with the items without an id last."""
    return sorted(items - {None}) + [None] * (None in items)


class WindowSet:
    """Windows of benchmark items by hash, with a bit table that turns most lookups away."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.owners: dict[int, list[tuple[bytes, list[int | None]]]] = {}
        grouped: dict[int, dict[int, dict[bytes, set[int | None]]]] = {}
        for item, text in items:
            words = Words(as_string(pa.array([text], pa.string())))
            n = len(words.hash)
            if not n:
                continue
            length = min(n, size)
            hashes, where = words.windows(length)
            data = words.data.tobytes()
            for h, i in zip(hashes.tolist(), where.tolist(), strict=True):
                key = b" ".join(data[s:e] for s, e in zip(words.start[i : i + length].tolist(), words.end[i : i + length].tolist(), strict=True))
                grouped.setdefault(length, {}).setdefault(h, {}).setdefault(key, set()).add(item)
        for length, found in grouped.items():
            hashes = np.array(sorted(found), dtype=U64)
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[hashes >> U64(64 - _BITS)] = True
            self.by_length[length] = hashes, bits
            for h, keys in found.items():
                self.owners.setdefault(h, []).extend((k, _in_order(v)) for k, v in keys.items())

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[int | None], list[tuple[int, int]]]]:
        """For each text: words, words that are hit, items, and hit runs of words as (first, past the last)."""
        words = Words(column)
        items: dict[int, set[int | None]] = {}
        edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
        data = None
        for length, (hashes, bits) in self.by_length.items():
            found, where = words.windows(length)
            maybe = np.flatnonzero(bits[found >> U64(64 - _BITS)])
            maybe = maybe[np.isin(found[maybe], hashes)]
            if not len(maybe):
                continue
            data = data or words.data.tobytes()
            owner = words.text_of(where[maybe])
            for h, i, text in zip(found[maybe].tolist(), where[maybe].tolist(), owner.tolist(), strict=True):
                key = b" ".join(data[s:e] for s, e in zip(words.start[i : i + length].tolist(), words.end[i : i + length].tolist(), strict=True))
                for known, ids in self.owners[h]:
                    if known == key:
                        items.setdefault(text, set()).update(ids)
                        edge[i] += 1
                        edge[i + length] -= 1
        hit = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        for t, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            n_hit = int(total[b] - total[a])
            runs: list[tuple[int, int]] = []
            if n_hit:
                step = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                runs = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
            yield b - a, n_hit, _in_order(items.get(t, set())), runs


def _blocks(b: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of bounded size; the usual benchmark is one block."""
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        rows = b if n == 1 else b.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in rows.collect()]


def _united(scans: tuple[tuple[int, int, list[int | None], list[tuple[int, int]]], ...]) -> tuple[int, int, list[int | None], list[tuple[int, int]]]:
    """One text's scans by several blocks as one scan: runs that meet or overlap are one run."""
    if len(scans) == 1:
        return scans[0]
    runs: list[tuple[int, int]] = []
    for s, e in sorted(r for x in scans for r in x[3]):
        if runs and s <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(e, runs[-1][1])
        else:
            runs.append((s, e))
    return scans[0][0], sum(e - s for s, e in runs), _in_order({i for x in scans for i in x[2]}), runs


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted) and spans (hit runs as word positions, end exclusive)."""
    held = [docs.sparkSession.sparkContext.broadcast(WindowSet(b, size)) for b in _blocks(id_text(benchmark, item_col, item_text_col))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), as_string(batch.column(1))
            for start, part in slices(texts):
                rows = [_united(r) for r in zip(*(known.value.scan(part) for known in held), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(part)),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                        pa.array([[{"start": s, "end": e} for s, e in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["id", "n_words", "n_hit", "items", "spans"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(lean(scan), SPANS)


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit runs of every document."""
    h = hits(docs, benchmark, size=size, **columns)
    named = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return h.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)).alias("hit_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", text_col: str = "text", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents without contaminated ones ("drop"), or with every hit run of words cut out ("spans").

    Works row by row on all columns of `docs`; the benchmark must fit one block.  A cut leaves one space.
    """
    if action not in ("drop", "spans"):
        raise ValueError("action is drop or spans")
    small_batches(docs.sparkSession)
    blocks = list(_blocks(id_text(benchmark.withColumn("__i", F.lit(0)), "__i", item_text_col)))
    held = [docs.sparkSession.sparkContext.broadcast(WindowSet(b, size)) for b in blocks]
    schema = T.StructType(docs.schema.fields)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(at))
            for start, part in slices(texts):
                rows = batch.slice(start, len(part))
                spans: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
                counts = [0] * len(part)
                for known in held:
                    for i, (n, _, _, runs) in enumerate(known.value.scan(part)):
                        counts[i] = n
                        spans[i] += runs
                bad = [len({w for s, e in runs for w in range(s, e)}) for runs in spans]
                if action == "drop":
                    keep = pa.array([not (b and 20 * b >= n) for b, n in zip(bad, counts, strict=True)])
                    yield rows.filter(keep)
                else:
                    words = Words(part)
                    data = part.to_pylist()
                    for i, runs in enumerate(spans):
                        if runs:
                            text, f, o = data[i].encode(), words.first[i], words.at[i]
                            for s, e in sorted(runs, reverse=True):
                                text = text[: words.start[f + s] - o] + b" " + text[words.end[f + e - 1] - o :]
                            data[i] = text.decode()
                    old = batch.column(at).slice(start, len(part))
                    new = pa.array([None if o is None and not s else d for o, d, s in zip(old.to_pylist(), data, spans, strict=True)], old.type)
                    cols = [c if k != at else new for k, c in enumerate(rows.columns)]
                    yield pa.RecordBatch.from_arrays(cols, schema=rows.schema)

    return docs.mapInArrow(lean(scan), schema)
