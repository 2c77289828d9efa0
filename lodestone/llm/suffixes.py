"""Exact removal of repeated 50-byte strings by a distributed merge sort of suffixes that keeps common prefixes.

All suffixes of a corpus are too many to exchange, so sorted are those at anchors: a string of `LENGTH` bytes is anchored
at the smallest hash among its `SEED`-byte substrings, so equal strings have equal anchors at equal places.  Anchors
whose seed occurs in one document only need no sorting; an exchange of sorted fingerprints finds the others.  Each chunk
of documents sends its remaining anchored suffixes as a sorted run, front-coded, each distinct suffix once with the
smallest document that has it.  A loser tree merges the runs of a range; it knows what each suffix shares with the last
one given out and never compares that part again, and its common prefixes are what the repeats are read from.  What
stands to the left of an anchor is compared by hash first and then byte by byte.

Texts are written once, as chunks in a table bucketed by chunk, and never exchanged; what is found comes to them, a bit for
each seed and a few for each suffix.

A byte is removed if a string over it also starts in a document of smaller id.  Defined cases: a null text is empty;
texts shorter than a string lose nothing; rows that repeat an id are one document, so they lose nothing to each other;
a null id counts as smaller than all; other columns are not read; an empty table gives no row; a text longer than a chunk
is a chunk of its own, whose worker needs about five times its bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_shuffles, discard, id_text, lean, new_dir, staged
from .textkit import BYTE_BASE, U64, as_string, inverse, mix, powers, sums

LENGTH = 50
SEED = 24
SPREAD = LENGTH - SEED + 1  # places of the anchor in a string
LEFT = SPREAD - 1
#: Bytes of text to a chunk, of text whose anchors make one range, and of text that is worked on at once.
CHUNK = 8 << 20
RANGE = 12 << 20
SLICE = 1 << 19
_RECORD = LENGTH + LEFT + 2
#: Low bits of a hash that give way to the place in a slice.
_PLACE_BITS = 21
#: Stands for a null id inside of chunks.
_NULL = -(1 << 63)


def _anchors_of(data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings that start from `begin` to before `end`: each one's anchor, and the anchor's fingerprint."""
    part = data[begin : min(end + LENGTH - 1, len(data))]
    n = len(part)
    p = sums((part.astype(U64) + U64(1)) * powers(BYTE_BASE, n))
    h = mix((p[SEED:] - p[:-SEED]) * powers(inverse(BYTE_BASE), n + 1)[: n - SEED + 1])
    # The place in the low bits: of equal hashes the leftmost wins, in equal strings alike.
    m = (h >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | np.arange(len(h), dtype=U64)
    width = 1
    while width * 2 <= SPREAD:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (SPREAD - width)], m[SPREAD - width :])
    place = (m & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    return place, h


def _anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: each anchor's place, text and fingerprint, and the first and last string it anchors."""
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        end = min(begin + SLICE, len(data) - LENGTH + 1)
        place, h = _anchors_of(data, begin, end)
        start = np.arange(begin, end)
        owner = np.searchsorted(at, start, side="right") - 1
        good = start + LENGTH <= at[owner + 1]
        start, owner, place = start[good], owner[good], place[good]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        # An anchor's hash is a minimum and so is small; mixed again, fingerprints are spread evenly.
        seed = mix(h[place[first]])
        found.append(((place[first] + begin).astype(np.int32), owner[first].astype(np.int32), seed, start[first].astype(np.int32), start[last].astype(np.int32)))
    if not found:
        none = np.zeros(0, dtype=np.int32)
        return none, none, np.zeros(0, dtype=U64), none, none
    place, owner, seed, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    # An anchor whose strings two slices share is one.
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    one = np.flatnonzero(new)
    return place[one], owner[one], seed[one], first[one], last[np.append(one[1:], len(place)) - 1 if len(one) else one]


def _records(data: np.ndarray, at: np.ndarray, place: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Fixed-length records: the string to the right of an anchor, that to its left, and how much of each is real."""
    begin, end = at[owner], at[owner + 1]
    right = np.minimum(end - place, LENGTH)
    left = np.minimum(place - begin, LEFT)
    padded = np.concatenate([np.zeros(LEFT, dtype=np.uint8), data, np.zeros(LENGTH, dtype=np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[place]
    out = np.empty((len(place), _RECORD), dtype=np.uint8)
    out[:, :LENGTH] = view[:, LEFT:]
    out[:, LENGTH : LENGTH + LEFT] = view[:, :LEFT]
    out[:, :LENGTH][np.arange(LENGTH)[None, :] >= right[:, None]] = 0
    out[:, LENGTH : LENGTH + LEFT][np.arange(LEFT)[None, :] < LEFT - left[:, None]] = 0
    out[:, -2], out[:, -1] = left, right
    return out


class Chunk:
    """A chunk's texts and its anchors, in an order that every step finds again."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.place, self.owner, self.seed, self.first, self.last = _anchors(self.data, self.at)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds of the chunk, sorted, and whether several of its documents have it."""
        order = np.argsort(self.seed, kind="stable")
        s, d = self.seed[order], self.ids[self.owner[order]]
        if not len(s):
            return s, np.zeros(0, dtype=bool)
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[begin], np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)

    def shared(self, marks, ranges: int) -> np.ndarray:
        """Anchors whose seed the exchange found in several documents; `marks`: of each range, a bit for each seed."""
        seeds, back = np.unique(self.seed, return_inverse=True)
        on = np.zeros(len(seeds), dtype=bool)
        of = _range_of(seeds, ranges)
        for mark in marks:
            a, b = np.searchsorted(of, [mark["range"], mark["range"] + 1])
            on[a:b] = np.unpackbits(np.frombuffer(mark["bits"], dtype=np.uint8), count=b - a)
        return np.flatnonzero(on[back])

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct records in order, each with its smallest document, the strings it anchors (a bit each) and its seed;
        and for each chosen anchor its record."""
        records = _records(self.data, self.at, self.place[chosen], self.owner[chosen])
        keys = records.reshape(-1).view(f"S{_RECORD}") if len(chosen) else np.zeros(0, dtype=f"S{_RECORD}")
        _, index, back = np.unique(keys, return_index=True, return_inverse=True)
        docs = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(docs, back, self.ids[self.owner[chosen]])
        # Places of one record may anchor other strings, so the bits of all of them count.
        low, high = self.place[chosen] - self.last[chosen], self.place[chosen] - self.first[chosen]
        each = ((np.uint32(2) << high.astype(np.uint32)) - np.uint32(1)) ^ ((np.uint32(1) << low.astype(np.uint32)) - np.uint32(1))
        bits = np.zeros(len(index), dtype=np.uint32)
        np.bitwise_or.at(bits, back, each)
        return records[index], docs, bits, self.seed[chosen[index]], back

    def removed(self, chosen: np.ndarray, smaller: np.ndarray, docs: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Bytes covered by strings of which a smaller document has another; `smaller`: per record, the strings that a
        document smaller than the chunk's smallest has."""
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        own_first = docs[back] < self.ids[self.owner[chosen]]
        place, first, last, found = self.place[chosen], self.first[chosen], self.last[chosen], smaller[back]
        for o in range(SPREAD):
            start = place - o
            hit = start[(start >= first) & (start <= last) & (own_first | ((found >> np.uint32(o)) & 1 == 1))]
            edge[hit] += 1  # strings of one offset start at places of their own
            edge[hit + LENGTH] -= 1
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def front_coded(records: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted records: what each shares with the one before, and the rest of each."""
    common = np.zeros(len(records), dtype=np.uint8)
    if len(records) > 1:
        common[1:] = (records[1:] != records[:-1]).argmax(axis=1)
    return common.tobytes(), records[np.arange(_RECORD)[None, :] >= common[:, None]].tobytes()


class Run:
    """A front-coded run, read record by record."""

    __slots__ = ("at", "common", "head", "i", "rest", "shares")

    def __init__(self, common: bytes, rest: bytes):
        self.common, self.rest, self.i, self.at, self.head, self.shares = common, rest, -1, 0, b"", 0
        self.step()

    def step(self) -> None:
        """To the next record; `shares` is then what it has in common with the last, `head` None at the end."""
        self.i = i = self.i + 1
        if i >= len(self.common):
            self.head = None
            return
        c, at = self.common[i], self.at
        self.at = end = at + _RECORD - c
        self.head = self.head[:c] + self.rest[at:end]
        self.shares = c


def _prefix(s: bytes, t: bytes, k: int) -> int:
    """The length of the common prefix of two different records that share their first k bytes."""
    differ = int.from_bytes(s[k:], "big") ^ int.from_bytes(t[k:], "big")
    return _RECORD - (differ.bit_length() + 7) // 8


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """Loser-tree merge: for each record in order, its run, its place there, and what it shares with the one before.

    `shares` of a head is its common prefix with the record given out last.  Of two heads the one that shares more comes
    first, and the other keeps its prefix; only heads that share equally are compared, and from there on."""
    size = 1
    while size < len(runs):
        size *= 2
    tree = [-1] * size

    def first(a: int, b: int) -> bool:
        """Whether head a comes first of two runs' heads; the other then knows what it shares with it."""
        x, y = runs[a], runs[b]
        if x.shares != y.shares:
            return x.shares > y.shares
        s, t = x.head, y.head
        if s == t:
            y.shares = _RECORD
            return True
        k = _prefix(s, t, x.shares)
        if s < t:
            y.shares = k
            return True
        x.shares = k
        return False

    def build(i: int) -> int:
        if i >= size:
            return i - size if i - size < len(runs) and runs[i - size].head is not None else -1
        a, b = build(2 * i), build(2 * i + 1)
        if a < 0 or b < 0:
            return max(a, b)
        w, tree[i] = (a, b) if first(a, b) else (b, a)
        return w

    for r in runs:
        r.shares = 0
    winner = build(1)
    while winner >= 0:
        r = runs[winner]
        yield winner, r.i, r.shares
        r.step()
        i = (winner + size) >> 1
        if r.head is None:
            winner = -1
        while i:
            other = tree[i]
            if other >= 0:
                if winner < 0:
                    winner, tree[i] = other, -1
                else:
                    mine, its = runs[winner].shares, runs[other].shares
                    if mine < its or (mine == its and not first(winner, other)):
                        winner, tree[i] = other, winner
            i >>= 1


def smaller_strings(records: np.ndarray, common: np.ndarray, docs: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For merged records: a bit for each anchored string that a document smaller than the record's own has."""
    out = np.zeros(len(records), dtype=np.uint32)
    if not len(records):
        return out
    # Equal records of several runs stand together, and are one as far as their strings go.
    new = common < _RECORD
    new[0] = True
    one, of = np.flatnonzero(new), np.cumsum(new) - 1
    sides = records[one, LENGTH : LENGTH + LEFT]
    smallest, anchored = np.minimum.reduceat(docs, one), np.bitwise_or.reduceat(bits, one)
    by_doc = np.argsort(smallest, kind="stable")
    left = np.zeros(len(one), dtype=U64)
    for o in range(SPREAD):
        if o:
            left = left * U64(BYTE_BASE) + sides[:, LEFT - o].astype(U64) + U64(1)
        on = by_doc[(anchored[by_doc] >> np.uint32(o)) & 1 == 1]
        if not len(on):
            continue
        same = np.cumsum(common < LENGTH - o)[one]
        # Strings of one group stand together, that of the smallest document first.
        on, least = _grouped(mix(mix(same[on].astype(U64)) + left[on]), on)
        if not ((same[on] == same[least]).all() and (sides[on, LEFT - o :] == sides[least, LEFT - o :]).all()):
            exact = np.concatenate([same[:, None].astype(">i8").view(np.uint8), sides[:, LEFT - o :]], axis=1)
            on, least = _grouped(np.unique(exact, axis=0, return_inverse=True)[1].reshape(-1)[on], on)
        first = np.full(len(one), np.iinfo(np.int64).max)
        first[on] = smallest[least]
        out |= ((first[of] < docs).astype(np.uint32) << np.uint32(o)) & bits
    return out


def _grouped(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in groups of equal keys, and for each its group's first in the order given."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return rows, np.repeat(rows[begin], np.diff(np.append(begin, len(rows))))


def _chunked(docs: DataFrame) -> DataFrame:
    """Documents in chunks of bounded size: chunk, ids, lengths and bytes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            lengths = [len(t) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary())], names=["chunk", "ids", "lengths", "data"])

        for batch in batches:
            column = as_string(batch.column(1)).cast(pa.large_binary())
            for i, t in zip(batch.column(0).to_pylist(), column.to_pylist(), strict=True):
                ids.append(_NULL if i is None else i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    return docs.mapInArrow(lean(run), "chunk long, ids array<long>, lengths array<int>, data binary")


def _bucketed(chunks: DataFrame) -> DataFrame:
    """The chunks, written as a table bucketed by chunk, so that joins by chunk leave the texts where they are."""
    spark = chunks.sparkSession
    name = f"lodestone_chunks_{uuid.uuid4().hex}"
    writer = chunks.write.format("parquet").option("path", new_dir(spark, "chunks"))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved: the name is not needed any more
    spark.sql(f"DROP TABLE {name}")  # of an external table, the name only
    return out


def _range_of(seed: np.ndarray, n: int) -> np.ndarray:
    return ((seed >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list]]:
    """Number, chunk and what else there is of each row."""
    for batch in batches:
        for i in range(len(batch)):
            chunk, ids, lengths, data = (batch.column(k)[i] for k in range(4))
            texts = np.frombuffer(data.as_buffer(), dtype=np.uint8)
            yield chunk.as_py(), Chunk(ids.values.to_numpy(), lengths.values.to_numpy(), texts), [batch.column(k)[i].as_py() for k in range(4, batch.num_columns)]


#: Of a fingerprint, the bytes that are exchanged: enough, since a wrong hit only has a suffix sorted in vain.
_SENT = 6


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' removed runs of every document."""
    chunks = _bucketed(_chunked(id_text(docs, id_col, text_col)))
    n = max(8, -(-(chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // RANGE))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c, _ in _rows(batches):
            s, several = c.fingerprints()
            cuts = np.searchsorted(_range_of(s, n), np.arange(n + 1))
            sent = np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _SENT :])
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), number)), pa.array([sent[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()), pa.array([np.packbits(several[cuts[k] : cuts[k + 1]]).tobytes() for k in some], pa.binary())],
                names=["range", "chunk", "seeds", "several"],
            )

    def find(rows: pa.Table) -> pa.Table:
        """A bit for each seed of each chunk in one range: whether several documents or chunks have it."""
        s, several = [], []
        for sent, flags in zip(rows["seeds"].to_pylist(), rows["several"].to_pylist(), strict=True):
            own = np.zeros((len(sent) // _SENT, 8), dtype=np.uint8)
            own[:, 8 - _SENT :] = np.frombuffer(sent, dtype=np.uint8).reshape(-1, _SENT)
            s.append(own.reshape(-1).view("<u8"))
            several.append(np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=len(own)))
        at = np.concatenate([[0], np.cumsum([len(x) for x in s])])
        every, several = np.concatenate(s), np.concatenate(several)
        del s
        order = np.argsort(every, kind="stable")
        every = every[order]
        begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        size = np.diff(np.append(begin, len(every)))
        known = np.empty(len(every), dtype=bool)
        known[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], begin) > 0), size)
        bits = [np.packbits(known[a:b]).tobytes() if known[a:b].any() else None for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table([rows["chunk"], rows["range"], pa.array(bits, pa.binary())], names=["chunk", "range", "bits"])

    sent = chunks.mapInArrow(lean(seeds), "range long, chunk long, seeds binary, several binary").repartition(n, "range")
    marks = staged(sent.groupBy("range").applyInArrow(find, "chunk long, range long, bits binary").filter("bits IS NOT NULL"), "shared-seeds")
    clean_shuffles(docs.sparkSession)
    # One row a chunk and range: a chunk's rows are at most as many as there are ranges.
    by_chunk = staged(marks.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("marks")), "marks")
    discard(marks)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c, (marks,) in _rows(batches):
            records, docs_, bits, seed, _ = c.suffixes(c.shared(marks, n))
            r = _range_of(seed, n)
            order = np.argsort(r, kind="stable")
            some, begin = np.unique(r[order], return_index=True)
            out = []
            for k, mine in zip(some.tolist(), np.split(order, begin[1:]), strict=True):
                common, rest = front_coded(records[mine])
                out.append((k, number, common, rest, docs_[mine].tobytes(), bits[mine].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["range", "chunk", "common", "rest", "docs", "bits"])

    def merge(rows: pa.Table) -> pa.Table:
        held = [Run(a, b) for a, b in zip(rows["common"].to_pylist(), rows["rest"].to_pylist(), strict=True)]
        at = np.concatenate([[0], np.cumsum([len(r.common) for r in held])])
        total = int(at[-1])
        where, common = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.uint8)
        data = bytearray(total * _RECORD)
        for k, (run, i, shares) in enumerate(merged(held)):
            where[k], common[k] = at[run] + i, shares
            data[k * _RECORD : (k + 1) * _RECORD] = held[run].head
        records = np.frombuffer(data, dtype=np.uint8).reshape(total, _RECORD)
        docs_ = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["docs"].to_pylist()])[where]
        bits = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["bits"].to_pylist()])[where]
        found = np.zeros(total, dtype=np.uint32)
        found[where] = smaller_strings(records, common, docs_, bits)
        out = [found[a:b].tobytes() if found[a:b].any() else None for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table([rows["chunk"], rows["range"], pa.array(out, pa.binary())], names=["chunk", "range", "found"])

    marked = chunks.join(by_chunk.hint("shuffle_hash"), "chunk")
    sorted_runs = marked.mapInArrow(lean(runs), "range long, chunk long, common binary, rest binary, docs binary, bits binary")
    found = staged(sorted_runs.repartition(n, "range").groupBy("range").applyInArrow(merge, "chunk long, range long, found binary").filter("found IS NOT NULL"), "found")
    clean_shuffles(docs.sparkSession)
    per_chunk = found.groupBy("chunk").agg(F.collect_list(F.struct("range", "found")).alias("found"))
    answers = staged(by_chunk.join(per_chunk, "chunk", "left").select("chunk", "found", "marks"), "answers")
    discard(found)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, (found, marks) in _rows(batches):
            gone = np.zeros(len(c.data), dtype=bool)
            if marks:
                chosen = c.shared(marks, n)
                records, docs_, _, seed, back = c.suffixes(chosen)
                r = _range_of(seed, n)
                smaller = np.zeros(len(records), dtype=np.uint32)
                for x in found or ():
                    smaller[r == x["range"]] = np.frombuffer(x["found"], dtype=np.uint32)
                gone = c.removed(chosen, smaller, docs_, back)
            rows = []
            for i, a, b in zip(c.ids.tolist(), c.at[:-1].tolist(), c.at[1:].tolist(), strict=True):
                g = gone[a:b]
                step = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                rows.append((None if i == _NULL else i, b - a, int(g.sum()), len(starts), hashlib.sha256(c.data[a:b][~g].tobytes()).hexdigest(), [f"{s}-{e}" for s, e in zip(starts, ends, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string(), pa.list_(pa.string())), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    done = chunks.join(answers.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "lengths", "data", "found", "marks")
    return done.mapInArrow(lean(finish), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<string>")


__all__ = ["LENGTH", "deduplicated", "front_coded", "merged"]
