"""Near-duplicate classes by order MinHash and banded alignment.

A text is a sequence of word shingles, each labelled with its occurrence number.  A sketch takes, under one hash order,
the `several` smallest labelled shingles and hashes them in text order; texts that share any of `sketches` sketches meet
in a bucket.  Two texts are linked if their shingle sequences align well: with L shingles matched in order, L / (n1 + n2
- L) has to reach `similarity`.  An alignment of that quality stays within a band around the diagonal, which bounds the
search.  Classes are the connected components of links and exact copies (equal word sequences).

Within a bucket, the member of smallest id is compared with all others.  Then, in buckets whose members are not yet of
one class, the pairs between classes that remain are looked at too, in rounds of a bounded number for each document that
use the classes so far.  A pair goes on to the alignment only if the parities of its shingles allow for the similarity,
which they always do if it is reached; so no link between members of a bucket is lost, and a group of copies never
becomes all of its pairs.

Defined cases: a null or wordless text is a class of its own; a text of fewer words than a shingle is one shingle, so
only equal ones link; rows with an equal id are one document; other columns are not read; an empty table has no class.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean, look_up, staged
from .textkit import U64, WORD_BASE, Words, as_string, inverse, mix, powers, slices, sums

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a sketch of 5 agrees with probability 0.8 ** 5; all of 30 differ once in 150,000 pairs.  Pairs of
#: similarity 0.3 and less, which a common passage makes by the thousand, rarely meet.
SEVERAL = 5
SKETCHES = 30
#: In texts of up to 40 shingles, where one more changes much, 12 sketches of two shingles are taken besides; so they are
#: in all texts that are similar to one of these, which have 40 / 0.8 shingles at most.
SHORT, SHORT_SKETCHES = int(40 / SIMILARITY), 12
LINKS_PER_PART = 50_000
#: Meetings of two classes' members that are looked at in one round, for each document.
MEETINGS_PER_DOCUMENT = 250
_SECOND_BASE = 0xA0761D6478BD642F
#: Bits of the table that keeps texts without a partner from being read again into the alignment.
_BITS = 1 << 24


def sequences(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts in a row, and the offsets of the texts in them."""
    hashes, where = words.windows(size)
    owner = words.text_of(where)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes = np.concatenate([hashes, whole(words, WORD_BASE)[short]])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(counts) + 1))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    number = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    labelled = np.empty_like(hashes)
    labelled[order] = mix(h + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    return labelled, at


def whole(words: Words, base: int) -> np.ndarray:
    """A hash of each text's word sequence."""
    n = len(words.hash)
    p = sums(words.hash * powers(base, n))
    a, b = words.first[:-1], words.first[1:]
    return mix((p[b] - p[a]) * powers(inverse(base), n + 1)[a] + words.counts.astype(U64))


def _orders(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, size=(n, 1), dtype=np.uint64) * U64(2) + U64(1)


_keys: dict[int, np.ndarray] = {}


def sketch(labelled: np.ndarray, sketches: int, several: int) -> np.ndarray:
    """Order-MinHash values of one text's labelled shingles."""
    if 2 < len(labelled) <= SHORT and several > 2:
        return np.concatenate([_sketch(labelled, sketches, several), ~_sketch(labelled, SHORT_SKETCHES, 2)])
    return _sketch(labelled, sketches, several)


def _sketch(labelled: np.ndarray, sketches: int, several: int) -> np.ndarray:
    if sketches not in _keys:
        _keys[sketches] = _orders(2 * sketches)
    keys = _keys[sketches]
    v = labelled[None, :] * keys[:sketches]
    v ^= v >> U64(31)
    v *= keys[sketches:]
    n = len(labelled)
    least = np.argpartition(v, several - 1, axis=1)[:, :several] if n > several else np.tile(np.arange(n), (sketches, 1))
    picked = labelled[np.sort(least, axis=1)]
    weights = powers(_SECOND_BASE, picked.shape[1] + 1)[1:]
    return mix((picked * weights[None, :]).sum(axis=1, dtype=U64) + np.arange(sketches, dtype=U64))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sequences of distinct signs match in order well enough."""
    na, nb = len(a), len(b)
    # L / (na + nb - L) >= s, so L >= s / (1 + s) (na + nb)
    need = int(np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9))
    if min(na, nb) < need or len(np.intersect1d(a, b, assume_unique=True)) < need:
        return False
    m = min(na, nb)
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[na - (m - head) :][::-1] != b[nb - (m - head) :][::-1])
    tail = int(differ[0]) if len(differ) else m - head
    a, b = a[head : na - tail], b[head : nb - tail]
    return head + tail + _banded(a, b, na + nb - 2 * need) >= need


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence along paths that leave the diagonal by `band` at most; row by row, with
    the 2 * band + 1 cells of a row in the bits of one integer: a cell is 0 where the length grows.  Cells that leave
    the band are counted, those that enter it are 1."""
    if not len(a) or not len(b):
        return 0
    place = {x: i for i, x in enumerate(a.tolist())}
    band = min(band, max(len(a), len(b)))
    width = 2 * band + 1
    full = (1 << width) - 1
    v, length, row = full, 0, 0
    for j, x in enumerate(b.tolist()):
        i = place.get(x)
        if i is None or abs(i - j) > band:
            continue
        if j > row:
            gone = min(j - row, width)
            length += gone - (v & ((1 << gone) - 1)).bit_count()
            v = (v >> gone) | (full ^ (full >> gone))
            row = j
        u = v & (1 << (i - j + band))
        v = ((v + u) | (v - u)) & full
    return length + width - v.bit_count()


def parities(labelled: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the number of shingles that hash to it.  Bits that differ between two texts are no
    more than the shingles that they do not share, so this turns pairs away without a mistake."""
    odd = np.bincount((labelled >> U64(54)).astype(np.int64), minlength=1024).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


SKETCHED = "id long, f1 long, f2 long, n int, sketch array<long>, parity array<long>"


def sketched(docs: DataFrame, size: int, sketches: int, several: int) -> DataFrame:
    """Per document: fingerprints of its word sequence, number of shingles, and sketches (none if it is one shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(1))
            for start, part in slices(texts):
                words = Words(part)
                labelled, at = sequences(words, size)
                some = pa.array(words.counts > 0)
                f1, f2 = (pa.array(whole(words, base).view(np.int64)) for base in (WORD_BASE, _SECOND_BASE))
                none = pa.scalar(None, pa.int64())
                each = [sketch(labelled[a:b], sketches, several).view(np.int64) if b - a and w >= size else None for a, b, w in zip(at[:-1], at[1:], words.counts, strict=True)]
                odd = [None if s is None else parities(labelled[a:b]) for s, a, b in zip(each, at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.compute.if_else(some, f1, none), pa.compute.if_else(some, f2, none), pa.array(np.diff(at), pa.int32()), pa.array(each, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    names=["id", "f1", "f2", "n", "sketch", "parity"],
                )

    return docs.mapInArrow(lean(run), SKETCHED)


def _bit(column):
    return F.pmod(F.xxhash64(column), F.lit(_BITS))


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bit table, of fixed size, of the hashes of ids."""
    rows = ids.select(_bit(F.col("id")).alias("b")).groupBy(F.shiftright("b", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("m")).collect()
    bits = np.zeros(_BITS // 8, dtype=np.uint8)
    for k, m in rows:
        bits[k * 4096 : (k + 1) * 4096] = np.frombuffer(m, dtype=np.uint8)
    return bits


def _sequences_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Shingle sequences of at least the documents in `ids`: what the bit table lets through is not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(_wanted(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((held.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1))
            texts = as_string(batch.column(1))
            for start, part in slices(texts):
                labelled, at = sequences(Words(part), size)
                signs = pa.array(labelled.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), signs)], names=["id", "seq"])

    return docs.select("id", "text", _bit(F.col("id")).alias("b")).mapInArrow(lean(run), "id long, seq array<long>")


def verified(pairs: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v, and what else stands with them), those that align."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(batch.column(len(columns)), batch.column(len(columns) + 1), strict=True)]
            yield batch.select(list(range(len(columns)))).filter(pa.array(keep, pa.bool_()))

    left = seqs.select(F.col("id").alias("u"), F.col("seq").alias("su"))
    right = seqs.select(F.col("id").alias("v"), F.col("seq").alias("sv"))
    return pairs.join(left, "u").join(right, "v").select(*columns, "su", "sv").mapInArrow(lean(run), pairs.schema)


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id of its component, for every id that has a link.  Labels spread along links; from the third
    round on, they also jump to their own label's label."""
    # Links are few beside documents: their number, not the session's setting, says into how many parts they go.
    parts = max(8, links.count() // LINKS_PER_PART)
    both = staged(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).distinct().coalesce(parts), "links")
    labels = staged(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")).coalesce(parts), "labels")
    total, rounds = None, 0
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total, rounds = now, rounds + 1
        spread = both.join(labels, both.u == labels.id).select(F.col("v").alias("id"), "label")
        new = labels.union(spread).groupBy("id").agg(F.min("label").alias("label"))
        labels = staged(new.coalesce(parts), "labels")
        if rounds > 2:
            own = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = staged(labels.join(own, "label").select("id", F.col("next").alias("label")).coalesce(parts), "labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES, several: int = SEVERAL) -> DataFrame:
    """id and class_id (the smallest id of its class) of every document."""
    source = id_text(docs, id_col, text_col)
    known = staged(sketched(source, size, sketches, several), "sketches")
    n, places = known.count(), sketches + SHORT_SKETCHES
    # Exact copies: one row a distinct word sequence.
    distinct = staged(known.filter("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows")), "distinct")
    reps = known.filter("sketch IS NOT NULL").join(distinct.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"]).select("id", "n", F.posexplode("sketch").alias("place", "bucket"))
    reps = staged(reps.dropDuplicates(["id", "bucket"]), "buckets")
    rows = reps.count()
    grouped = staged(reps.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.min("id").alias("center"), F.min_by("n", "id").alias("center_n")).filter("n_rows > 1"), "shared")
    members = staged(look_up(reps, grouped, ["bucket"], rows).filter("center IS NOT NULL"), "members")
    fits = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    seqs = staged(_sequences_of(source, members.select("id").distinct(), size), "sequences")

    pairs = members.filter((F.col("id") != F.col("center")) & fits(F.col("n"), F.col("center_n"))).select(F.col("center").alias("u"), F.col("id").alias("v")).distinct()
    links = staged(verified(pairs, seqs, similarity), "verified")
    labels = components(links)
    rest, turn = members.filter("id != center").select("bucket", "id", "n", "place"), 0
    while True:
        # Members that were not yet compared with all, with their class so far, of buckets that hold several classes.
        rest = rest.join(labels, "id", "left").select("bucket", "id", "n", "place", F.coalesce("label", "id").alias("label"))
        rest = staged(rest, "rest")
        per_class = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        mixed = staged(per_class.groupBy("bucket").agg(F.sum("c").alias("n_rows"), F.count("*").alias("k"), F.sum(F.col("c") * F.col("c")).alias("squares")).filter("k > 1"), "mixed")
        left, size_of_all = mixed.agg(F.sum((F.col("n_rows") * F.col("n_rows") - F.col("squares")) / 2), F.sum("n_rows")).first()
        if not left:
            break
        open_rows = look_up(rest, mixed.select("bucket", "n_rows"), ["bucket"], int(size_of_all)).filter("n_rows IS NOT NULL").drop("n_rows")
        # A share of the members, chosen by hash, is compared with all; then they are done with.
        blocks = max(1, -int(-left // max(1_000_000, MEETINGS_PER_DOCUMENT * n)))
        signs = known.filter("sketch IS NOT NULL").select("id", *[F.shiftright(F.get("sketch", F.lit(i)), 32).cast("int").alias(f"s{i}") for i in range(places)], *[F.col("parity")[i].alias(f"p{i}") for i in range(16)]).dropDuplicates(["id"])
        open_rows = staged(open_rows.withColumn("head", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(blocks)) == 0).join(signs, "id"), "open")
        a, b = open_rows.filter("head").alias("a"), open_rows.alias("b")
        met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.label") != F.col("b.label")) & (~F.col("b.head") | (F.col("a.id") < F.col("b.id"))) & fits(F.col("a.n"), F.col("b.n"))
        unshared = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(16)])
        met = met & (unshared <= (F.col("a.n") + F.col("b.n")) * F.lit(1 - 2 * similarity / (1 + similarity) + 1e-9))
        for i in range(places):  # a pair counts in the first of the buckets that it meets in
            met = met & ((F.col("a.place") <= i) | ~F.coalesce(F.col(f"a.s{i}") == F.col(f"b.s{i}"), F.lit(False)))
        pairs = a.join(b, met).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.label").alias("a"), F.col("b.label").alias("b"))
        # Classes are joined by one link each, however many there are between them.
        new = staged(verified(pairs, seqs, similarity).select("a", "b").distinct(), "verified")
        if new.count():
            wider = components(new.select(F.col("a").alias("u"), F.col("b").alias("v")))
            moved = labels.join(wider.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = staged(moved.unionByName(wider).groupBy("id").agg(F.min("label").alias("label")), "labels")
        if blocks == 1:
            break
        rest, turn = open_rows.filter("NOT head").select("bucket", "id", "n", "place"), turn + 1
    named = distinct.join(labels, distinct.rep == labels.id, "left").select("f1", "f2", "n_rows", F.coalesce("label", "rep").alias("class_id"))
    named = staged(named, "classes")
    return look_up(known.select("id", "f1", "f2"), named, ["f1", "f2"], n).select("id", F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without those that a class's document of smallest id stands for."""
    gone = classes(docs, id_col, text_col, **options).filter("id != class_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
