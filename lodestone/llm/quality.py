"""Quality classification: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader steps and
applied as sparse dot products.

A text's words are its runs of non-blank bytes.  Each word counts under its lower-cased form, in lower-cased word pairs
and word triples, under its shape (runs of lower case, upper case and digits shrunk to one sign each, other signs kept),
in shape pairs and shape triples, and with whether it repeats one of the two words before it.

The model is fitted on the driver, on at most `SAMPLE` labelled rows, chosen by the smallest hashes of their ids.
Defined cases: a null or blank text has one feature of its own, so its score is a learnt one; null labels are not learnt
from; a text with several labels is learnt with each; with no label at all every score is 0.5; repeated rows are judged
on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .textkit import BYTE_BASE, LOWER, U64, as_string, inverse, mix, powers, raw, slices, sums

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 4000
BITS = 18
#: What relative frequencies are multiplied by, so that steps of ordinary size suffice.
SCALE = 20.0

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_FAMILIES = 7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and the offsets of the texts in them; each text has one at least."""
    data, at = raw(column)
    n = len(data)
    solid = ~_BLANK[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[at[:-1][at[:-1] < n]] = False
    last = at[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, at)
    count = np.diff(first)

    def spans(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        prefix = sums((values.astype(U64) + U64(1)) * powers(BYTE_BASE, len(values)))
        return mix((prefix[b] - prefix[a]) * powers(inverse(BYTE_BASE), len(values) + 1)[a])

    if not len(start):
        word = shape = np.zeros(0, dtype=U64)
    else:
        word = spans(LOWER[data], start, end)
        kind = _CLASS[data]
        kept = np.ones(n, dtype=bool)
        kept[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 3)
        kept[start] = True
        where = np.concatenate([[0], np.cumsum(kept)])
        shape = spans(kind[kept], where[start], where[end])
    m = len(word)
    out = np.zeros((m, _FAMILIES), dtype=np.int64)
    if m:
        index = np.arange(m) - np.repeat(first[:-1], count)
        out[:, 0] = _bucket(word, 1)
        out[:, 1] = _bucket(shape, 2)
        for unit, column, family in ((shape, 2, 3), (word, 5, 7)):
            two = unit * U64(3) + np.where(index >= 1, np.roll(unit, 1), U64(1))
            out[:, column] = _bucket(two, family)
            three = two * U64(5) + np.where(index >= 2, np.roll(unit, 2), U64(1))
            out[:, column + 1] = _bucket(three, family + 1)
        again = np.zeros(m, dtype=U64)
        again[1:] += ((index[1:] >= 1) & (word[1:] == word[:-1])).astype(U64)
        again[2:] += ((index[2:] >= 2) & (word[2:] == word[:-2])).astype(U64) * U64(2)
        out[:, 4] = _bucket(again, 5)
    flat = out.reshape(-1)
    empty = np.flatnonzero(count == 0)
    flat = np.insert(flat, first[:-1][empty] * _FAMILIES, int(_bucket(np.zeros(1, dtype=U64), 6)[0]))
    sizes = np.where(count == 0, 1, count * _FAMILIES)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _bucket(x: np.ndarray, family: int) -> np.ndarray:
    return (mix(x + U64(family * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        ids, at = features(column)
        if not len(column):
            return np.zeros(0)
        total = np.add.reduceat(self.weights[ids], at[:-1], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(SCALE * total / np.diff(at) + self.bias, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 3) -> Model:
    """rows: distinct feature ids and their relative frequencies.  Per-coordinate FTRL-proximal steps."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, f = rows[i]
            x = SCALE * f
            w = weight(z[ids], n[ids])
            wb = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + wb, -30, 30)))
            g = (p - labels[i]) * x
            gb = p - labels[i]
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * wb
            nb += gb * gb
    return Model(weight(z, n).astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on the rows of `labels` (id, label) where `learn`, a condition on the id, holds."""
    known = labels.filter(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col)).alias("h"))
    most = known.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if most is None:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    # At most `sample` rows, and those that share the last hash: small enough to send to every executor.
    chosen = F.broadcast(known.filter(F.col("h") <= most))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("h", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(2))
            for start, part in slices(texts):
                ids, at = features(part)
                each = [np.unique(ids[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array([x.astype(np.int32) for x, _ in each], pa.list_(pa.int32())), pa.array([(c / c.sum()).astype(np.float32) for _, c in each], pa.list_(pa.float32()))],
                    names=["h", "y", "ids", "f"],
                )

    found = rows.mapInArrow(lean(count), "h long, y int, ids array<int>, f array<float>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).slice(0, sample)
    if not len(found):
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    ids, f = found["ids"].combine_chunks(), found["f"].combine_chunks()
    return train([(np.asarray(i.values), np.asarray(v.values, dtype=np.float64)) for i, v in zip(ids, f, strict=True)], found["y"].to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(1))
            for start, part in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(held.value.score(part))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, score double")
