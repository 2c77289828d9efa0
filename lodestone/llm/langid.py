"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit of the code a binary logistic classifier on hashed character n-grams is
learnt.  A text is given the language whose codeword has the smallest loss-weighted distance from the bits' margins,
each bit weighted by how well it held on the training rows; a text whose two best codewords are almost as near is
flagged ambiguous.

The classifiers are fitted on the driver, on hashed counts of at most `SAMPLE` labelled rows, chosen by the smallest
hashes of their ids.  Defined cases: a null text, or one without a letter, is `und` with score 0; a null language is
not learnt from; ties between codewords go to the language that sorts first; with one learnt language every text with a
letter is of it; with none, every text is `und`; repeated rows are judged on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, release, small_batches
from .textkit import as_string, slices

UNKNOWN = "und"
#: Labelled rows that the classifiers are fitted on, and bytes of their texts, at most: the driver holds their n-grams.
SAMPLE, SAMPLE_BYTES = 4000, 24 << 20
DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.05
_LETTER = r"\p{L}"


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all texts in a row, and the offsets of the texts in them.

    White space and digits count as one blank character, and each text has a blank at either end."""
    texts = [f" {t.lower()} " for t in column.to_pylist()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
    codes[(codes < 65) | ((codes > 90) & (codes < 97))] = 32
    shift = 32 - DIMENSIONS.bit_length() + 1
    out = np.empty(len(codes) * len(ORDERS), dtype=np.uint16 if DIMENSIONS <= 1 << 16 else np.uint32)
    h = np.zeros(len(codes), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        # The n-gram that ends at each character; at a text's first characters it is shorter.
        back = order - 1
        shifted = np.full(len(codes), 32, dtype=np.uint32)
        shifted[back:] = codes[: len(codes) - back]
        for j in range(back):
            edge = at[:-1] + j
            shifted[edge[edge < len(codes)]] = 32
        h = (h ^ shifted) * np.uint32(0x85EBCA6B) + np.uint32(order)
        h ^= h >> np.uint32(15)
        out[k :: len(ORDERS)] = (h * np.uint32(0xC2B2AE35)) >> np.uint32(shift)
    return out, at * len(ORDERS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1.  Up to 6 languages: the exhaustive code.  Beyond: of some random codes the one whose nearest rows
    are the farthest apart."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        bits = (1 << (n - 1)) - 1
        rows = [[1] * bits]
        for r in range(1, n):
            run = 1 << (n - 1 - r)
            rows.append([-1 if (c // run) % 2 == 0 else 1 for c in range(bits)])
        return np.array(rows, dtype=np.int8)
    width = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        far = (width - code.astype(int) @ code.T.astype(int)) // 2
        least = int(far[~np.eye(n, dtype=bool)].min())
        if least > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, least
    assert best is not None
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def margins(self, column: pa.Array) -> np.ndarray:
        """Per text and bit, the log odds of +1 from the mean weight of its n-grams."""
        ids, at = grams(column)
        total = np.empty((len(column), self.weights.shape[1]), dtype=np.float64)
        for b in range(self.weights.shape[1]):
            total[:, b] = np.add.reduceat(self.weights[:, b][ids], at[:-1], dtype=np.float64)
        return total / np.diff(at)[:, None] * SCALE + self.bias

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the language's index, a score from 0 to 1, and whether it is ambiguous."""
        m = self.margins(column)
        loss = np.stack([(np.logaddexp(0, -m * c) * self.trust).sum(1) for c in self.code], axis=1)
        best = loss.argmin(1)
        odds = np.exp(loss.min(1)[:, None] - loss)
        odds /= odds.sum(1)[:, None]
        ranked = np.sort(odds, axis=1)
        close = ranked[:, -1] - ranked[:, -2] < AMBIGUOUS if odds.shape[1] > 1 else np.zeros(len(best), dtype=bool)
        return best, odds[np.arange(len(best)), best], close


#: What the mean weight is multiplied by, so that steps of ordinary size suffice.
SCALE = 50.0


def train(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 1) -> Model:
    """counts: per row, distinct n-gram ids and their relative frequencies."""
    names = sorted(set(languages))
    code = codewords(len(names))
    bits = code.shape[1]
    w, bias = np.zeros((DIMENSIONS, bits), dtype=np.float64), np.zeros(bits)
    if not names:
        return Model([], code, w.astype(np.float32), bias, np.ones(bits))
    target = code[[names.index(x) for x in languages]].astype(np.float64)
    share = np.bincount([names.index(x) for x in languages], minlength=len(names))
    weigh = (len(languages) / (len(names) * share))[[names.index(x) for x in languages]]
    square = np.full((DIMENSIONS, bits), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(counts)):
            ids, f = counts[i]
            m = SCALE * (f @ w[ids]) + bias
            g = -target[i] / (1 + np.exp(target[i] * m)) * weigh[i]
            grad = SCALE * f[:, None] * g
            square[ids] += grad * grad
            w[ids] -= rate * grad / np.sqrt(square[ids])
            bias -= 0.01 * g
    right = np.zeros(bits)
    for i, (ids, f) in enumerate(counts):
        right += (SCALE * (f @ w[ids]) + bias) * target[i] > 0
    trust = np.clip(np.log((right + 1) / (len(counts) - right + 1)), 0.1, None)
    return Model(names, code, w.astype(np.float32), bias, trust / trust.max())


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits the classifiers on the rows where `learn` holds and the language is known."""
    small_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    first = rows.select("h", F.octet_length("text").alias("n")).orderBy("h", "n").limit(sample).collect()
    sizes = np.cumsum([r["n"] for r in first])
    first = first[: int(np.searchsorted(sizes, SAMPLE_BYTES, side="right"))]
    if not first:
        return train([], [])
    most = first[-1]["h"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column("text"))
            for start, part in slices(texts):
                ids, at = grams(part)
                each = [np.unique(ids[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h").slice(start, len(part)), batch.column("lang").slice(start, len(part)), pa.array([x.astype(np.int32) for x, _ in each], pa.list_(pa.int32())), pa.array([(n / n.sum()).astype(np.float32) for _, n in each], pa.list_(pa.float32()))],
                    names=["h", "lang", "ids", "f"],
                )

    found = rows.filter(F.col("h") <= most).mapInArrow(lean(count), "h long, lang string, ids array<int>, f array<float>").toArrow().sort_by("h").slice(0, len(first))
    ids, f = found["ids"].combine_chunks(), found["f"].combine_chunks()
    counts = [(np.array(i.values), np.array(v.values, dtype=np.float64)) for i, v in zip(ids, f, strict=True)] if len(found) else []
    names = found["lang"].to_pylist()
    del found, ids, f
    model = train(names, counts)
    del counts
    release()
    return model


PREDICTED = "id long, lang_pred string, score double, ambiguous boolean"


def predictor(spark, model: Model):
    """A function over arrow texts that gives (language, score, ambiguous) arrays; the model is broadcast once."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        m: Model = held.value
        lettered = pc.match_substring_regex(texts, _LETTER).to_pylist()
        if not m.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        best, score, close = m.decide(texts)
        on = np.array(lettered, dtype=bool)
        return [m.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered, strict=True)], np.where(on, score, 0.0), close & on

    return predict


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and ambiguous of every document."""
    decide = predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(1))
            for start, part in slices(texts):
                lang, score, close = decide(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(lang), pa.array(score), pa.array(close)], names=["id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PREDICTED)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text is of some learnt language; `und` rows go.

    If no language was learnt, `und` says nothing, and the texts with a letter stay."""
    decide = predictor(docs.sparkSession, model)
    at = docs.columns.index(text_col)
    learnt = bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_string(batch.column(at))
            for start, part in slices(texts):
                if learnt:
                    keep = [x != UNKNOWN for x in decide(part)[0]]
                else:
                    keep = pc.match_substring_regex(part, _LETTER).to_pylist()
                yield batch.slice(start, len(part)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


__all__ = ["Model", "fit", "keep_known", "predict", "train"]
