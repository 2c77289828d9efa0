"""Best-fit packing by the sum-of-squares rule: each piece goes where the squared counts of open bins per residual gap
become smallest; ties go to the smallest gap that fits, and a new bin only if it is strictly better.

Only documents longer than a sequence are cut; the first piece takes the remainder and all others are full.  Pieces are
dealt into packing groups by a hash, about `GROUP` pieces each, and each group is packed on its own, so that no task
sees more than a bounded number of pieces; what this costs is a few half-open bins per group.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once each; an empty table gives no
rows; other columns are not read; where a text holds an added token of the vocabulary file, such as its end-of-text mark,
that is one id, as the file's own library has it.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean, staged
from .textkit import as_string, slices

SEQUENCE = 2048
END_ID = 0
#: Pieces to a packing group.
GROUP = 20_000
#: Distinct words whose ids a worker keeps.
CACHE = 300_000

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
#: White space next to a space, where a cut at the space could change the tokens.
_WS = r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f"{_WS} | {_WS}|^ | $"
#: Fixed: the pattern that this kind of byte-level vocabulary splits text with before it merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary file; in such a file ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and not token.startswith("<|")}


def _added(path: str) -> dict[str, int]:
    """Ids of the vocabulary file's added tokens, which are found in a text before it is split."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token of the vocabulary takes in what stands around it; only literal ones can be encoded")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Token ids of many texts.

    A space between two characters that are no white space always begins a token of such a vocabulary, so texts are cut
    there, each distinct word is encoded once, and ids are gathered by word; texts with other spacing are encoded whole.
    The ids are those of the vocabulary file's own library (tests compare them); the merges run in a faster one.  With
    `added`, texts that hold added tokens of the file are encoded whole, cut at these; without, the literals are text.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        ranks = _ranks(path)
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in ranks.items() if token[0] == 32]] = True
        self.added = _added(path) if added else {}
        # The longest of several that begin at one place.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def _codes(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the table of known ones; those that begin with a space are learnt together."""
        new = [w for w in words if w not in self.known]
        if spaced := [w for w in new if w[:1] == " "]:
            ids = np.array(self.bpe.encode_ordinary("".join(spaced)), dtype="<u4")
            self._learn(spaced, ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))))
        if other := [w for w in new if w[:1] != " "]:
            each = [self.bpe.encode_ordinary(w) for w in other]
            self._learn(other, np.fromiter(itertools.chain.from_iterable(each), dtype="<u4"), np.fromiter(map(len, each), dtype=np.int64, count=len(each)))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def _whole(self, text: str) -> list[int]:
        if not self.cut:
            return self.bpe.encode_ordinary(text)
        return [i for k, part in enumerate(self.cut.split(text)) for i in ([self.added[part]] if k % 2 else self.bpe.encode_ordinary(part))]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by END_ID, and the offsets of the texts in them."""
        if len(self.known) > CACHE:
            self.forget()
        unsafe = pc.match_substring_regex(column, _UNSAFE)
        for token in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(column, token))
        safe = pc.if_else(unsafe, pa.scalar("", pa.large_string()), column)
        words = pc.split_pattern(safe, " ")
        at = words.offsets.to_numpy()
        at = at - at[0]
        flat = words.flatten()
        first = np.zeros(len(flat), dtype=bool)
        first[at[:-1]] = True
        # The first word of a text has no space before it; every other has.
        blank = pa.scalar("", pa.large_string())
        coded = pc.binary_join_element_wise(pc.if_else(pa.array(first), blank, pa.scalar(" ", pa.large_string())), flat, blank).dictionary_encode()
        place = self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        whole = [self._whole(t) for t in column.filter(unsafe).to_pylist()]
        extra = [*whole, [END_ID]]
        sizes = np.fromiter(map(len, extra), dtype=np.int64, count=len(extra))
        n = len(self.ends)
        place[at[:-1][unsafe.to_numpy(zero_copy_only=False)]] = n + np.arange(len(whole))
        place = np.insert(place, at[1:], n + len(whole))
        ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(extra), dtype="<u4", count=int(sizes.sum()))])
        end = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        begin = np.concatenate([[0], end[:-1]])
        length = (end - begin)[place]
        upto = np.cumsum(length)
        take = np.repeat((begin[place] - (upto - length)).astype(np.int32), length)
        take += np.arange(len(take), dtype=np.int32)
        return ids[take], np.concatenate([[0], upto[at[1:] + np.arange(len(column))]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


def cuts(n: int, size: int) -> list[int]:
    """Where the pieces of n ids begin, and n: the first piece takes the remainder."""
    rest = n % size or size
    return [0, *range(rest, n + 1, size)] if n > size else [0, n]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Token pieces of every document: id, piece, start, length and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = as_string(batch.column(1))
            for begin, part in slices(texts, 4 << 20):
                ids, at = enc.encode(part)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc, a, b in zip(batch.column(0).slice(begin, len(part)).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    where = cuts(b - a, size)
                    for k, (s, e) in enumerate(itertools.pairwise(where)):
                        rows.append((doc, k, s, e - s, zlib.crc32(ids[a + s : a + e].tobytes())))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), PIECES)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins = np.zeros(size + 1, dtype=np.int64)  # by gap; gap 0 is closed and counts as none
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s >= size:
            bins[i], made = made, made + 1
            continue
        have = open_bins[s:size]
        cost = np.where(have > 0, 2 * (open_bins[: size - s] - have) + 2, never)  # the change in the sum of squares
        gap = s
        if have[0]:
            cost[0] = 1 - 2 * have[0]  # closing a bin
        best = int(cost.argmin())
        if cost[best] <= 2 * open_bins[size - s] + 1:
            gap = s + best
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap = size
            b, made = made, made + 1
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            open_bins[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with the sequence that holds each and its place there."""
    # The place of a row in the written table tells repeated rows apart, so that they do not all go to one group.
    cut = staged(pieces(docs, vocabulary, id_col, text_col, size), "pieces")
    n = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)).cast("int")).repartition(n, "deal")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), size)
        return rows.drop(columns="deal").assign(sequence_id=(int(key[0]) << 36) + bins, offset=offsets)

    return dealt.groupBy("deal").applyInPandas(run, PACKED)


__all__ = ["SEQUENCE", "Encoder", "cuts", "pack", "pieces", "sum_of_squares"]
