"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one last token of its BPE encoding. It is the one token that
ends there and stands validly next to the last token of the prefix before it; two neighbours are valid if BPE,
run over their joined bytes, would leave them as they are, which their own merge histories decide. So each prefix
needs only the prefixes before it: an append goes on from the last stored prefix, and an edit is encoded again
from the piece in which it begins to the first piece boundary that both texts share.

The stored prefixes are kept in a dictionary of bytes that all words of a task share: a word that begins like an
earlier one starts from their common prefix. Dictionaries are cleared at a fixed size; that costs time, never
results.

Null and empty texts have no tokens and decode to no bytes. Repeated rows are kept; a null id stays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import give_back, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Stored prefixes and pieces of a task before its dictionaries start anew.
STORED = 1_000_000
#: The same in the pipeline, whose workers share an executor's memory with what earlier stages left in it.
STAGED = 250_000
#: Rows of a batch whose texts and ids stand in Python's memory at once in the pipeline.
SLICE = 128


@lru_cache(1)
def splitter(pattern: str = public_tokenizers.PATTERN):
    import regex

    return regex.compile(pattern)


class PrefixBpe:
    """Encoder and decoder for a rank file: token bytes by id, the lower the rank the earlier the merge."""

    def __init__(self, ranks: dict[bytes, int], most: int | None = None):
        self.ranks, self.most = ranks, most or STORED
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.halves: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        self.joined: dict[tuple[int, int], int] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1 and (two := self._last_merge(b, r)):
                self.halves[r] = two
                self.joined[two] = r
        self.forget()

    @classmethod
    def load(cls, path: str = VOCABULARY, most: int | None = None) -> PrefixBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, most)

    def forget(self) -> None:
        #: prefix -> (last token, length of the prefix before that token)
        self.stored: dict[bytes, tuple[int, int]] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this token; None if lower ranks don't lead to it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            least, i = min(pairs)
            if least >= rank:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        a, b = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return None if a is None or b is None else (a, b)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b side by side.

        Their merges are undone from the last one back. Each state is what stands on either side of the boundary
        at some moment of the run; if those two would be joined before the next merge that built a or b, the
        boundary would not have held.
        """
        known = self.valid.get((a, b))
        if known is None:
            known = self.valid[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, until = a, b, len(self.bytes_of)
        while True:
            joint = self.joined.get((left, right))
            # a joint of the same rank as the next merge on the right happens first, as it stands further left
            if joint is not None and joint < until:
                return False
            lh, rh = self.halves[left], self.halves[right]
            # undo the later merge: ranks order them; equal tokens merge left to right, so the right one is later
            if lh and (not rh or left > right):
                left, until = lh[1], left
            elif rh:
                right, until = rh[0], right + 1
            else:
                return True

    def extend(self, piece: bytes, start: int = 0) -> None:
        """Stores the last token of every prefix of piece longer than start (those up to start are stored)."""
        stored, ranks = self.stored, self.ranks
        for end in range(start + 1, len(piece) + 1):
            prefix = piece[:end]
            if prefix in stored:
                continue
            for at in range(max(0, end - self.longest), end):
                token = ranks.get(prefix[at:])
                if token is None or (self.halves[token] is None and end - at > 1):
                    continue
                if at == 0 or self.compatible(stored[piece[:at]][0], token):
                    stored[prefix] = (token, at)
                    break
            else:
                raise ValueError("a byte has no token")

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, as in tiktoken
            return [whole]
        if len(piece) > 512:
            return self._encode_long(piece)
        stored = self.stored
        if len(stored) > self.most:
            self.forget()
            stored = self.stored
        if piece not in stored:
            have = len(piece) - 1
            while have and piece[:have] not in stored:
                have -= 1
            self.extend(piece, have)
        out, end = [], len(piece)
        while end:
            token, end = stored[piece[:end]]
            out.append(token)
        return out[::-1]

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same with positions instead of stored prefixes: linear memory for pieces of any length."""
        last, start = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            for at in range(max(0, end - self.longest), end):
                token = self.ranks.get(piece[at:end])
                if token is None or (self.halves[token] is None and end - at > 1):
                    continue
                if at == 0 or self.compatible(last[at], token):
                    last[end], start[end] = token, at
                    break
            else:
                raise ValueError("a byte has no token")
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        known = self.pieces
        parts = splitter().findall(text)
        try:
            return np.frombuffer(b"".join([known[p] for p in parts]), "<u4")
        except KeyError:
            if len(known) > self.most:
                self.pieces = known = {}
            for p in parts:
                if p not in known:
                    known[p] = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
            return np.frombuffer(b"".join([known[p] for p in parts]), "<u4")

    def append(self, text: str, ids: np.ndarray, more: str) -> np.ndarray:
        """The ids of text + more, from those of text: all but its last two pieces stay as they are."""
        return self.edit(text, ids, len(text), len(text), more)

    def edit(self, text: str, ids: np.ndarray, start: int, end: int, new: str) -> np.ndarray:
        """The ids after text[start:end] becomes new. Only the text near the edit is split and encoded again.

        A blank between two letters begins a piece whatever stands elsewhere; the last such one before the edit is where
        both splits begin. After the edit, the first boundary that the old and the new split share, from where both texts
        are the same, ends the change. The tokens' lengths in bytes tell which of the old ids stand outside.
        """
        result = text[:start] + new + text[end:]
        shift, begin = len(result) - len(text), self._boundary(text, start)
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids], dtype=np.int64)))
        first = len(text[:begin].encode())
        kept = ids[: np.searchsorted(ends, first)]
        boundaries = (m.start() for m in splitter().finditer(text, begin))
        at, fresh = next(boundaries, len(text)), []
        for m in splitter().finditer(result, begin):
            while at < m.start() - shift:
                at = next(boundaries, len(text))
            if at == m.start() - shift and at >= end and m.start() >= start + len(new):
                return np.concatenate((kept, np.array(fresh, "<u4"), ids[np.searchsorted(ends, first + len(text[begin:at].encode())) :])).astype("<u4")
            fresh += self.encode_piece(m.group().encode())
        return np.concatenate((kept, np.array(fresh, "<u4"))).astype("<u4")

    @staticmethod
    def _boundary(text: str, start: int) -> int:
        """The place of the last blank between two letters before `start`, 0 if there is none."""
        far, width = start, 64
        while far > 0:
            near, far = far, max(0, far - width)
            # a blank at the edge is seen with its neighbours
            for at in range(min(near, start - 2), max(far, 1) - 1, -1):
                if text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha():
                    return at
            width *= 2
        return 0

    @cached_property
    def lengths(self) -> np.ndarray:
        """The bytes of every token."""
        return np.array([len(b) for b in self.bytes_of], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def encoder(path: str = VOCABULARY, most: int | None = None) -> PrefixBpe:
    """One encoder a worker process and size of its stores; its other tables are bounded by the vocabulary."""
    return PrefixBpe.load(path, most)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids, decoded): every row's token ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids = [bpe.encode(t) if t else np.zeros(0, "<u4") for t in batch.column(1).slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 512), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["id", "ids", "decoded"]
                )
        # other work follows in this worker: its stores, some hundred MB, go back first
        bpe.forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode, with only the digests leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = (bpe.encode(t) if t else np.zeros(0, "<u4") for t in part.column(1).to_pylist())
                rows = [(len(x), hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x)).hexdigest()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id and the token ids of every document (array of int)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(most=STAGED)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                ids = [bpe.encode(t).astype(np.int32) if t else np.zeros(0, np.int32) for t in batch.column(1).slice(i, SLICE).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, SLICE), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(np.diff(ends).astype(np.int64))], names=["doc_id", "ids", "n_tokens"])
            del batch
            pa.default_memory_pool().release_unused()
        # a worker that waits for its next task holds no stores
        bpe.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long")
