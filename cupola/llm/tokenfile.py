"""Token-id output: documents tokenised in id order into compressed files, and read back.

The file format is a Parquet table of segments, written by Spark's own writer, so that tasks of lost executors
write again under its commit protocol and any store that Spark writes to will do. A segment is a run of whole
documents in ascending id order; its row holds

    bucket, place   the key range and the segment's number in it: ascending (bucket, place) is ascending id
    first           ids of the bucket's documents before the segment
    doc_ids, sizes  its documents and how many ids each has, end id included
    scale, symbols, freqs         the frequency table that its blocks share
    states, words, crcs, checkpoints   its blocks, see rans

Texts are dealt to key ranges whose limits are quantiles of the id over all rows, so every task writes its range
in order and knows the offsets in it; the ranges' totals, one row each, give the global start positions.

Texts are encoded by the tokenizers library. It is called for each distinct word, the words split at ASCII white
space, at which its own pre-tokenizer always splits too; a word's ids are kept by the worker up to a fixed number.
Words of plain small letters go straight to the library's model, others through its whole pipeline. A word that may
hold one of the tokenizer's added tokens goes through it as it is written. That is sound for tokenizer files of one
kind only (see `word_wise`); with any other file whole texts go to the library.

Null and empty texts have the end id only. Repeated rows and ids are kept, in the order of their texts; null ids
come first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm import rans
from cupola.llm.common import range_bucket, shared_dir, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: The split that the word-wise way knows to end at white space: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ids of a segment, but for one that a single longer document fills.
SEGMENT = 1 << 21
#: Words whose ids a worker keeps.
KEPT_WORDS = 600_000
BLOCKS = "array<struct<states:binary,words:binary,crc:long,checkpoints:binary>>"
SCHEMA = f"bucket int, place long, first long, doc_ids array<long>, sizes array<long>, scale int, symbols binary, freqs binary, blocks {BLOCKS}"


def word_wise(made: dict) -> bool:
    """Whether a tokenizer (its JSON) gives the ids of a text by those of its words between ASCII white space, in small letters: NFC, white space drawn together, lower case; a split that no word crosses; added tokens that hold no white space and take none."""
    steps = (made.get("normalizer") or {}).get("normalizers") or []
    kinds = [x["type"] for x in steps]
    first, *rest = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and first.get("type") == "Split" and first["pattern"] == {"Regex": SPLIT} and first["behavior"] == "Removed" and first["invert"]
        and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in made["added_tokens"])
    )


class WordEncoder:
    """Whole texts by way of their words; the library does the encoding."""

    _plain = re.compile("[a-zß-öø-ÿ]+")
    #: U+0300 to U+036F; all marks that compose with an ASCII letter lie there.
    _mark = re.compile(b"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]")

    def __init__(self, path: str = TOKENIZER):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        self.by_words = word_wise(made)
        added = [t["content"].encode() for t in made["added_tokens"]]
        self._added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        bytes_as = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)):
            for raw, shown in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
                bytes_as[raw] = shown
        self.shown = bytes_as
        self.words: dict[bytes, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if self._plain.fullmatch(word):
            found = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def _word(self, raw: bytes) -> bytes:
        """A new word. A letter followed by other ASCII is always a split, so a tail of these signs is encoded apart."""
        word = raw.decode()
        if self._added and self._added.search(raw):
            return self._ids(word)
        core = word.rstrip(".,;:!?")
        if core and core != word and core[-1].isalpha() and core[-1] <= "ÿ":
            ids = b""
            for part in (core, word[len(core) :]):
                key = part.encode()
                if key not in self.words:
                    self.words[key] = self._ids(part)
                ids += self.words[key]
            return ids
        return self._ids(word)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_bytes(text.encode())

    def encode_bytes(self, raw: bytes) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if self._mark.search(raw) or (self._added and self._added.search(raw)):
            # a mark may compose with a capital and not with the small letter, and an added token is matched as written,
            # so the library sees such words as they are
            words = [w if self._mark.search(w) or (self._added and self._added.search(w)) else w.lower() for w in raw.split()]
        else:
            words = raw.lower().split()  # ASCII letters only
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > KEPT_WORDS:
                self.words = known = {}
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


@lru_cache(2)
def word_encoder(path: str = TOKENIZER) -> WordEncoder:
    return WordEncoder(path)


def _packed(seg: rans.Segment) -> dict:
    raw = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
    blocks = [{"states": raw(seg.states[b], "<u8"), "words": raw(w, "<u4"), "crc": seg.crcs[b], "checkpoints": raw(seg.checkpoints[b], "<u8")} for b, w in enumerate(seg.words)]
    return {"scale": seg.scale, "symbols": raw(seg.symbols, "<u4"), "freqs": raw(seg.freqs, "<u4"), "blocks": blocks}


def _unpacked(row: dict) -> rans.Segment:
    blocks, read = row["blocks"], np.frombuffer
    states = np.array([read(b["states"], "<u8") for b in blocks], np.uint64).reshape(-1, rans.LANES)
    return rans.Segment(
        sum(row["sizes"]), row["scale"], read(row["symbols"], "<u4"), read(row["freqs"], "<u4"), states,
        [read(b["words"], "<u4") for b in blocks], [b["crc"] for b in blocks], [read(b["checkpoints"], "<u8").reshape(-1, rans.LANES + 1) for b in blocks],
    )


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranges: int | None = None) -> None:
    """Writes the token ids of every text to path, in ascending order of the ids."""
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bucket, n = range_bucket(rows, "id", n)
    dealt = rows.withColumn("bucket", bucket.cast("int")).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "id", "text")
    kind = pa.list_(pa.struct([("states", pa.binary()), ("words", pa.binary()), ("crc", pa.int64()), ("checkpoints", pa.binary())]))
    schema = pa.schema([("bucket", pa.int32()), ("place", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("scale", pa.int32()), ("symbols", pa.binary()), ("freqs", pa.binary()), ("blocks", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        now, place, first, ids, parts, total = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            row = {"bucket": now, "place": place, "first": first, "doc_ids": ids, "sizes": [len(p) // 4 for p in parts]}
            return pa.RecordBatch.from_pylist([row | _packed(rans.encode(np.frombuffer(b"".join(parts), "<u4")))], schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                for key, raw, own in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if own != now or total >= SEGMENT:
                        if ids:
                            yield flush()
                        now, place, first = own, (place + 1 if own == now else 0), (first + total if own == now else 0)
                        ids, parts, total = [], [], 0
                    parts.append((encoder.encode_bytes(raw) if raw else b"") + end)
                    ids.append(key)
                    total += len(parts[-1]) // 4
        if ids:
            yield flush()

    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(bucket, before): ids of all ranges before each. One row a range, as many as the writer had tasks."""
    totals = files.select("bucket", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every document of the files, with the ids of all documents before it; ids as little-endian unsigned 32-bit integers. Blocks whose checksum differs fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, sizes, ids, bucket in _documents(batches):
            ends = np.cumsum(sizes)
            parts = [x.tobytes() for x in np.split(ids, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), pa.array(parts, pa.binary()), pa.array(np.full(len(sizes), bucket, np.int32))], names=["id", "start", "n_tokens", "ids", "bucket"])

    files = spark.read.parquet(path)
    return _placed(files.mapInArrow(run, "id long, start long, n_tokens long, ids binary, bucket int"), files)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["doc_ids"], row["first"], np.array(row["sizes"], np.int64), rans.decode(_unpacked(row)).astype("<u4"), row["bucket"]


def _placed(found: DataFrame, files: DataFrame) -> DataFrame:
    before = starts(files)
    return found.join(F.broadcast(before), "bucket").withColumn("start", F.col("start") + F.col("before")).drop("bucket", "before")


def checks(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, crc): as read, with the CRC-32 of each document's ids in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, sizes, ids, bucket in _documents(batches):
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(x) for x in np.split(ids, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(np.full(len(sizes), bucket, np.int32))], names=["id", "start", "n_tokens", "crc", "bucket"])

    files = spark.read.parquet(path)
    return _placed(files.mapInArrow(run, "id long, start long, n_tokens long, crc long, bucket int"), files)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/cupola-tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return checks(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
