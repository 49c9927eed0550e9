"""Quality classifier by co-training of two views.

The text view sees the whole text: measures of symbols, repetition, word and line shapes, and its words, hashed into a
fixed number of places. The metadata view sees what is known without it: language, source, stated length; each value
that LEAST_SEEN labelled rows have is a column of its own. Both are logistic regressions. They start from labelled
documents. In every round each view scores all documents outside the labelled sample, labels those that it is surest of, and hands
them to the other view's training set; documents of equal features count once, so a group of copies can't fill the places,
and those that the views label differently are handed to neither. Each view is calibrated (Platt) after every round on
labelled documents that neither learned from; what it is sure of is judged by that, as a view that knows little would
spoil the other. In the end the calibrated log-odds are added, the prior counted once.

What is labelled is learned from a bounded sample: of the labelled rows the first `labelled` in a hash order of doc_id
(then of features), of which every third calibrates; documents with the features of one of them are no others. All
other documents are looked at in every round, where they are, so nothing but a few hundred rows a task moves. Every
document is scored, from its whole text.

A null or empty text has measures of zero; a null language, source or length is a value of its own. Of several
labels of one document the mean decides, ties count as low quality. If the learning or the calibrating rows lack a
class, all labelled rows serve for both. Without labels of both classes nothing can be learned: all documents score 0.5
and are kept. Repeated document rows and null ids are kept and scored; rows that share an id are learned each as itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import stored, table

LABELLED = 6_000
ROUNDS = 5
#: Documents that a view hands over in a round, of each class as many as its share of the labelled rows, and the calibrated log-odds that a label must have: beyond even, and beyond the prior. A view that knows no more than the prior hands over nothing.
HANDED, SURE = 200, 2.0
#: Places of the hashed words.
WORDS = 256
#: Labelled rows that a metadata value must have to be a column.
LEAST_SEEN = 5
KEEP = 0.5

_SYMBOLS = bytes(0 if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b" \t\r\n.,;:'\"!?()-" or c >= 128) else 1 for c in range(256))
_UPPER = bytes(1 if 65 <= c <= 90 else 0 for c in range(256))
_DIGIT = bytes(1 if 48 <= c <= 57 else 0 for c in range(256))
_MARKS = bytes(1 if c in b"!?" else 0 for c in range(256))
TEXT_MEASURES = 18


def measures(raw: bytes | None) -> np.ndarray:
    """The text view of one text: TEXT_MEASURES measures, then the roots of the shares of its words by place."""
    if not raw:
        return np.zeros(TEXT_MEASURES + WORDS, np.float32)
    n = len(raw)
    words = raw.split()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = Counter(zip(words, words[1:], strict=False))
    share = lambda kinds: raw.translate(kinds).count(1) / n
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    lengths = list(map(len, words)) or [0]
    held = np.bincount([zlib.crc32(w.lower()) % WORDS for w in counts], list(counts.values()), WORDS) if counts else np.zeros(WORDS)
    own = [
        np.log1p(n), np.log1p(len(words)), share(_SYMBOLS), share(_UPPER), share(_DIGIT), share(_MARKS), len(counts) / k, max(counts.values(), default=0) / k, same / k,
        1 - len(pairs) / k, sum(c for c in pairs.values() if c > 2) / k, sum(lengths) / k, max(lengths) / 100, 1 - len(set(lines)) / max(1, len(lines)), ends / max(1, len(lines)),
        raw.count(b"|") / k, np.log1p(len(lines)), sum(w[-1:] in b"#$%&*!" for w in words) / k,
    ]
    return np.concatenate((own, np.sqrt(held / k))).astype(np.float32)


def values(lang: str | None, source: str | None, n_chars: int | None) -> list[str]:
    """The metadata view: its values by name."""
    length = None if n_chars is None else int(np.log2(max(1, n_chars)) * 2)
    return [f"{k}={'' if v is None else ':'}{'' if v is None else v}" for k, v in (("lang", lang), ("source", source), ("length", length))]


class Logistic:
    """Ridge logistic regression by Newton steps, columns brought to mean 0 and variance 1."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)


class Views:
    """Both views' regressions over a learning set, which grows by what they hand each other."""

    def __init__(self, text: np.ndarray, meta: list[list[str]], y: np.ndarray):
        seen = Counter(v for row in meta for v in row)
        self.columns = {v: i for i, v in enumerate(sorted(v for v, n in seen.items() if n >= LEAST_SEEN))}
        parts = np.arange(len(y)) % 3 == 2  # calibrates; rows are in hash order
        apart = all(len(set(y[p].tolist())) == 2 for p in (parts, ~parts))
        learn, check = (~parts, parts) if apart else (np.ones(len(y), bool),) * 2
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.sets = [[x[learn], y[learn]] for x in (text, self.encoded(meta))]
        self.checks = [(x[check], y[check]) for x in (text, self.encoded(meta))]
        self.fit()

    def encoded(self, meta: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(meta), len(self.columns)))
        for i, row in enumerate(meta):
            out[i, [self.columns[v] for v in row if v in self.columns]] = 1
        return out

    def fit(self) -> None:
        self.fitted = [Logistic().fit(x, y) for x, y in self.sets]
        self.platt = [Logistic().fit(v.logit(x)[:, None], y, 0.01) for v, (x, y) in zip(self.fitted, self.checks, strict=True)]

    def logits(self, text: np.ndarray, meta: list[list[str]]) -> list[np.ndarray]:
        """Calibrated log-odds of both views."""
        return [p.logit(v.logit(x)[:, None]) for p, v, x in zip(self.platt, self.fitted, (text, self.encoded(meta)), strict=True)]

    def hand(self, chosen: list[tuple[int, int, np.ndarray, list[str]]]) -> None:
        """Adds documents (view that labelled it, label, text view, metadata view) to the other view's set, and fits anew."""
        for own in (0, 1):
            given = [(label, text, meta) for view, label, text, meta in chosen if view == own]
            if given:
                x = self.encoded([m for _, _, m in given]) if own == 0 else np.array([t for _, t, _ in given], np.float64)
                other = self.sets[1 - own]
                self.sets[1 - own] = [np.concatenate((other[0], x)), np.concatenate((other[1], [float(label) for label, _, _ in given]))]
        self.fit()

    def __getstate__(self):
        """What scores; the learning and calibrating rows stay behind."""
        return self.__dict__ | {"sets": None, "checks": None}

    def score(self, text: np.ndarray, meta: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, metadata, combined) probabilities of high quality."""
        a, b = self.logits(text, meta)
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, np.clip(a + b - self.prior, -30, 30)))


FEATURES = "text_view binary, meta_view array<string>"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_view, meta_view, mark) of every row; text_view is 32-bit floats, mark a hash of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                text = [measures(t).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                meta = [values(*r) for r in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.list_(pa.string()))], names=["doc_id", "text_view", "meta_view"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")).mapInArrow(run, f"doc_id {kind}, {FEATURES}")
    return found.withColumn("mark", F.xxhash64("text_view", "meta_view"))


def _unpacked(text: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(text), "<f4").reshape(-1, TEXT_MEASURES + WORDS).astype(np.float64)


def surest(found: DataFrame, views: Views, taken: set[int], handed: int = HANDED) -> list:
    """Rows (view, label, doubt, mark, text_view, meta_view): of each view and label the documents that the view is surest of, those whose mark is in `taken` left out and equal marks once; `handed` at most of a view, dealt to the labels by their shares.

    A task keeps its own surest ones; the tasks' rows, a few hundred each, are then ordered.
    """
    shared, high = found.sparkSession.sparkContext.broadcast((views, taken)), round(handed / (1 + np.exp(-views.prior)))
    most = (max(1, handed - high), max(1, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken = shared.value
        best: dict[tuple[int, int], dict[int, tuple]] = {(v, k): {} for v in (0, 1) for k in (0, 1)}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                marks, text, meta = (c.to_pylist() for c in part.columns)
                for v, z in enumerate(views.logits(_unpacked(text), meta)):
                    for label in (0, 1):
                        sure, more = (z, z - views.prior) if label else (-z, views.prior - z)
                        own = {marks[j]: (-sure[j], marks[j], text[j], meta[j]) for j in np.flatnonzero((sure > SURE) & (more > SURE)).tolist() if marks[j] not in taken}
                        best[v, label] = {x[1]: x for x in sorted((best[v, label] | own).values(), key=lambda x: x[:2])[: most[label]]}
        rows = [{"view": v, "label": k, "doubt": float(d), "mark": m, "text_view": t, "meta_view": x} for (v, k), own in best.items() for d, m, t, x in own.values()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("view", pa.int32()), ("label", pa.int32()), ("doubt", pa.float64()), ("mark", pa.int64()), ("text_view", pa.binary()), ("meta_view", pa.list_(pa.string()))]))

    near = stored(found.select("mark", "text_view", "meta_view").mapInArrow(run, f"view int, label int, doubt double, mark long, {FEATURES}"), "surest")
    out = []
    for v in (0, 1):
        for label in (0, 1):
            own = near.where((F.col("view") == v) & (F.col("label") == label)).groupBy("mark").agg(*[F.first(c).alias(c) for c in near.columns if c != "mark"])
            out += own.orderBy("doubt", "mark").limit(most[label]).collect()
    return out


def train(found: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> Views | None:
    """The co-trained views from features and labels (doc_id, quality); None without labelled documents of both classes."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good"))
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id"), F.col("mark")]
    chosen = found.select("doc_id", "mark").join(quality, "doc_id").distinct().orderBy(*order).limit(labelled)
    both = found.join(F.broadcast(chosen), ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(*[F.first(c).alias(c) for c in ("text_view", "meta_view", "good")])
    rows = both.orderBy(*order).collect()
    y = np.array([float(r.good) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    views = Views(_unpacked([r.text_view for r in rows]), [r.meta_view for r in rows], y)
    taken = {r.mark for r in rows}
    for _ in range(rounds):
        given = surest(found, views, taken, handed)
        labels_of: dict[int, set[int]] = {}
        for r in given:
            labels_of.setdefault(r.mark, set()).add(r.label)
        agreed = [(r.view, r.label, _unpacked([r.text_view])[0], r.meta_view) for r in given if len(labels_of[r.mark]) == 1]
        taken |= set(labels_of)
        if not agreed:
            break
        views.hand(agreed)
    return views


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) for every document row."""
    found = stored(features(docs), "quality")
    shared = docs.sparkSession.sparkContext.broadcast(train(found, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                half = np.full(part.num_rows, 0.5)
                scores = views.score(_unpacked(part.column(1).to_pylist()), part.column(2).to_pylist()) if views else (half, half, half)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores), pa.array(scores[2] >= KEEP)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text_view", "meta_view").mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, keep boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
