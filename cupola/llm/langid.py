"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of letter n-grams, n = 1 to 3, that occur in both (presence, not counts),
over the root of the product of their own numbers. Nyström features take the kernel values to a bounded set of
landmark texts through the inverse root of the landmarks' own kernel matrix; one ridge regression against the
rest is solved per language. A batch of texts is scored by matrix products: presence x landmark grams, a sparse
product as a text has few of all grams, then kernel values x coefficients.

An n-gram is a 63-bit number, 21 bits a letter, so every letter of every script counts as itself.

Learning uses a bounded, documented sample. A row's place is a hash of doc_id and text. Of each language those rows
are candidates whose hash lies in the part of its range that holds 2 x per_lang rows of the language's count; of the
distinct ones, in the order of the hash, the first `per_lang` with at most a fair share of LEARN_BYTES together are
learned (a text longer than a quarter of that share isn't). With more than MOST_ROWS / per_lang languages each gets
fewer rows, one at least. `landmarks` in all are landmarks, dealt evenly to the languages, one each at least.
Scoring reads every whole text of every row.

Null texts and texts without a letter get `und` with score 0; so does everything if there is nothing to learn
from. A row with a null doc_id is not held out and not learned from. Repeated rows are kept, and learned once; of rows
that share a doc_id each is learned as itself. Scores are the winning regression value brought from [-1, 1] to
[0, 1]; equal values go to the first language in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm.common import table

PER_LANG = 600
LANDMARKS = 240
#: Rows and bytes of text that are learned from at most.
MOST_ROWS, LEARN_BYTES = 40_000, 64_000_000
RIDGE = 1e-3
#: Texts of a batch product, and rows of the sparse product that stand in memory at once.
BATCH, PIECE = 256, 32_768
#: A pipeline stage rejects texts below this score: no language's regression claims them.
LEAST_SCORE = 0.3
#: It also rejects texts whose share of known n-grams is below KNOWN_SHARE of what KNOWN_QUANTILE of the learning rows that are no landmarks fall short of.
KNOWN_QUANTILE, KNOWN_SHARE = 0.01, 0.9
#: The least share where every learning row is a landmark.
KNOWN_ELSE = 0.5
#: Bits of a letter in an n-gram's number, and what stands for characters other than letters, which is none itself.
BITS, BLANK = 21, 1


class Grams:
    """Distinct n-grams of texts."""

    def __init__(self):
        self.symbols: np.ndarray | None = None
        self.slot = np.zeros(0, np.int32)

    def __getstate__(self):
        return {"symbols": None, "slot": np.zeros(0, np.int32)}

    def encode(self, text: str) -> np.ndarray:
        """The text's letters by code point, with runs of other characters drawn into one BLANK and one at each end."""
        if self.symbols is None:
            self.symbols = np.zeros(0x110000, np.uint32)  # 0: not looked up yet
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[points]
        if not s.all():
            for c in np.unique(points[s == 0]).tolist():
                self.symbols[c] = c if chr(c).isalpha() else BLANK
            s = self.symbols[points]
        s = np.concatenate(([BLANK], s, [BLANK])).astype(np.int64)
        return s[np.concatenate(([True], (s[1:] != BLANK) | (s[:-1] != BLANK)))]

    def distinct(self, text: str) -> np.ndarray | None:
        """Numbers of the distinct n-grams that hold a letter, in no order; None without letters."""
        s = self.encode(text)
        if (s == BLANK).all():
            return None
        two = s[:-1] << BITS | s[1:]
        return self._once(np.concatenate((s[s != BLANK], two, two[:-1] << BITS | s[2:])))

    def _once(self, codes: np.ndarray) -> np.ndarray:
        """Distinct values: of the codes of a slot the last written stays; the few others are sorted."""
        bits = max(10, int(len(codes)).bit_length() + 1)
        if len(self.slot) < 1 << bits:
            self.slot = np.zeros(1 << bits, np.int32)
        where = ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        at = np.arange(len(codes), dtype=np.int32)
        self.slot[where] = at
        held = self.slot[where]
        same = codes[held] == codes
        first = codes[held == at]
        return first if same.all() else np.concatenate((first, np.unique(codes[~same])))


class Model:
    """Landmark grams, coefficients per landmark and language, languages in order. Its size is that of the landmarks' grams: a number and a bit for every landmark each."""

    def __init__(self, grams: Grams, landmarks: list[np.ndarray]):
        self.grams = grams
        self.known = np.unique(np.concatenate(landmarks))
        self.presence = np.zeros((len(self.known), -(-len(landmarks) // 8)), np.uint8)
        for i, x in enumerate(landmarks):
            self.presence[np.searchsorted(self.known, x), i // 8] |= np.uint8(1 << (i % 8))
        self.norm = np.sqrt(np.array([len(x) for x in landmarks], np.float64))
        self.langs: list[str] = []
        self.weights = np.zeros((len(landmarks), 0))
        self.least_known = KNOWN_ELSE

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places of those grams that some landmark has."""
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return at[self.known[at] == grams]

    def kernel(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts (their distinct grams) to the landmarks, and the share of each text's grams that some landmark has."""
        shared, known = np.zeros((len(sets), len(self.norm))), np.zeros(len(sets))
        for i, x in enumerate(sets):
            rows = self.rows(x)
            known[i] = len(rows) / len(x)
            for k in range(0, len(rows), PIECE):
                # the sparse product: the rows of the text's grams are added up
                bits = np.unpackbits(self.presence[rows[k : k + PIECE]], axis=1, count=len(self.norm), bitorder="little")
                shared[i] += np.add.reduce(bits, axis=0, dtype=np.int32)
        return shared / self.norm / np.sqrt([[len(x)] for x in sets]), known

    def fit(self, sets: list[np.ndarray], langs: list[str], landmarks: list[np.ndarray], ridge: float = RIDGE) -> None:
        own, _ = self.kernel(landmarks)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        features = np.concatenate([self.kernel(sets[i : i + BATCH])[0] for i in range(0, len(sets), BATCH)]) @ root
        self.langs = sorted(set(langs))
        target = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        # each language counts alike, however many of its texts there are
        weight = np.array([1 / n for n in map(Counter(langs).__getitem__, langs)])[:, None]
        solved = np.linalg.solve(features.T @ (weight * features) + ridge * np.eye(features.shape[1]), features.T @ (weight * target))
        self.weights = root @ solved

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the text's grams are known enough for the language to claim it."""
        langs, scores, claimed = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        sets = [self.grams.distinct(t) if t else None for t in texts]
        at = [i for i, x in enumerate(sets) if x is not None]
        for i in range(0, len(at), BATCH):
            values, known = self.kernel([sets[j] for j in at[i : i + BATCH]])
            f = values @ self.weights
            best = f.argmax(1)
            for j, b, v, share in zip(at[i : i + BATCH], best.tolist(), f[np.arange(len(f)), best].tolist(), known.tolist(), strict=True):
                langs[j], scores[j] = self.langs[b], min(1.0, max(0.0, (v + 1) / 2))
                claimed[j] = scores[j] >= LEAST_SCORE and share >= self.least_known
        return langs, scores, claimed


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, most_bytes: int = LEARN_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of the learning rows, by language, then hash. At most most_rows rows (or one a language) of most_bytes come to the driver."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    if not langs:
        return []
    per_lang, share = max(1, min(per_lang, most_rows // langs)), most_bytes // langs
    placed = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # the hash is even, so the first 2 x per_lang rows of a language lie in a known part of its range, and no task ranks more of them
    part = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n"))
    near = placed.join(F.broadcast(counts) if langs <= most_rows else counts, "lang").where((F.shiftrightunsigned("h", 1) / F.lit(float(2**63)) < part) & (F.octet_length("text") <= share // 4))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    kept = near.withColumns({"rn": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return [(r.lang, r.text) for r in sorted(kept.where((F.col("rn") <= per_lang) & (F.col("bytes") <= share)).collect(), key=lambda r: (r.lang, r.h))]


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    """The model from the columns doc_id, text, lang. None if no row can be learned from."""
    return learn(sample(docs, per_lang), landmarks)


def learn(rows: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model | None:
    """The model from learning rows (lang, text)."""
    grams = Grams()
    sets = [(lang, x) for lang, t in rows if (x := grams.distinct(t)) is not None]
    if not sets:
        return None
    langs = sorted({lang for lang, _ in sets})
    each = max(1, landmarks // len(langs))
    marks, others = [], []
    for lang in langs:
        own = [x for other, x in sets if other == lang]
        marks += own[:each]
        others += own[each:]
    model = Model(grams, marks)
    if others:
        model.least_known = KNOWN_SHARE * float(np.quantile([len(model.rows(x)) / len(x) for x in others], KNOWN_QUANTILE))
    model.fit([x for _, x in sets], [lang for lang, _ in sets], marks)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """(id, lang_pred, score, claimed) for every row; only the text decides. Without a text column it is the field `text` of the id, so it is sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                texts = (batch.column(1) if text_col else batch.column(0).field("text")).slice(i, BATCH).to_pylist()
                langs, scores, claimed = own.score(texts) if own else (["und"] * len(texts), [0.0] * len(texts), [False] * len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, BATCH), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(claimed, pa.bool_())], names=["id", "lang_pred", "score", "claimed"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = [F.col(text_col).cast("string").alias("text")] if text_col else []
    return docs.select(F.col(id_col).alias("id"), *texts).mapInArrow(run, f"id {kind}, lang_pred string, score double, claimed boolean")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no known language go (`und`, a score below LEAST_SCORE, or too few known n-grams)."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    found = identify(row, train(docs), id_col="row", text_col=None)
    return found.where("claimed").select("id.*").select(*docs.columns)
