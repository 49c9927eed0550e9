"""Near copies by resemblance: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The first candidates come from `simhash`: fingerprints of the shingles, the vantage-point tree's exact links at RADIUS bits,
and components of them, whose members are each held against the component's smallest text. That can't be all: at similarity
0.8 fingerprints differ in about 10 of 64 bits, and with a radius so wide the tree can't divide fingerprints, as those of
unrelated texts differ in about 32. So texts that agree in a band of MinHash values are candidates too: BANDS bands of ROWS
values each find a pair of similarity s with probability 1 - (1 - s^ROWS)^BANDS, 0.988 at 0.8, 0.9994 at 0.85. Whether a
candidate is a near copy is decided by its exact similarity, so no other pair is linked.

Only distinct word sequences are compared. After the tree's pairs every member of a bucket is held against the bucket's smallest. Of the
texts in buckets that are still apart, the shingles are counted. Those that RARE texts or fewer have bring together the
pairs that share one, a bounded number a shingle; two texts that share none of them have no more in common than the
other shingles of either, so most can't reach the similarity with anyone else, whatever their bands, and are left out
without a look at the texts. While many pairs of a bucket are still in different components, members outside its largest
component are held against another member of that, a row a member, for TURNS turns at most and while turns find links,
beginning with the member that has the fewest rare shingles; then all pairs that are still apart are compared. So every pair that shares a band is
compared unless it is connected already or can't be similar.

Texts without words are equal to each other. Rows keep their ids as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupola.llm.common import give_back, stored
from cupola.llm.simhash import components, folded, stars

SEED = 42
SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 8
#: Bits by which fingerprints that the tree links differ, at most.
RADIUS = 3
#: Turns with further pivots.
TURNS = 6
#: Texts that have a rare shingle, at most.
RARE = 16
#: Shingles whose MinHash values are computed at once.
BLOCK = 2048
#: Rows of a batch whose texts stand in Python's memory at once, and rows that Spark sends at once.
SLICE, SENT = 256, 1024

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADDED = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lowered."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; of fewer words than a shingle has, of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    spans = zip(*(words[i:] for i in range(min(SHINGLE, len(words)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in spans), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def key_of(words: list[bytes]) -> bytes:
    """What stands for a word sequence; 128 bits."""
    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit number a band; none for no shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK, None] * _FACTORS + _ADDED).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small parts; what a batch took is given back before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()  # what texts took, before the worker's next stage


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, bands, fp) of every row; size is the number of distinct shingles, fp their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            keys, sizes, found, fps = [], [], [], []
            for words in map(words_of, batch.column(1).cast(pa.binary()).to_pylist()):
                hashes = shingles(words)
                keys.append(key_of(words))
                sizes.append(len(hashes))
                found.append(bands(hashes))
                fps.append(folded(hashes))
            made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "key", "size", "bands", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, key binary, size long, bands array<long>, fp long")


def bitmap(numbers: DataFrame) -> np.ndarray:
    """A bit for every value of the one column of non-negative numbers, by the value's remainder; 2^27 bits at most, so its size is bounded whatever the table's. It leaves out most of what isn't in the table; an exact join tells the rest."""
    bits = 1 << max(12, min(27, (16 * numbers.count()).bit_length()))
    at = F.pmod(F.col(numbers.columns[0]), F.lit(bits))
    words = numbers.select((at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["w", "b"])

    out = np.zeros(bits // 64, np.int64)
    for r in words.mapInArrow(packed, "w binary, b binary").toLocalIterator():  # 12 bytes a word, thousands of words a row
        out[np.frombuffer(r.w, np.int32)] = np.frombuffer(r.b, np.int64)
    return out.view(np.uint64)


def held(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers have their bit."""
    at = numbers.astype(np.int64) & np.int64(64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _number(key: Column) -> Column:
    """The first four bytes of a key as a number."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long")


def texts_of(keys: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the distinct keys; of texts that share one, the smallest. Texts without a key here stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select(_number(F.col("key")).alias("n"))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            keys = [key_of(words_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            kept = held(shared.value, np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64))
            # copies that stand near each other go once
            texts, first = batch.column(0).to_pylist(), {}
            for i in np.flatnonzero(kept).tolist():
                if keys[i] not in first or (texts[i] or "") < (texts[first[keys[i]]] or ""):
                    first[keys[i]] = i
            kept[:] = False
            kept[list(first.values())] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"]).filter(pa.array(kept))

    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(keyed, "key binary, text string")
    # by key first, which combines before texts move, so a group of copies sends a text a task; what only the bits let through goes after
    return stored(texts.groupBy("key").agg(F.min("text").alias("text")).join(keys, "key", "left_semi"), "copytext")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of keys whose texts have a similarity of LEAST or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in _sliced(batches):
            u, v, texts, others = (c.to_pylist() for c in batch.columns)
            kept = []
            for i in range(len(u)):
                if v[i] != last:  # rows of one v often follow each other
                    last, own = v[i], shingles(words_of(others[i]))
                kept.append(similarity(shingles(words_of(texts[i])), own) >= LEAST)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    # only the texts of these pairs are dealt anew
    others = texts.join(pairs.select(F.col("v").alias("key")).distinct(), "key", "left_semi")
    rows = pairs.join(texts.select(F.col("key").alias("u"), "text"), "u").join(others.select(F.col("key").alias("v"), F.col("text").alias("other")), "v")
    return rows.select("u", "v", "text", "other").mapInArrow(compare, "u binary, v binary")


def shared_shingles(keys: DataFrame, sizes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, size, common), (u, v, n)): how many shingles a text has, and how many of them more than RARE texts of the keys have; pairs that share n of the others."""
    own = texts.join(keys, "key", "left_semi")

    def shingled(kept):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                made = [kept(shingles(words_of(t)).view(np.int64)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["key", "hashes"])

        return own.mapInArrow(run, "key binary, hashes array<long>")

    # a key as two numbers, which an aggregate keeps in place: where one text has a shingle, the least of each is its own
    half = lambda at: F.conv(F.hex(F.substring("key", at, 8)), 16, -10).cast("long")
    rows = shingled(lambda h: h).select(half(1).alias("high"), half(9).alias("low"), "hashes").select("high", "low", F.explode("hashes").alias("h"))
    rare = stored(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("high").alias("high"), F.min("low").alias("low")).where(F.col("n") <= RARE), "rare")
    alone = rare.where("n = 1").groupBy("high", "low").agg(F.count("*").alias("alone"))
    several = rare.where("n > 1").select("h")
    bits = keys.sparkSession.sparkContext.broadcast(bitmap(several))
    posts = shingled(lambda h: h[held(bits.value, h)]).select("key", F.explode("hashes").alias("h")).join(several, "h")
    posts = stored(posts, "posts")
    pairs = posts.select("h", F.col("key").alias("u")).join(posts.select("h", F.col("key").alias("v")), "h").where("u > v").groupBy("u", "v").agg(F.count("*").alias("n"))
    all_ = keys.join(sizes, "key").select("key", "size", half(1).alias("high"), half(9).alias("low"))
    all_ = all_.join(alone, ["high", "low"], "left").join(posts.groupBy("key").agg(F.count("*").alias("few")), "key", "left")
    common = F.col("size") - F.coalesce("alone", F.lit(0)) - F.coalesce("few", F.lit(0))
    return stored(all_.select("key", "size", common.alias("common")), "common"), pairs


def _suffices(most: Column, size_u: str, size_v: str) -> Column:
    """Whether texts of these sizes with so many shingles in common, at most, may be similar."""
    return most / (F.col(size_u) + F.col(size_v) - most) >= LEAST


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, component): every row's key and the smallest id of its component."""
    conf, setting = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, SENT)
    try:
        return _near_copies(docs, id_col, text_col)
    finally:
        conf.set(setting, before)


def tree_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of keys, from (key, fp): of texts whose fingerprints the vantage-point tree connects, each with the smallest; a row a text."""
    roots = components(stars(distinct.select("fp").distinct(), radius), "treestar").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.select("key", "fp").join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    # minima are written before they are joined, so the texts of a large component can be split
    least = stored(rooted.groupBy("root").agg(F.min("key").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"), "treeleast")
    return rooted.join(least, "root").where("key != v").select(F.col("key").alias("u"), "v")


def _members(distinct: DataFrame) -> DataFrame:
    """(band, key, pivot) of the bands that several texts (key, bands) have; the pivot is the band's smallest key."""
    groups = distinct.select("key", F.explode("bands").alias("band")).groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "shared")
    # most bands are of one text: those are left out before anything is dealt by band again
    shared = distinct.sparkSession.sparkContext.broadcast(bitmap(groups.select("band")))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            values = batch.column(1).flatten()
            kept = held(shared.value, values.to_numpy())
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, values], names=["key", "band"]).filter(pa.array(kept))

    posts = distinct.select("key", "bands").mapInArrow(several, "key binary, band long")
    return stored(posts.join(groups, "band").select("band", "key", "pivot"), "bucket")


def _apart(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of buckets in several components, with root and main, the bucket's largest; those buckets). links are the components."""
    roots = links.select(F.col("u").alias("key"), F.col("v").alias("root"))
    placed = stored(members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    counts = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("all"), F.max("n").alias("most")).where("k > 1")
    main = stored(main, "main")
    return placed.join(main.select("band", "main"), "band"), main


def _with(links: DataFrame, pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, bool]:
    """(the components with those of the written pairs that are near copies, whether they grew)."""
    if pairs.isEmpty():
        return links, False
    new = components(links.unionByName(confirmed(pairs, texts)), "copystar")
    return new, new.count() > links.count()


def _near_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = stored(prints(docs, id_col, text_col), "resemblance")
    distinct = stored(found.where(F.size("bands") > 0).groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "bands")
    linked, members = stored(tree_pairs(distinct), "tree"), _members(distinct)
    needed = members.select("key").unionByName(linked.select(F.col("u").alias("key"))).unionByName(linked.select(F.col("v").alias("key")))
    texts = texts_of(stored(needed.distinct(), "needed"), docs, text_col)
    tried = stored(linked.unionByName(members.where("key != pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v"))).distinct(), "pairs")
    # what is found later is joined to the components so far, not to all edges; where nothing is found they stay as they are
    links, members = components(confirmed(tried, texts), "copystar"), members.select("band", "key")
    total = members.count()
    # only buckets that are apart matter from here on, and in them only texts that can be similar to another
    mixed, _ = _apart(members, links)
    shared, pairs = shared_shingles(stored(mixed.select("key").distinct(), "needed"), distinct.select("key", "size"), texts)
    sized = lambda k: shared.select(F.col("key").alias(k), F.col("size").alias(f"size_{k}"), F.col("common").alias(f"common_{k}"))
    pairs = pairs.join(sized("u"), "u").join(sized("v"), "v").where(_suffices(F.least("common_u", "common_v") + F.col("n"), "size_u", "size_v")).select("u", "v")
    pairs = stored(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
    links, tried = _with(links, pairs, texts)[0], tried.unionByName(pairs)
    # a text that can't be similar to the smallest of a bucket, nor to one of the size of what it shares, is out of that bucket
    members = mixed.select("band", "key").join(shared.where(F.col("common") / F.col("size") >= LEAST), "key")
    members = members.join(members.groupBy("band").agg(F.min("size").alias("least")), "band").withColumn("least", F.greatest("least", "common"))
    members = stored(members.where(_suffices(F.col("common"), "size", "least")).drop("least"), "bucket")
    mixed, main = _apart(members, links)
    for turn in range(TURNS + 1):
        few = mixed.where("root != main").select("band", F.col("key").alias("u"), F.col("root").alias("own"), "main", F.col("size").alias("size_u"), F.col("common").alias("common_u"))
        # all pairs that are left, at most: once they are no more than the buckets' members they are all compared
        left = main.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
        if left <= total or turn == TURNS:
            break
        # else another member of each bucket's main component is held against those outside, a row a member; the first is the one with the least of its own
        own = F.col("size") - F.col("common") if turn == 0 else F.lit(0)
        pivots = mixed.where("root = main").groupBy("band").agg(F.min_by("key", F.struct(own, F.xxhash64("key", F.lit(turn)))).alias("v"))
        pairs = few.join(pivots, "band").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = stored(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        (links, more), tried = _with(links, pairs, texts), tried.unionByName(pairs)
        if not more:
            break
        mixed, main = _apart(members, links)
    if left:
        # members of other components than the bucket's largest, against all members of other components than their own,
        # if what neither has among the rare would suffice
        pairs = few.join(mixed.select("band", F.col("key").alias("v"), "root", "size", "common"), "band").where("own != root and (root = main or u < v)")
        pairs = pairs.where(_suffices(F.least("common_u", "common"), "size_u", "size")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        links, _ = _with(links, stored(pairs.join(tried, ["u", "v"], "left_anti"), "pairs"), texts)
    links = links.select(F.col("u").alias("key"), F.col("v").alias("root"))
    rooted = found.select("id", "key").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("id", "key", "component")
