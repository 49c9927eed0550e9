"""SimHash near-duplicates: fingerprints, exact pairs in a vantage-point tree, connected components.

The fingerprint of a document has bit b set if more than half of its shingles' 64-bit hashes have it. Documents
are linked if their fingerprints differ in at most `radius` bits, and a component is a set of linked documents.

Exact pairs come from vantage-point trees, a tree a shard of distinct fingerprints. Shards are dealt by blocks of bits:
the 64 bits are parted into radius + 1 blocks, and two fingerprints at most `radius` apart are alike in all bits of one
of them, as each bit that differs spoils one block. A fingerprint goes to one shard a block, by a hash of that block's
bits, so it is dealt radius + 1 times however many fingerprints there are, and a link lies whole in some shard. (One tree
over all of them would send those near a boundary to both sides at every node; its rows would grow with a power of the
input above 1.)

A node of a tree holds a vantage fingerprint v and a cut c; a fingerprint at distance d from v goes inside if d <= c and
outside if d > c - radius, so one within `radius` of the boundary goes to both. By the triangle inequality two
fingerprints at most `radius` apart have distances from v that differ by at most `radius`, so they meet in some leaf: no
pair is lost, whatever the vantage points and the parting of the bits are. They only decide how even the work is, so
they may come from a bounded sample, and a shard that is too large, as many are alike in a block, is divided by a tree
first. Inside a shard the tree goes down to small leaves, in which all pairs are compared, block by block.

A shard returns, instead of its pairs, one row (fingerprint, smallest fingerprint connected in the shard): linear
in the shard's size, with the same connectivity. These stars are merged inside tasks, a bounded number a task, and what
is left by alternating large-star and small-star steps over DataFrames. Only distinct fingerprints are searched, so groups of exact copies cost nothing here.

Null or empty texts have fingerprint zero and are linked like any other. Repeated rows and ties keep all rows;
a null id stays in the result and is ignored when a component's smallest id is taken. Other columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cupola.llm.common import stored, table

SEED = 42
#: Fingerprints sampled for the parting of the bits.
SAMPLE = 20_000
#: Fingerprints wanted in a shard; a tree that divides one stops below that share of its sample.
SHARD = 4_000
#: A shard of more points is divided again by a tree from about SUBSAMPLE of its own, at most DEPTH times; TREES such trees are sent to the tasks at once.
LARGEST, SUBSAMPLE, DEPTH, TREES = 40_000, 8_192, 8, 4_000
#: Points of a leaf inside a shard, in which all pairs are compared.
LEAF = 384
#: Vantage points tried at each node.
TRIED = 24
#: Edges that a task joins at once, in Python's memory.
CHUNK = 100_000


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """64-bit SimHash of a word sequence; 0 for none."""
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return folded(np.fromiter(map(_hash, zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that more than half of them have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _hash(shingle: tuple[bytes, ...]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(shingle), SEED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Words are runs of bytes other than ASCII white space, A-Z lowered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t.lower().split(), shingle) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def best_cut(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and cut that leave least work (squares of both sides' sizes), or None if none saves a tenth."""
    n = len(points)
    tried = points[rng.choice(n, min(n, TRIED), replace=False)]
    seen = points if n <= 4096 else points[rng.choice(n, 4096, replace=False)]
    best, least = None, 0.9 * len(seen) ** 2
    for v in tried:
        upto = np.cumsum(np.bincount(np.bitwise_count(seen ^ v), minlength=65))
        for cut in range(radius, 64):
            inside, outside = upto[cut], len(seen) - upto[cut - radius]
            cost = int(inside) ** 2 + int(outside) ** 2
            if cost < least:
                best, least = (v, cut), cost
    return best


def grow(sample: np.ndarray, radius: int, leaf: int) -> list[tuple]:
    """A tree as a list of nodes: (vantage, cut, inside, outside), or (None, shard, 0, 0) for a leaf. Node 0 is the root."""
    rng, nodes, todo, shards = np.random.default_rng(SEED), [None], [(0, sample)], 0
    while todo:
        at, points = todo.pop()
        cut = best_cut(points, radius, rng) if len(points) > leaf else None
        if cut is None:
            nodes[at] = (None, shards, 0, 0)
            shards += 1
            continue
        d = np.bitwise_count(points ^ cut[0])
        nodes[at] = (int(cut[0]), cut[1], len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, points[d <= cut[1]]), (len(nodes) - 1, points[d > cut[1] - radius])]
    return nodes


def deal(points: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, shard) for every shard that a point belongs to."""
    out, todo = [], [(0, points)]
    while todo:
        at, here = todo.pop()
        v, cut, inside, outside = nodes[at]
        if v is None:
            out.append((here, np.full(len(here), cut, np.int32)))
        elif len(here):
            d = np.bitwise_count(here ^ np.uint64(v))
            todo += [(inside, here[d <= cut]), (outside, here[d > cut - radius])]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def linked(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points, the position of the smallest point connected to it by links within the set."""
    points = np.asarray(points, np.uint64)
    order = np.argsort(points, kind="stable")
    values, parent, rng = points[order], np.arange(len(points)), np.random.default_rng(SEED)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = _roots(parent, a), _roots(parent, b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))

    todo = [np.arange(len(points))]
    while todo:
        here = todo.pop()
        cut = best_cut(values[here], radius, rng) if len(here) > LEAF else None
        if cut is not None:
            d = np.bitwise_count(values[here] ^ cut[0])
            todo += [here[d <= cut[1]], here[d > cut[1] - radius]]
            continue
        own = values[here]
        for i in range(0, len(own), LEAF):
            for j in range(i, len(own), 4 * LEAF):
                a, b = np.nonzero(np.bitwise_count(own[i : i + LEAF, None] ^ own[None, j : j + 4 * LEAF]) <= radius)
                keep = a + i < b + j
                union(here[a[keep] + i], here[b[keep] + j])
    roots = _roots(parent, np.arange(len(points)))
    out = np.empty(len(points), np.int64)
    out[order] = order[roots]
    return out


def blocks(sample: np.ndarray, radius: int) -> list[int]:
    """radius + 1 masks, as signed longs, that part the 64 bits; bits that divide the sample evenly are dealt to all of them in turn."""
    ones = np.unpackbits(sample.view(np.uint8), bitorder="little").reshape(-1, 64).mean(0)
    order = np.argsort(np.abs(ones - 0.5), kind="stable")
    return [int(np.bitwise_or.reduce(np.uint64(1) << order[k :: radius + 1].astype(np.uint64)).view(np.int64)) for k in range(radius + 1)]


def shards(distinct: DataFrame, radius: int = 2, shard: int = SHARD, largest: int = LARGEST, sampled: int = SAMPLE, subsampled: int = SUBSAMPLE) -> DataFrame:
    """(shard, fp): the distinct fingerprints of column fp, each in every shard that it belongs to.

    Each goes to a shard a block of bits, `shard` of them to one on average; where that saves no comparisons all are one
    shard. A shard of more than `largest` points, as many are alike in a block, gets a tree of its own,
    grown in a task from a sample of that shard, and its points are dealt anew, until no shard is larger or none of the
    larger ones can be divided. So shards stay bounded however many fingerprints there are; at most TREES trees are sent
    to the tasks at once.
    """
    n = distinct.count()
    # radius + 1 deals into so many shards each
    many, name = min(-(-n // shard), 1 << (64 // (radius + 1))), F.lit("")
    if many > radius + 1:
        sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp", F.lit(SEED)), "fp").limit(sampled).collect()], np.int64).view(np.uint64)
        place = lambda mask: F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask))), F.lit(many))
        name = F.explode(F.array(*[F.concat(F.lit(f"{k}/"), place(mask).cast("string")) for k, mask in enumerate(blocks(sample, radius))]))
    dealt = stored(distinct.select(name.alias("shard"), "fp"), "shard")
    done = None
    for depth in range(1, DEPTH + 1):
        large = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > largest)
        large = stored(large, "large")
        if not large.limit(1).count():
            break
        # of each large shard about `subsampled` points, by a hash; joined by shard, so no shard is gathered
        h = F.pmod(F.xxhash64("fp", F.lit(SEED + depth)), F.lit(1 << 30))
        chosen = dealt.join(large, "shard").where(h < F.lit(subsampled) / F.col("n") * (1 << 30)).select("shard", "n", "fp")
        trees = stored(chosen.groupBy("shard").applyInArrow(lambda t: _tree(t, radius, shard), "shard string, nodes binary, divided boolean"), "trees")
        settled = dealt.join(trees.where("divided").select("shard"), "shard", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        number, parts = trees.where("divided").count(), []
        if not number:
            dealt = None
            break
        for k in range(-(-number // TREES)):
            own = trees.where("divided").where(F.pmod(F.xxhash64("shard"), F.lit(-(-number // TREES))) == k)
            grown = {r.shard: _nodes(r.nodes) for r in own.collect()}
            parts.append(_dealt(dealt.where(F.pmod(F.xxhash64("shard"), F.lit(-(-number // TREES))) == k), grown, radius))
        again = parts[0]
        for x in parts[1:]:
            again = again.unionByName(x)
        dealt = stored(again, "shard")
    return done if dealt is None else dealt if done is None else done.unionByName(dealt)


_NODE = np.dtype([("vantage", "<u8"), ("cut", "<i4"), ("inside", "<i4"), ("outside", "<i4")])


def _tree(group: pa.Table, radius: int, shard: int) -> pa.Table:
    """The tree of one large shard from its sampled points."""
    points, n = np.unique(group.column("fp").to_numpy().view(np.uint64)), group.column("n")[0].as_py()
    nodes = grow(points, radius, max(64, int(len(points) * min(1.0, shard / n))))
    packed = np.array([(v or 0, cut, i, o) if v is not None else (0, cut, -1, -1) for v, cut, i, o in nodes], _NODE)
    return pa.table({"shard": group.column("shard")[:1], "nodes": pa.array([packed.tobytes()], pa.binary()), "divided": pa.array([len(nodes) > 1])})


def _nodes(raw: bytes) -> list[tuple]:
    return [(int(x["vantage"]), int(x["cut"]), int(x["inside"]), int(x["outside"])) if x["inside"] >= 0 else (None, int(x["cut"]), 0, 0) for x in np.frombuffer(raw, _NODE)]


def _dealt(points: DataFrame, trees: dict[str, list[tuple]], radius: int) -> DataFrame:
    """(shard, fp) of points (shard, fp) by the tree of their shard; points of a shard without a tree are left out. The new shard's name goes on from the old one's."""
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for name in dict.fromkeys(names.tolist()):
                if name in shared.value:
                    found, shard = deal(fps[names == name], shared.value[name], radius)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{k}" for k in shard.tolist()], pa.string()), pa.array(found.view(np.int64))], names=["shard", "fp"])

    return points.select("shard", "fp").mapInArrow(out, "shard string, fp long")


def stars(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): every fingerprint of column fp that has a link, with the smallest one connected to it in a shard (unsigned order)."""

    def search(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        root = linked(points, radius)
        keep = root != np.arange(len(points))
        return pa.table({"u": points[keep].view(np.int64), "v": points[root[keep]].view(np.int64)})

    return shards(distinct, radius).groupBy("shard").applyInArrow(search, "u long, v long").distinct()


def joined(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task as stars: every node with the smallest one connected to it by the task's edges, or by `chunk` of them if there are more."""
    parent, seen = {}, 0

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def stars_of(schema: pa.Schema) -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(1).type)], names=["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for i in range(0, batch.num_rows, chunk):
            part = batch.slice(i, chunk)
            if seen + part.num_rows > chunk:
                yield stars_of(schema)
                parent, seen = {}, 0
            seen += part.num_rows
            for u, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    if schema is not None:
        yield stars_of(schema)


def components(edges: DataFrame, name: str = "star", chunk: int = CHUNK) -> DataFrame:
    """(u, v): for every node of the edges (u, v) but the smallest of its component, that smallest one. Edges join inside tasks first, then by alternating large and small stars.

    A task turns `chunk` edges into stars, so a table of no more than that is done, and of a larger one less is
    shuffled. Each round after that takes group minima, which are combined before the shuffle, and two joins by node; no
    node's neighbours are ever gathered in one row. The minima are written before they are joined: a join with the aggregate
    itself would keep its partitioning, and adaptive execution couldn't split the rows of a component's hub. Rounds are
    cut by written tables, so lineage stays short. They end when only stars are left.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields)
    first = True
    while True:
        parts = max(1, -(-edges.count() // chunk))
        if first or parts == 1:
            edges = stored(edges.coalesce(parts).mapInArrow(lambda batches: joined(batches, chunk), kind), name)
        if parts == 1:
            return edges
        first = False
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = stored(small, name)
        # in stars no node has two edges upwards, or edges both ways
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id of its component."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    links = components(stars(prints.select("fp").distinct(), radius))
    rooted = prints.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("id", "fp", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies one row stays, the first by (doc_id, a hash of all its columns).

    It has its own rule, five-word shingles and similarity 0.8, found by op10's tree first and MinHash bands after it; the
    radius of op10 binds its query only. Rows are
    chosen, not ids: of rows that share an id and belong to different components each can stay, and of rows alike
    in all columns one does. Rows without an id can't be told apart and stay. Null and texts without words are
    copies of each other. The texts are moved once, by the join with the chosen rows.
    """
    from cupola.llm.resemblance import near_copies

    # what tells rows apart, made from the row alone, so a task that runs again makes the same
    told = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64(*told).alias("mark"))
    found = near_copies(docs.select(row.alias("row"), "text").where("doc_id is not null"), id_col="row")
    kept = found.where(F.col("component") == F.col("id")).select("id.*").distinct()
    marked = docs.select(F.struct(*docs.columns).alias("row")).where("row.doc_id is not null").select(F.col("row.doc_id").alias("id"), F.xxhash64(*[F.col("row").getField(c) for c in told]).alias("mark"), "row")
    # the join leaves rows dealt by (id, mark): equal rows meet without another shuffle
    one = marked.join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
