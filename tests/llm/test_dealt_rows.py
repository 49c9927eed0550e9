"""Fingerprints dealt to shards: rows in proportion to the input, no link lost."""

import numpy as np
import pytest

from cupola.llm import simhash


def planted(rng, n, fixed=0):
    """Distinct fingerprints, the last `fixed` bits alike, a tenth of them with another 1 to 3 bits away."""
    base = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(fixed) << np.uint64(fixed)
    near = base[: n // 10].copy()
    for k in range(3):
        some = rng.random(len(near)) < (1, 0.7, 0.7)[k]
        near[some] ^= np.uint64(1) << rng.integers(fixed, 64, some.sum()).astype(np.uint64)
    return np.unique(np.concatenate([base, near]))


def frame(spark, points):
    return spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")


@pytest.mark.parametrize("radius", [2, 3])
def test_rows_dealt_grow_as_the_input(spark, radius):
    """One tree over all of them made 5.1 rows a point of the smaller set at radius 3, 17.3 of the larger."""
    for n in (4_000, 32_000):
        points = planted(np.random.default_rng(n), n)
        assert simhash.shards(frame(spark, points), radius, 200, 2_000).count() <= (radius + 1) * len(points)


@pytest.mark.parametrize("n,fixed,shard,largest", [(300, 0, 200, 2_000), (3_000, 0, 100, 1_000), (3_000, 30, 100, 600), (500, 58, 20, 60)])
def test_no_link_is_lost(spark, n, fixed, shard, largest):
    points = planted(np.random.default_rng(n + fixed), n, fixed)
    found = {}
    for r in simhash.shards(frame(spark, points), 3, shard, largest, 1_000, 500).collect():
        found.setdefault(r.shard, []).append(r.fp)
    met = set()
    for fps in found.values():
        own = np.unique(np.array(fps, np.int64).view(np.uint64))
        a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None]) <= 3, 1))
        met |= set(zip(own[a].tolist(), own[b].tolist(), strict=True))
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 3, 1))
    assert len(a) > n // 20
    assert met == set(zip(points[a].tolist(), points[b].tolist(), strict=True))


def test_masks_part_the_bits():
    for radius in (0, 2, 3, 16, 63):
        masks = [m % 2**64 for m in simhash.blocks(np.arange(1, 500, dtype=np.uint64), radius)]
        assert len(masks) == radius + 1 and sum(masks) == 2**64 - 1
        assert max(m.bit_count() for m in masks) - min(m.bit_count() for m in masks) <= 1
