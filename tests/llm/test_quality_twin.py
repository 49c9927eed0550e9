"""The quality classifier against a plain version of the same co-training, and on labels that took no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cupola.llm import quality


def plain_fit(x, y, ridge=1.0):
    """A ridge logistic regression by Newton steps, and its log-odds as a function."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return lambda v: np.clip(np.hstack([np.ones((len(v), 1)), (v - mean) / scale]) @ w, -30, 30)


def plain_cotraining(rows, good, handed, rounds):
    """rows: (doc_id, mark, text view, metadata values) in hash order; good: {doc_id: label}."""
    known = [r for r in rows if r[0] in good]
    pool = {r[1]: r for r in rows if r[1] not in {k[1] for k in known}}
    y = np.array([float(good[r[0]]) for r in known])
    seen = {}
    for r in known:
        for v in r[3]:
            seen[v] = seen.get(v, 0) + 1
    columns = sorted(v for v, n in seen.items() if n >= quality.LEAST_SEEN)
    view = lambda rs: (np.array([r[2] for r in rs], float).reshape(len(rs), -1), np.array([[float(c in r[3]) for c in columns] for r in rs]).reshape(len(rs), -1))
    text, meta = view(known)
    learn = np.array([i % 3 != 2 for i in range(len(y))])
    sets = [(text[learn], y[learn]), (meta[learn], y[learn])]
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    def calibrated():
        fits = [plain_fit(*s) for s in sets]
        platt = [plain_fit(f(x[~learn])[:, None], y[~learn], 0.01) for f, x in zip(fits, (text, meta), strict=True)]
        return [lambda v, f=f, p=p: p(f(v)[:, None]) for f, p in zip(fits, platt, strict=True)]

    high = round(handed / (1 + np.exp(-prior)))
    for _ in range(rounds):
        fits = calibrated()
        left = list(pool.values())
        picks = []
        for own in (0, 1):
            z = fits[own](view(left)[own])
            for label, most in ((0, max(1, handed - high)), (1, max(1, high))):
                sign = 1 if label else -1
                sure = sorted((-sign * v, r[1]) for v, r in zip(z, left, strict=True) if sign * v > quality.SURE and sign * (v - prior) > quality.SURE)
                picks += [(own, label, m) for _, m in sure[:most]]
        for own in (0, 1):
            given = [(label, m) for o, label, m in picks if o == own and not any(n == m and k != label for _, k, n in picks)]
            if given:
                x = view([pool[m] for _, m in given])[1 - own]
                sets[1 - own] = (np.vstack([sets[1 - own][0], x]), np.append(sets[1 - own][1], [float(label) for label, _ in given]))
        for _, _, m in picks:
            pool.pop(m, None)
    a, b = (f(x) for f, x in zip(calibrated(), view(rows), strict=True))
    return {r[0]: 1 / (1 + np.exp(-v)) for r, v in zip(rows, np.clip(a + b - prior, -30, 30), strict=True)}


def test_scores_equal_the_plain_version(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("doc_id % 3 < 2")
    found = quality.features(docs).cache()
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id"), F.col("mark")]
    rows = [(r.doc_id, r.mark, np.frombuffer(r.text_view, "<f4"), r.meta_view) for r in found.orderBy(*order).collect()]
    good = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    want = plain_cotraining(rows, good, 20, 3)
    views = quality.train(found, labels, handed=20, rounds=3)
    _, _, score = views.score(np.array([r[2] for r in rows], float), [r[3] for r in rows])
    assert max(abs(want[r[0]] - s) for r, s in zip(rows, score, strict=True)) < 1e-5


def test_labels_that_took_no_part(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.assess(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    assert len(out) > 100
    assert sum(r.keep == (r.quality == 1) for r in out) >= 0.9 * len(out)


@pytest.mark.parametrize("rows,learns", [([(1, 1), (2, 0)], True), ([(1, 1), (2, 1), (3, 1)], False), ([(1, 0)], False), ([], False)])
def test_only_the_presence_of_classes_decides(spark, rows, learns):
    docs = spark.createDataFrame([(i, f"text number {i} " * i, "en", "s", 10 * i) for i in range(1, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    out = quality.assess(docs, labels).collect()
    assert ({r.score for r in out} != {0.5}) == learns
    assert len(out) == 8 and (learns or all(r.keep for r in out))
