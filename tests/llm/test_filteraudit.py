"""Filter audit: every order run one by one, counters that carry large counts, odd rows."""

import re
from itertools import permutations

from cupola.llm import filteraudit as A

LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (5, "short", "a"), (3, "short", "b"), (9, None, "a"), (1, "", None), (2, "SHOUT " * 60, "a"), (4, LONG, "a"), (6, LONG, "b"), (6, LONG, "b"), (7, LONG + " #", "a"), (None, LONG, "a"),
    (None, LONG, "a"), (8, LONG + " \x0bx", "b"), (10, "word " * 5000, "a"), (4, "other text", "a"), *[(100 + i, LONG + " copy", "hot") for i in range(50)],
]
LABELS = [(5, 1, 0), (5, None, 1), (4, 1, None), (6, 0, 1), (2, 1, 1), (100, 1, 1), (None, 1, 1), (120, 1, 0)]


def fails(i, text, docs):
    words, n = re.findall(r"[^\x20\x09-\x0D]+", text), len(text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * n, "D": bool(re.search(r"[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
    }


def plain(docs, labels):
    rows = [(i, fails(i, t or "", docs), s or "") for i, t, s in docs]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {s for *_, s in rows}:
            left = [r for r in rows if r[2] == part]
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                mine = [r for r in rows if r[2] == part]
                out[part, order, step + 1] = (
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                )
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frames(spark):
    docs = spark.createDataFrame([(*r, "x", 7) for r in DOCS], "doc_id long, text string, source string, part string, good int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_by_running_it(spark, monkeypatch):
    docs, labels = frames(spark)
    want = plain(DOCS, LABELS)
    for parts in (1024, 0):
        monkeypatch.setattr(A, "PARTS", parts)
        rows = A.outcomes(A.sums(A.masks(docs.repartition(5), labels))).collect()
        assert len(rows) == len(want) == 600 * 4
        assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows} == want


def test_large_counts_stay_in_their_fields(spark):
    big = 1 << 40
    rows = spark.createDataFrame([("p", m, True, False, big + m) for m in range(32)] * 3, "part string, mask int, good boolean, toxic boolean, n long")
    out = {(r.filter_order, r.step): r for r in A.outcomes(A.sums(rows.repartition(6))).collect()}
    first = out["ABCDE", 1]
    assert first.removed == first.good_lost == 3 * sum(big + m for m in range(32) if m & 1)
    assert first.kept == 3 * sum(big + m for m in range(32) if not m & 1)
    assert out["ABCDE", 5].kept == 3 * big and first.toxic_lost == 0


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert A.outcomes(A.sums(A.masks(docs.limit(0), labels))).count() == 0
    assert {r.good_lost for r in A.outcomes(A.sums(A.masks(docs, labels.limit(0)))).collect()} == {0}
