import random

import numpy as np
import pytest

from quarrylight.llm.mixing import mixed_documents, mixture, pivot


def plan(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare what is above the caps until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(w[s] for s in open_)
        aims = {s: left * w[s] / total for s in open_}
        over = [s for s in open_ if aims[s] > most * sizes[s]]
        if not over:
            return aims | capped
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def make(spark, n=6000):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["hot", "hot", "hot", "b", "Ü", "c", None])) for i in range(n)]
    rows += [(5, "twice the same", "b"), (5, "twice the same", "b"), (None, "no id", "b"), (7, None, "only null"), (8, "\t \n", "blank"), (9, "x\x1cy z", "c")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_targets_and_totals(spark):
    rows, df = make(spark)
    got = mixture(df.repartition(5)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    want = plan(sums)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    for s in sums:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sums[s]}
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
    again = mixture(df.repartition(11)).collect()
    key = lambda r: (str(r.doc_id), r.key, r.nth, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_keep_their_columns(spark):
    rows, df = make(spark, 300)
    taken = {}
    for r in mixture(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in taken.items() if n}


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "same text here", "a", f"k{i % 3}", i % 3) for i in range(3000)] + [(None, None, None, "x", 1)] * 40 + [(i, "word " * (i % 7), "b", "y", 2) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, _id int")
    taken = {}
    for r in mixture(df.repartition(3)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    runs = [sorted(map(str, mixed_documents(df.repartition(n)).collect())) for n in (2, 7)]
    assert runs[0] == runs[1]
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    found = {}
    for r in mixed.collect():
        assert (r["_key"], r["_id"]) in {("k0", 0), ("k1", 1), ("k2", 2), ("x", 1), ("y", 2)}
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in taken.items() if n}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40)
    start = np.full(40, 0.37)
    total = np.zeros(40)
    for _ in range(3000):
        p = pivot(start, size, rng)
        assert ((p > 0) & (p < 1)).sum() <= 1
        assert (p * size).sum() == pytest.approx((start * size).sum())
        total += p
    assert np.abs(total / 3000 - 0.37).max() < 0.05
