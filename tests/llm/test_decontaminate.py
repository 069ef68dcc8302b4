import random
import re

import pytest

import quarrylight.llm.decontaminate as D


def slow_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def slow(text, items, n=10):
    words = slow_words(text)
    hit, found = set(), set()
    for item, t in items:
        w = slow_words(t)
        k = min(n, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                found.add(str(item) if item is not None else "null")
                hit |= set(range(i, i + k))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize(("size", "group"), [(1 << 20, 64 << 20), (400, 64 << 20), (400, 900)])
def test_against_brute_force(spark, monkeypatch, size, group):
    monkeypatch.setattr(D, "SLICE_BYTES", size)
    monkeypatch.setattr(D, "GROUP_BYTES", group)
    rng = random.Random(2)
    vocabulary = ["ab", "c", "Dé", "e5", "f", "g"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(11, 40)))) for i in range(25)]
    items += [(100, "ab c ab c ab"), (101, "zz top"), (102, None), (103, "..."), (None, "only null id item here"), (7, "second text of seven " * 4), (104, "solo"), (105, " ".join(["c"] * 30))]
    rows = [(0, None), (1, ""), (2, "c " * 500), (3, "zz, TOP! solo"), (4, items[0][1] + " x " + items[1][1][3:])]
    for i in range(5, 60):
        w = make(rng.randint(0, 300))
        if i % 2:
            w[3:3] = (rng.choice(items)[1] or "").split() if rng.random() < 0.5 else items[3][1].split()[: rng.randint(5, 15)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    rows.append((4, "repeated id"))
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *slow(t, [x for x in items if x[1]])) for i, t in rows)
    for r in got:
        assert (r.clean_text == r.row.text) == (r.n_hit == 0) or r.row.text is None
        assert len(slow_words(r.clean_text)) == r.n_words - r.n_hit


def test_limits_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y"), (2, "p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0 1 2 3 4 a b c d e f g h i j")], "doc_id long, text string")
    assert {r.row.doc_id: (r.rejected, r.clean_text[-3:]) for r in D.decontaminate(docs, items, max_coverage=0.5).collect()} == {1: (True, "  y"), 2: (False, " 4 ")}
    assert {r.row.doc_id: r.rejected for r in D.decontaminate(docs, items, max_span=10).collect()} == {1: True, 2: False}
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.decontaminate(docs, none).collect()] == [0, 0]
    assert D.decontaminate(docs.limit(0), items).count() == 0
