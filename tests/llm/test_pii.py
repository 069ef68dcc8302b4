import random
import re

from pyspark.sql import functions as F

from quarrylight.llm.pii import estimate, find_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                ok = 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            else:
                ok = kind != "phone" or 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "x.y@mail.example.com", "a@b.c_d@e.f", "q@@r.s", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "010.00255.3.0256", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (555) 555-1234", "+49 30.1234567 8", "+1 2", "++44 20 7946 0958", "word", "é漢😀", "\n", "- -", "7", "00 00", "", "", "@", ".", "+"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "-", "."]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [None, "", "9" * 5000, "a" * 20000 + "@", "1." * 3000, ("4111 1111 1111 1111x" * 300), "+" + "1 " * 4000]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, found int, base string").repartition(4)
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.name, x.start, x.end) for x in got[i].base] == slow(t), t
        assert set(got[i].base) <= set(got[i].all)
        assert all(a.end <= b.start for a, b in zip(sorted(x for x in got[i].all if x not in got[i].base), sorted(x for x in got[i].all if x not in got[i].base)[1:]))


def test_secrets_are_added_and_words_are_not(spark):
    rng = random.Random(3)
    rows = [(i, f'some words token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}" and more a{i}@b.com') for i in range(60)]
    rows += [(100 + i, f"plain text internationalizationsofeverything {i}") for i in range(60)]
    got = {r.doc_id: [x.name for x in r.all] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["secret", "email"] for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_context_proposes_candidates(spark):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyz23456789_.-") for _ in range(n))
    rows = [(i, f"settings password = '{key(11)}7x' for user {i} and so on") for i in range(200)]
    rows += [(1000 + i, f"the word password {i} and token are only words: nothing follows") for i in range(200)]
    rows += [(2000 + i, f"call 555-0{i:03d} 20{i:02d} today") for i in range(100)] + [(3000, "x"), (3000, "password = 'abcdefg9_1'")]
    got = [(r.doc_id, [(x.name, x.start, x.end) for x in r.all]) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    found = {i: s for i, s in got}
    assert sum(found[i] == [("secret", 21, 34)] for i in range(200)) >= 190
    assert not any(found[1000 + i] for i in range(200))
    assert len([1 for i, _ in got if i == 3000]) == 2


def test_em_against_numpy(spark):
    import numpy as np

    rng = random.Random(5)
    patterns = []
    for _ in range(2000):
        y = rng.random() < 0.3
        patterns.append(",".join(str(rng.choices([1, -1, 0], [6, 1, 3] if y else [1, 5, 4])[0]) for _ in range(4)))
    df = spark.createDataFrame([([{"kind": 1, "pattern": p}, {"kind": 2, "pattern": "1,1,0,0"}],) for p in patterns], "found array<struct<kind:int,pattern:string>>")
    got = {r.pattern: r.posterior for r in estimate(df, rounds=15).where("kind = 1").collect()}
    names = sorted(set(patterns))
    v = np.array([[int(x) for x in p.split(",")] for p in names])
    n = np.array([patterns.count(p) for p in names], float)
    prior, t, f = 0.5, np.tile([0.7, 0.1], (4, 1)), np.tile([0.2, 0.4], (4, 1))
    chance = lambda q: np.prod([np.where(v[:, i] == 1, q[i, 0], np.where(v[:, i] == -1, q[i, 1], 1 - q[i].sum())) for i in range(4)], axis=0)
    post = lambda: prior * chance(t) / (prior * chance(t) + (1 - prior) * chance(f))
    for _ in range(15):
        w = n * post()
        rest = n - w
        t = np.array([[(w[v[:, i] == s].sum() + 1) / (w.sum() + 3) for s in (1, -1)] for i in range(4)])
        t[0, 1] = min(t[0, 1], 0.02)
        f = np.array([[(rest[v[:, i] == s].sum() + 1) / (rest.sum() + 3) for s in (1, -1)] for i in range(4)])
        prior = (w.sum() + 1) / (n.sum() + 2)
    assert np.allclose([got[p] for p in names], post())


def test_empty_table_and_no_candidates(spark):
    schema = "doc_id long, text string"
    assert find_pii(spark.createDataFrame([], schema)).count() == 0
    r = find_pii(spark.createDataFrame([(1, "nothing"), (None, None)], schema)).select(F.size("all").alias("n")).collect()
    assert [x.n for x in r] == [0, 0]


def test_many_matches_have_their_places(spark):
    text = "é a@b.cc 1.2.3.4 " * 2500
    r = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.name, x.start, x.end) for x in r.base] == slow(text)
