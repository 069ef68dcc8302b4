import random

from quarrylight.llm.substring_dedup import substring_dedup


def brute(rows, width=13):
    seen = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda i: float("inf") if i is None else i
    for i, t in order:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "one two"), (None, " ".join(passage)), (7, " ".join(passage)), (7, " ".join(passage))]
    for i in range(10, 70):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            words[5:5] = passage[rng.randint(0, 30) :]
        rows.append((i, rng.choice([" ", "\t", "\n", "  "]).join(words)))
    rows.append((99, " ".join(["same"] * 5000)))
    rows.append((98, "x y " * 40))
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, bucket string, part int").repartition(5)
    got = [tuple(r) for r in substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
