import random
import re

import xxhash

from quarrylight.llm.simhash import fingerprint, simhash_components


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"v{i}Ü" for i in range(300)]
    rows = [(1, None), (0, ""), (5, "One"), (6, "one"), (7, "two words"), (None, "two words"), (8, "\x1c odd   space"), (8, "again")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(12):
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 * g + k + 20, " ".join(copy)))
    rows += [(5000 + k, "a hot text of exact copies here") for k in range(300)]
    fps = [slow_print(t) for _, t in rows]
    assert fps == [fingerprint(t.encode() if t is not None else None) for _, t in rows]
    comp = list(range(len(rows)))

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                comp[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        r = root(a)
        low[r] = min(x for x in (low.get(r), i) if x is not None) if (low.get(r) is not None or i is not None) else None
    want = sorted((str(i), fps[a], low[root(a)]) for a, (i, _) in enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(6)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash_components(df).collect())
    assert got == want


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dense_cluster_of_fingerprints():
    import numpy as np

    from quarrylight.llm.simhash import _forest, cells

    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    links = _forest(fps, 2)
    parent = list(range(len(fps)))

    def root(parent, a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[root(parent, a)] = root(parent, b)
    slow = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 2:
                slow[root(slow, a)] = root(slow, b)
    assert len({root(parent, a) for a in range(len(fps))}) == len({root(slow, a) for a in range(len(fps))})
    assert len(links) <= len(fps) - 1
    rows, found = cells(fps)
    sets = [set(found[rows == k].tolist()) for k in range(len(fps))]
    for a in range(0, len(fps), 9):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 2:
                assert sets[a] & sets[b]
