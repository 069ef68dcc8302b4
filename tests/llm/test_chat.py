import random

from quarrylight.llm.chat import MARKS, format_windows, read_windows


def talks():
    rng = random.Random(6)
    rows = []
    texts = ["</s>[INST] ok [/INST]", "~1 ~ <h>[user]x</h>", "", None, "plain words " * 9, "é漢😀 [a] <b> ~0"]
    for c in range(40):
        for t in range(rng.randint(1, 30)):
            rows.append((c, t, "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2], rng.choice(texts)))
    rows += [(500, 1, "assistant", "same"), (500, 1, "assistant", "same"), (500, 1, None, "x"), (500, None, "tool]<", "y"), (None, 0, "user", "no conversation"), (501, 0, "assistant", "long " * 3000), (501, 1, "user", "after")]
    rows += [(502, t, "system" if t == 4 else ["user", "assistant"][t % 2], "late system " * 3) for t in range(20)] + [(502, 30, "system", "a second one")]
    return rows


def test_round_trip_and_budget(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, window int").repartition(5)
    windows = format_windows(df, budget=90, history=30)
    got = {r.conv_id: r for r in read_windows(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own = [(r, t) for _, r, t in sorted(own)]
        assert [(x.role, x.text) for x in got[c].turns] == own
        assert got[c].losses == [t for r, t in own if r == "assistant"]
    many = windows.collect()
    cost = lambda t: len((t or "").encode().split()) + MARKS
    systems = {}
    for c, t, role, text in sorted(rows, key=str):
        if role == "system" and (c not in systems or t < systems[c][0]):
            systems[c] = (t, text)
    for w in many:
        longest = max(cost(t) for cc, _, _, t in rows if cc == w.conv_id)
        system = cost(systems[w.conv_id][1]) if w.conv_id in systems else 0
        assert w.n_tokens <= 90 or w.n_new == 1 and longest + system > 90 and w.n_tokens <= longest + system
        if systems.get(w.conv_id, (1,))[0] == 0:
            assert "[system]" in w.formatted[:11]
    late = sorted((w for w in many if w.conv_id == 502), key=lambda w: w.window)
    has = ["late system late system late system </h>" in w.formatted and w.formatted.startswith("<h>[system]") for w in late]
    first = next(k for k, w in enumerate(late) if "<s>[system]late" in w.formatted)
    assert has[first + 1 :] and all(has[first + 1 :]) and not any(has[: first + 1])
    assert len(many) > len(by) and any("<h>[user]" in w.formatted for w in many)


def test_budget_holds_beside_long_turns(spark):
    rows = [(1, 0, "user", "u " * 50), (1, 1, "assistant", "a " * 490), (1, 2, "user", "x"), (2, 0, "system", "s " * 500)] + [(2, t, "user", "y " * 30) for t in range(1, 9)]
    found = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(w.n_tokens <= 512 for w in found if w.conv_id == 1)
    assert all(w.n_tokens == 504 + 34 and w.n_new == 1 for w in found if w.conv_id == 2 and "<s>[system]" not in w.formatted)


def test_own_token_counts(spark):
    rows = [(1, t, "user", "one", 100) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    found = format_windows(df, budget=300, history=0, tokens=df.n).collect()
    assert sum(w.n_new for w in found) == 9 and sum(w.n_tokens for w in found) == 9 * (100 + MARKS) and max(w.n_tokens for w in found) <= 300


def test_empty_table(spark):
    assert format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
