import random

from quarrylight.llm import toxicity as X


def test_grammar_marks_clauses():
    scorer = X.Scorer(X.Model(stems={"blorgh": "i", "hin": "j"}))
    marks = lambda t: [m for _, _, m in scorer.clauses(t)]
    assert marks("such an idiot") == ["i"]
    assert marks("you are an idiot. a fine day; a moron") == ["i+", "i"]
    assert marks("not an idiot") == ["i-"]
    assert marks("he said once that somebody there was an idiot") == ["i^"]
    assert marks("somebody will kill") == ["h"] and marks("i will kill you") == ["h"] and marks("you will destroy") == ["h+"]
    assert marks("never will destroy") == ["h-"]
    assert marks("it did destroy") == []
    assert marks("a blorghx thing") == ["i"]
    assert marks("hinx") == ["j"] and marks("hinx and hiny") == ["jj"] and marks("hinx. hiny") == ["j", "j"]
    assert marks("you hinx") == ["j+"] and marks("never hinx") == ["j-"] and marks("she wrote hinx") == ["j^"] and marks("hinx idiot") == ["i"]
    assert marks("") == marks(None) == []


def test_learning_and_held_out_rows(spark):
    rng = random.Random(8)
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "so", "te"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["zorf" + word(), "moron"]))
        docs.append((i, " ".join(words), "x"))
        if i % 3 < 2:
            labels.append((i, int(toxic)))
    docs += [(None, None, "x"), (3, "", "x"), (3, "idiot " * 3, "x")]
    labels += [(4, None), (None, 1), (1, 0), (1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.fit(d, labelled)
    assert any("zorfba".startswith(s) for s in model.stems)
    got = {(r.row.doc_id, r.row.text): r for r in X.score(d, model).collect()}
    assert len(got) == len(docs)
    right = [got[i, t].predicted == int(i % 6 == 0) for i, t, _ in docs[:900]]
    assert sum(right) >= 0.98 * 900
    assert got[3, "idiot " * 3].predicted == 1 and 0 <= got[None, None].score < 0.3
    held = {r.doc_id: r.h for r in d.select("doc_id", X.held_out().alias("h")).collect()}
    import zlib

    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_the_machine_against_rules_by_word():
    """Every mark of a random clause, by looking back from each word."""
    rng = random.Random(4)
    scorer = X.Scorer(X.Model(stems={"hin": "j"}))
    words = {"o": "tree", "t": "you", "n": "never", "r": "said", "w": "will", "h": "kill", "i": "idiot", "j": "hint"}
    rank = [*(m for m in X.MARKS if m[0] != "j"), *X.HINTED, *(m for m in X.MARKS if m[0] == "j")]
    for _ in range(500):
        clause = [rng.choice("ooootnrwhij") for _ in range(rng.randint(1, 16))]
        near = lambda k, x, reach: x in clause[max(0, k - reach) : k]
        made = []
        for k, x in enumerate(clause):
            if x in "ij" or x == "h" and near(k, "w", 3):
                made.append(x + ("-" if near(k, "n", 3) else "^" if near(k, "r", 12) else "+" if near(k, "t", 4) else ""))
        worst = min(made, key=rank.index, default=None)
        if worst in X.HINTED and sum(m in X.HINTED for m in made) > 1:
            worst = "jj"
        assert [m for _, _, m in scorer.clauses(" ".join(words[x] for x in clause))] == ([worst] if worst else []), clause


def test_long_text_and_ties(spark):
    rows = [(1, "tree " * 400_000 + "you idiot"), (2, "you idiot"), (2, "you idiot")]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string"), X.Model()).collect()
    assert len({r.score for r in got}) == 1 and len(got) == 3
    at = got[0].score
    assert X.score(spark.createDataFrame(rows[1:], "doc_id long, text string"), X.Model(), threshold=at).first().predicted == 1


def test_without_labels_and_rows(spark):
    d = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(d, X.fit(d, none)).first().predicted in (0, 1)
    assert X.score(d.limit(0), X.fit(d.limit(0), none)).count() == 0
