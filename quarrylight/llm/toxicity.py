"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, hint, target, negation, reporting, intent, harm),
and a chain of small transducers rewrites them: the threat transducer needs an
intent before a harm, the negation, report and target transducers mark an insult,
a hint or a threat that stands in their reach.  Composed, they are one
deterministic machine over word classes.  Each clause counts once, with its
gravest mark; the weights of the marks come from a logistic regression on
labelled rows.

The insult class has a seed word list and the stems that the training rows show:
prefixes of words that stand nearly only in toxic texts (insult), or that come
two times or more mostly in toxic texts (hint).  Near copies share a min-hash of
their word shingles; only one of them trains, so that a text that was copied
often isn't taken for many.
A clause whose gravest mark is a hint says little alone: the weights are those of
one, two and more such clauses in a text, where a clause with two hints or more
counts twice and clauses that negate or report theirs have a weight of their own.

Fitting uses a bounded sample of labelled rows (`max_rows`); scoring reads every
whole text and nothing but the text.

Edge cases: null and empty texts get the score of a text without marks; rows
that share a doc_id are scored each; label rows that share a doc_id count once
with their highest label; null labels are left out; without usable labels the
seed weights hold; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

_WORD = re.compile(r"[^\W\d_]+|[.!?;\n]")

# Seed words of each class (English, German, French, Spanish).
INSULT = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless clown clowns disgusting imbecile dumbass bastard bitch asshole retard vermin dumm dummkopf arschloch abschaum wertlos connard imbécile ordure minable estúpido imbécil basura escoria".split()
TARGET = "you your you're u he she they this that these those du dein ihr sie tu vous ton votre tú usted vosotros".split()
NEGATION = "not never isn't aren't wasn't don't doesn't without nicht kein keine nie jamais aucun nunca jamás tampoco".split()
REPORT = "said says wrote writes called quoted claimed alleged reported sagte schrieb dit écrit dijo escribió".split()
INTENT = "will gonna going shall must werde wirst vais va voy vas".split()
HARM = "kill hurt destroy beat shoot stab burn die töten umbringen verletzen tuer frapper matar golpear morir".split()

CLASSES = {"i": INSULT, "t": TARGET, "n": NEGATION, "r": REPORT, "w": INTENT, "h": HARM}
#: Features: the marks of a clause, gravest first, and the weight each has without training.
MARKS = {"h+": 6.0, "h": 5.5, "i+": 5.5, "i": 5.0, "i^": 2.0, "i-": 1.5, "h^": 1.0, "h-": 1.0, "j^": 0.2, "j-": 0.1}
#: Marks of clauses that hold hints, gravest first, and what each counts.
HINTED = {"jj": 2, "j+": 1, "j": 1}
#: Weights, without training, of a text where these counts come to one, to two, and to three or more.
HINTS = (0.5, 2.0, 4.0)


@dataclass
class Transducer:
    """A deterministic letter-to-letter transducer; step gives (next state, output)."""

    start: int
    step: dict[tuple[int, str], tuple[int, str]]

    def compose(self, then: Transducer, alphabet: Iterable[str]) -> Transducer:
        """Reads what self reads and writes what `then` makes of self's output."""
        number = {(self.start, then.start): 0}
        todo, step = [(self.start, then.start)], {}
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, middle = self.step[a, symbol]
                b2, out = then.step[b, middle]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                step[number[a, b], symbol] = (number[a2, b2], out)
        return Transducer(0, step)


_HELD = ("i", "h", "j")  # what a reach can mark
_MARKED = [x + sign for x in _HELD for sign in ("", "-", "^", "+")]
_RANK = {m: k for k, m in enumerate([*(m for m in MARKS if m[0] != "j"), *HINTED, *(m for m in MARKS if m[0] == "j")])}
_ALL = ["o", "b", "t", "n", "r", "w", *_MARKED]


def _reach(trigger: str, reach: int, change: dict[str, str], ends: str = "b") -> Transducer:
    """After `trigger`, symbols within `reach` words are changed; a boundary ends it."""
    step = {}
    for s in range(reach + 1):
        for x in _ALL:
            after = reach if x == trigger else 0 if x in ends else max(0, s - 1)
            step[s, x] = (after, change.get(x, x) if s else x)
    return Transducer(0, step)


def _threat() -> Transducer:
    """A harm without an intent before it is an ordinary word."""
    inner = _reach("w", 3, {})
    return Transducer(0, {(s, x): (after, "o" if x == "h" and not s else out) for (s, x), (after, out) in inner.step.items()})


def grammar() -> Transducer:
    alphabet = ["o", "b", "t", "n", "r", "w", *_HELD]
    whole = _threat()
    for trigger, reach, sign in (("n", 3, "-"), ("r", 12, "^"), ("t", 4, "+")):
        whole = whole.compose(_reach(trigger, reach, {x: x + sign for x in _HELD}), alphabet)
    return whole


@dataclass
class Model:
    stems: dict[str, str] = field(default_factory=dict)  # stem: its class, i or j (hint)
    weights: list[float] = field(default_factory=lambda: [*MARKS.values(), *HINTS])
    bias: float = -3.0


class Scorer:
    """Runs the grammar over texts; remembers the class of each word."""

    def __init__(self, model: Model) -> None:
        self.model, self.machine = model, grammar()
        self.known = {w: c for c, words in CLASSES.items() for w in words}
        self.stems = model.stems
        self.lengths = sorted({len(s) for s in self.stems})
        self.classes: dict[str, str] = {}

    def word(self, w: str) -> str:
        if w in ".!?;\n":
            return "b"
        found = {self.stems[w[:n]] for n in self.lengths if w[:n] in self.stems}
        return min(found) if found else self.known.get(w, "o")

    def clauses(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end, mark) of each clause with a mark."""
        words = _WORD.findall(text.lower()) if text else []
        known = self.classes
        if len(known) > 200_000:
            known.clear()
        for w in (w for w in set(words) if w not in known):
            known[w] = self.word(w)
        symbols = [known[w] for w in words]
        if not any(x in symbols for x in _HELD):
            return []
        out, step = [], self.machine.step
        state, begin, worst = 0, 0, None
        for k, x in enumerate([*symbols, "b"]):
            state, made = step[state, x]
            if made in _RANK:
                if made in HINTED and worst in HINTED:
                    worst = "jj"
                elif worst is None or _RANK[made] < _RANK[worst]:
                    worst = made
            if x == "b":
                if worst:
                    out.append((begin, k, worst))
                begin, worst = k + 1, None
        return out

    def features(self, text: str | None) -> list[float]:
        return self.of(self.clauses(text))

    def of(self, clauses: list[tuple[int, int, str]]) -> list[float]:
        found = Counter(m for _, _, m in clauses)
        hints = sum(n * found[m] for m, n in HINTED.items())
        return [*(float(np.log1p(found[m])) for m in MARKS), float(hints == 1), float(hints == 2), float(hints > 2)]

    def score(self, features: list[float]) -> float:
        z = self.model.bias + sum(w * x for w, x in zip(self.model.weights, features))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, y) of at most about max_rows labelled training rows, chosen by a hash of doc_id."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = usable.count()
    share = min(1.0, max_rows / max(1, n))
    few = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id").select("text", "y")


def _prefixes(text: str | None) -> tuple[set[str], set[str]]:
    """Prefixes of the text's words: those of any word, and those that come twice or more."""
    found = Counter(w[:k] for w in _WORD.findall((text or "").lower()) for k in range(3, min(len(w), 12) + 1))
    return set(found), {s for s, n in found.items() if n > 1}


def _prefix_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter() for _ in range(4)]
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            once, twice = _prefixes(text)
            counts[0 if y > 0 else 1].update(once)
            counts[2 if y > 0 else 3].update(twice)
    keys = list(counts[0])  # a prefix that no toxic text has marks nothing
    keys += [k for k in {*counts[1], *counts[3]} if k not in counts[0]]
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in counts)], ["stem", "t1", "c1", "t2", "c2"])


def _identities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes of each text's shingles of three words: near copies mostly share each of them."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            words = (text or "").lower().encode().split()
            grams = {b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
            hashes = np.frombuffer(b"".join(xxhash.xxh3_64_digest(g) for g in grams), np.uint64)
            with np.errstate(over="ignore"):
                out.append([int((hashes * np.uint64(m)).min() >> np.uint64(1)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3))], ["text", "y", "a", "b", "c"])


def unlike(rows: DataFrame) -> DataFrame:
    """Sampled rows (text, y) without near copies: of rows that share a min-hash, one with the highest label stays."""
    known = C.checkpoint(rows.mapInArrow(_identities, "text string, y int, a long, b long, c long").withColumn("id", F.xxhash64("text")))
    left = known.select("y", "id", "a", "b", "c")
    for k in "abc":
        left = left.groupBy(k).agg(F.max(F.struct("y", "id", *[x for x in "abc" if x != k])).alias("s")).select(k, "s.*")
    stay = left.select(F.col("id").alias("i"), F.col("y").alias("z")).distinct()
    return C.checkpoint(known.dropDuplicates(["id", "y"]).join(stay, (F.col("id") == F.col("i")) & (F.col("y") == F.col("z"))).select("text", "y"))


def _evidence(toxic: float, clean: float, base: float) -> float:
    """Log likelihood of the toxic share of a stem's texts against the base rate."""
    q = toxic / max(1e-9, toxic + clean)
    part = lambda n, a, b: n * np.log(a / b) if n else 0.0
    return part(toxic, q, base) + part(clean, 1 - q, 1 - base) if q > base else 0.0


def _evident(toxic: F.Column, clean: F.Column, base: float, least: float) -> F.Column:
    """`_evidence` of at least `least`, as an expression."""
    q = F.try_divide(toxic, toxic + clean)
    clean_part = F.when(clean > 0, clean * F.log((1 - q) / (1 - base))).otherwise(F.lit(0.0))
    return F.coalesce((toxic > 0) & (q > base) & (toxic * F.log(q / base) + clean_part >= least - 1e-9), F.lit(False))


def learn_stems(rows: DataFrame, evidence: float = 14.0) -> dict[str, str]:
    """Prefixes that mark toxic texts, as i (nearly never in others) or j (twice or more mostly in toxic ones).

    Only prefixes with enough evidence come to the driver; the sample's bound is theirs.
    """
    totals = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return {}
    base = n_toxic / (n_toxic + n_clean)
    counts = rows.mapInArrow(_prefix_counts, "stem string, t1 long, c1 long, t2 long, c2 long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("t1", "c1", "t2", "c2")))
    strong = (F.col("c1") <= 0.02 * F.col("t1")) & _evident(F.col("t1"), F.col("c1"), base, evidence)
    hint = (F.col("c2") <= 0.35 * F.col("t2")) & _evident(F.col("t2"), F.col("c2"), base, evidence)
    few = counts.where(strong | hint)
    found = {r["stem"]: (r["t1"], r["c1"], r["t2"], r["c2"]) for r in few.collect()}
    good: dict[str, tuple[str, int]] = {}
    for s, (t1, c1, t2, c2) in found.items():
        if c1 <= 0.02 * t1 and _evidence(t1, c1, base) >= evidence:
            good[s] = ("i", t1)
        elif c2 <= 0.35 * t2 and _evidence(t2, c2, base) >= evidence:
            good[s] = ("j", t2)
    stems: dict[str, str] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:k] in stems for k in range(3, len(s) + 1)):
            continue
        if good[s][0] == "j" and any(t.startswith(s) and good[t][0] == "i" and found[t][0] >= 0.6 * found[s][0] for t in good):
            continue  # a longer stem says the same more surely
        while longer := [t for t in good if len(t) == len(s) + 1 and t.startswith(s) and good[t][0] == good[s][0] and good[t][1] >= 0.97 * good[s][1]]:
            s = longer[0]
        stems[s] = good[s][0]
    return stems


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Learn stems and weights from at most about `max_rows` labelled rows that aren't held out."""
    rows = unlike(sample(docs, labels, max_rows))
    model = Model(stems=learn_stems(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = rows.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()  # at most max_rows rows
    if len({r["y"] for r in found}) < 2:
        return model
    x = np.array([[1.0, *r["x"]] for r in found])
    y, n = np.array([float(r["y"] > 0) for r in found]), np.array([float(r["count"]) for r in found])
    prior = np.array([-3.0, *MARKS.values(), *HINTS])
    w, ridge = prior.copy(), np.full(x.shape[1], 0.5)
    for _ in range(50):  # Newton steps of a ridge around the seed weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * (w - prior)
        h = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.weights = float(w[0]), [float(v) for v in w[1:]]
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """row (the input row), score, predicted and the marked clauses (first word, end, mark) of each row."""
    clause = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("mark", T.StringType())]))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("clauses", clause)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("mark", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.clauses(t) for t in batch.column(1).to_pylist()]
            scores = [scorer.score(scorer.of(clauses)) for clauses in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([[{"start": a, "end": b, "mark": m} for a, b, m in c] for c in found], kind)], ["row", "score", "predicted", "clauses"])
        del scorer
        C.release()

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
