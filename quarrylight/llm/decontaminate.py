"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised items are put into one automaton.  A document streams its words
through it and keeps the longest suffix that occurs in an item; where that is a
window or more long, the last words are a hit, and the state (or the ancestor
that holds the suffix of window length) tells the items.  Items shorter than a
window count as one window of their own length.

Items are put into automata of a bounded size (`SLICE_BYTES`), which one worker
goes through in turn: few stay in its memory, of more each is made once for
`HELD_BYTES` of text.  Slices are sent in groups of at most `GROUP_BYTES`, and
each group is one pass over the documents, with what was found so far
checkpointed in between; so neither the driver nor a broadcast ever holds more
of the benchmark than that.  A single item above a bound makes a slice or group
of its own.

Edge cases: null and empty texts have no words; null and wordless items are no
windows; an item without an id is called "null"; items that share an id count
once; repeated rows are returned each; other columns stay in `row`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint

#: Bytes of item text in one automaton, and of the slices that are sent at once.
SLICE_BYTES, GROUP_BYTES = 1 << 20, 64 << 20
#: Automata that a worker keeps; where there are more, texts of HELD_BYTES go through each in turn.
KEPT, HELD_BYTES = 4, 64 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, a-z and characters beyond ASCII."""
    return (text or b"").translate(_LOWER).split()


class Automaton:
    """A suffix automaton over word numbers, for many items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded: list[tuple[str, list[int]]] = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
            if words:
                coded.append((item, words))
                self._add(words)
        #: Items of the window that a state stands for; short items (length, item) that a state stands for.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.shortest = min([window, *(len(w) for _, w in coded)])
        for item, words in coded:
            state = 0
            for k, w in enumerate(words, 1):
                state = self.step[state][w]
                if len(words) < window and k == len(words):
                    self.short.setdefault(self._up(state, k), []).append((k, item))
                elif k >= window:
                    state = self._up(state, window)
                    self.items.setdefault(state, set()).add(item)

    def _up(self, state: int, k: int) -> int:
        """The state of the suffix of length k of what `state` stands for."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        there = self.step[last].get(w)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        state = -1 if there is not None else self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and there is None and w not in self.step[p]:
            self.step[p][w] = state
            p = self.link[p]
        if p < 0:
            return state
        q = self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            self.link[state] = q
            return state
        copy = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        if state >= 0:
            self.link[state] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy if state < 0 else state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Word spans (end exclusive) inside occurrences of windows, their items, and the longest match."""
        number = self.vocabulary.get
        coded = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
        turn = np.flatnonzero(np.diff(np.r_[False, coded >= 0, False].astype(np.int8))).reshape(-1, 2)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for a, b in turn[turn[:, 1] - turn[:, 0] >= self.shortest].tolist():
            state = size = 0
            for k, w in enumerate(coded[a:b].tolist(), a + 1):
                while state and w not in self.step[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.step[state]:
                    state, size = self.step[state][w], size + 1
                longest = max(longest, size)
                if size < self.shortest:
                    continue
                hit = 0
                if size >= self.window:
                    items |= self.items[self._up(state, self.window)]
                    hit = self.window
                t = state
                while t > 0 and self.short:
                    for length, item in self.short.get(t, ()):
                        if length <= size:
                            items.add(item)
                            hit = max(hit, length)
                    t = self.link[t]
                if hit:
                    if spans and spans[-1][1] >= k - hit:
                        start = min(spans[-1][0], k - hit)
                        spans[-1] = (start, k)
                        while len(spans) > 1 and spans[-2][1] >= start:
                            start = min(start, spans[-2][0])
                            spans[-2:] = [(start, k)]
                    else:
                        spans.append((k - hit, k))
        return spans, items, longest


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of some spans and what stands between those words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


_held: dict[str, Automaton] = {}
Slice = tuple[str, list[tuple[str, str]]]


def _automaton(named: Slice, window: int) -> Automaton:
    """One automaton for each slice and worker."""
    name, items = named
    key = f"{window} {name}"
    if key not in _held:
        while len(_held) >= KEPT:
            _held.pop(next(iter(_held)))
        _held[key] = Automaton(items, window)
    return _held[key]


def _groups(benchmark: DataFrame) -> Iterator[tuple[list[Slice], bool]]:
    """Items in groups of slices of a bounded size, read one by one, and whether a group is the last."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct().orderBy("text", "item")
    named = lambda items: (hashlib.sha256(repr(items).encode()).hexdigest(), items)
    ready: list[Slice] | None = None
    group: list[Slice] = []
    items: list[tuple[str, str]] = []
    size = total = 0
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if items and size + n > SLICE_BYTES:
            group.append(named(items))
            items, size = [], 0
            if total + n > GROUP_BYTES:
                if ready is not None:
                    yield ready, False
                ready, group, total = group, [], 0
        items.append((item, text))
        size += n
        total += n
    group.append(named(items))
    if ready is not None:
        yield ready, False
    yield group, True


def _together(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `most` bytes; one by one for 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(1).nbytes for b in held) >= most:
            yield held
            held = []
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int | None = None, max_coverage: float = 1.0) -> DataFrame:
    """Find and cut out the benchmark's windows.

    Returns for each row: row (the input row), n_words, spans (word spans hit,
    end exclusive), n_hit, items (ids of items with occurring windows, sorted as
    strings), longest (the longest match), clean_text (the text without its hit
    words) and rejected: a span longer than max_span words, or a share of hit
    words above max_coverage.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    state = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("clean_text", T.StringType())])
    kept = T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType()), *state.fields])
    now = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"), F.lit(None).cast("string").alias("clean_text"))
    for slices, last in _groups(benchmark):
        sent, most = spark.sparkContext.broadcast(slices), HELD_BYTES if len(slices) > KEPT else 0

        def run(batches: Iterable[pa.RecordBatch], sent=sent, last=last, most=most) -> Iterator[pa.RecordBatch]:
            for held in _together(batches, most):
                rows = [list(r) for b in held for r in zip(*(b.column(k).to_pylist() for k in (1, 3, 4, 5)))]
                words = [words_of(r[0].encode() if r[0] else b"") for r in rows]
                for r in rows:
                    r[1] = [(s["start"], s["end"]) for s in r[1]]
                for named in sent.value:
                    automaton = _automaton(named, window)
                    for r, ws in zip(rows, words):
                        found, more, longest = automaton.hits(ws)
                        r[1] = merge([*r[1], *found]) if found else r[1]
                        r[2], r[3] = sorted({*r[2], *more}) if more else r[2], max(r[3], longest)
                at = 0
                for batch in held:
                    part, at = range(at, at + batch.num_rows), at + batch.num_rows
                    columns = [[len(words[k]) for k in part], [[{"start": a, "end": b} for a, b in rows[k][1]] for k in part], [rows[k][2] for k in part], [rows[k][3] for k in part]]
                    columns.append([(cut_words(rows[k][0], rows[k][1]) if rows[k][1] else rows[k][0]) if last else None for k in part])
                    made = [pa.array(c, batch.schema.field(k + 2).type) for k, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=batch.schema)

        now = now.mapInArrow(run, kept)
        if not last:
            now = checkpoint(now)
            sent.unpersist()
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = now.withColumn("n_hit", n_hit)
    too_long = F.exists("spans", lambda x: x["end"] - x["start"] > max_span) if max_span is not None else F.lit(False)
    return out.withColumn("rejected", too_long | (F.col("n_hit") > max_coverage * F.col("n_words"))).drop("text")
