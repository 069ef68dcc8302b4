"""Substring deduplication with a count-min prefilter.

1. Every bucket of documents makes a count-min sketch of its word windows: two
   hash rows, kept sparse and sorted.  The partial sketches are merged range by
   range, and each bucket learns for each of its counters whether the merged
   count reaches two.  A merged count is never below the true one.
2. Only windows whose counters both reach two (their estimate is at least two)
   are grouped exactly, by a 96-bit key, for the smallest document that has
   them; buckets have already merged their own copies.
3. Each bucket removes the words that lie in a window which a smaller document
   also has.

Buckets never see each other's texts, no sketch is broadcast, and the width of
the sketch follows the corpus, so that the share of false candidates stays the
same at every size.

Edge cases: null and empty texts have no words and an empty rest; texts shorter
than a window lose nothing; rows that share a doc_id don't remove each other's
words; a null doc_id counts as larger than all others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import _common as C

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,end:long>>"


class _Windows:
    """The windows of a bucket's documents: hashes, documents and places."""

    def __init__(self, packs: pa.ChunkedArray, width: int, bits: int) -> None:
        self.ids, texts = C.unpack(packs)
        self.words = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        n = int(self.starts[-1])
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for ws in self.words for w in ws), np.uint64).reshape(n, 2)
        m = max(0, n - width + 1)
        lo, hi = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        for j in range(width if m else 0):
            lo *= _P
            lo += digests[j : j + m, 0]
            hi *= _Q
            hi += digests[j : j + m, 1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(owner[:m] == owner[width - 1 : width - 1 + m]) if m else np.empty(0, np.int64)
        self.at, self.owner, self.lo, self.hi = at, owner[at] if m else at, lo[at], hi[at]
        self.rows = []
        for h in (self.lo, self.hi):
            self.rows.append(np.unique(h >> np.uint64(64 - bits), return_inverse=True, return_counts=True))

    def candidates(self, replies: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """Indices of windows whose merged estimate is two or more."""
        keep = np.ones(len(self.at), bool)
        for r, (values, inverse, counts) in enumerate(self.rows):
            flags = np.concatenate([np.empty(0, bool), *(replies[k] for k in sorted(replies) if k[0] == r)])
            if len(flags) != len(values):
                raise ValueError("the replies don't fit the sketch")
            keep &= (flags | (counts > 1))[inverse]
        return np.flatnonzero(keep)

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of some windows, sorted: (lo, hi, the smallest id, the number of each window's key)."""
        lo, hi, ids = self.lo[which], (self.hi[which] & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.ids[self.owner[which]]
        order = np.lexsort((ids, hi, lo))
        lo, hi, ids = lo[order], hi[order], ids[order]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        number = np.empty(len(lo), np.int64)
        number[order] = np.cumsum(new) - 1
        return lo[new], hi[new], ids[new], number


def _replies(table: pa.Table, stage: int) -> dict[tuple[int, int], np.ndarray]:
    return {(r, p): C.decode_flags(f) for s, r, p, f in zip(*(table.column(c).to_pylist() for c in ("stage", "row", "part", "flags"))) if s == stage}


def _ask(width: int, bits: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), []
        for r, (values, _, _) in enumerate(_Windows(table.column("pack"), width, bits).rows):
            out += [(r, p, bucket, C.encode_sorted(values[a:b])) for p, a, b in C.cut(values, bits, parts)]
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("row", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("counters", pa.binary())))})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One range of the merged sketch; tells each bucket which of its counters reach two."""
    lists = [C.decode_sorted(x) for x in table.column("counters").to_pylist()]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    flags, at = (counts > 1)[inverse], np.cumsum([0, *map(len, lists)])
    return pa.table({"bucket": table.column("bucket"), "stage": pa.array([1] * len(lists), pa.int64()), "row": table.column("row"), "part": table.column("part"), "flags": pa.array([C.encode_flags(flags[a:b]) for a, b in zip(at, at[1:])], pa.binary())})


def _candidates(width: int, bits: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(packs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if packs.num_rows:
            bucket, w = packs.column("bucket")[0].as_py(), _Windows(packs.column("pack"), width, bits)
            lo, hi, ids, _ = w.keys(w.candidates(_replies(replies, 1)))
            known, of = np.unique(ids, return_inverse=True)
            for p, a, b in C.cut(lo, 64, parts):
                out.append((p, bucket, C.encode_sorted(lo[a:b]), C.encode_planes(hi[a:b]), C.encode_sorted(known.astype(np.uint64)), C.encode_planes(of[a:b].astype(np.uint32))))
        names = (("part", pa.int64()), ("bucket", pa.int64()), *((k, pa.binary()) for k in ("lo", "hi", "ids", "of")))
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(names)})

    return run


def _exact(table: pa.Table) -> pa.Table:
    """Exact groups of one range of keys: does a bucket other than the asking one have a smaller document?"""
    col = lambda k: table.column(k).to_pylist()
    los = [C.decode_sorted(x) for x in col("lo")]
    lo, hi = np.concatenate(los), np.concatenate([C.decode_planes(x, np.uint32) for x in col("hi")])
    ids = np.concatenate([C.decode_sorted(x).astype(np.int64)[C.decode_planes(y, np.uint32)] for x, y in zip(col("ids"), col("of"))])
    order = np.lexsort((ids, hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    first = ids[order][new][np.cumsum(new) - 1]
    flags = np.empty(len(lo), bool)
    flags[order] = first < ids[order]
    at = np.cumsum([0, *map(len, los)])
    n = len(los)
    return pa.table({"bucket": table.column("bucket"), "stage": pa.array([2] * n, pa.int64()), "row": pa.array([0] * n, pa.int64()), "part": table.column("part"), "flags": pa.array([C.encode_flags(flags[a:b]) for a, b in zip(at, at[1:])], pa.binary())})


def _remove(width: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(packs: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids: list[int] = []
        if packs.num_rows:
            w = _Windows(packs.column("pack"), width, bits)
            which = w.candidates(_replies(replies, 1))
            _, _, first, number = w.keys(which)
            answers = _replies(replies, 2)
            smaller = np.concatenate([np.empty(0, bool), *(answers[k] for k in sorted(answers))])
            gone = smaller[number] | (w.ids[w.owner[which]] > first[number]) if len(which) else np.empty(0, bool)
            edge = np.zeros(int(w.starts[-1]) + 1, np.int32)
            np.add.at(edge, w.at[which[gone]], 1)
            np.add.at(edge, w.at[which[gone]] + width, -1)
            covered = np.cumsum(edge[:-1]) > 0
            ids = w.ids.tolist()
            for k, words in enumerate(w.words):
                mask = covered[w.starts[k] : w.starts[k + 1]]
                n = int(mask.sum())
                turn = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])) if n else np.empty(0, np.int64)
                kept = words if not n else [x for x, m in zip(words, mask.tolist()) if not m]
                out.append((len(words), n, b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", span))
        return pa.table({"doc_id": C.id_column(ids)} | {k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(names)})

    return run


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove the words of windows that a document with a smaller doc_id also has.

    Returns a row for each input row: doc_id, n_words, n_removed, kept_text (kept
    words joined by one space) and removed_spans (word positions, end exclusive).
    Words are maximal runs without space, tab, line feed, vertical tab, form feed
    and carriage return.  Windows are judged on the input texts.
    """
    _, n_bytes = C.shape_of(docs)
    buckets = C.bucket_count(docs.sparkSession, n_bytes)
    bits = int(np.clip(np.ceil(np.log2(max(1, n_bytes // 2))), 16, 48))  # 3 to 6 counters a window, as words take about 6 bytes
    parts = C.shard_count(n_bytes)
    packed = C.pack_docs(docs, buckets)
    asked = packed.groupBy("bucket").applyInArrow(_ask(window, bits, parts), "row long, part long, bucket long, counters binary")
    reply = "bucket long, stage long, row long, part long, flags binary"
    sketch = asked.groupBy("row", "part").applyInArrow(_merge, reply)
    keys = packed.groupBy("bucket").cogroup(sketch.groupBy("bucket")).applyInArrow(_candidates(window, bits, parts), "part long, bucket long, lo binary, hi binary, ids binary, of binary")
    exact = keys.groupBy("part").applyInArrow(_exact, reply)
    return packed.groupBy("bucket").cogroup(sketch.unionByName(exact).groupBy("bucket")).applyInArrow(_remove(window, bits), SCHEMA)
