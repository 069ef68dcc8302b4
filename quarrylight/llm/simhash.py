"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is embedded as its 32 two-bit popcounts.  Changing a bit
moves one popcount by one, so the Manhattan distance of two embeddings is a
lower bound of the fingerprints' Hamming distance.  Two lattice points at a
distance of at most 2 share a point within a distance of 1 of both; so each
distinct fingerprint is dealt out to the grid cells within radius 1 of its
embedding (about 49), and fingerprints that meet in a cell are verified exactly.
A cell yields at most a spanning forest of its links, not all pairs; the links
make components, labelled by the smallest doc_id.

Copies meet once: all later steps run over distinct fingerprints.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; texts of one or two words hash the whole sequence; a null doc_id keeps
its row and never is a label unless no row of its component has an id; rows that
share a doc_id are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from ._graph import components

_ONES = np.uint64(0x5555555555555555)
_BITS = np.arange(64, dtype=np.uint64)


def row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.r_[0, ends[:-1]]
        f = xxhash.xxh64_intdigest
        hashes = np.array([f(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _BITS).sum())


def popcounts(fingerprints: np.ndarray) -> np.ndarray:
    """32 two-bit popcounts, in the place of the bits they count."""
    return fingerprints - ((fingerprints >> np.uint64(1)) & _ONES)


def cells(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every lattice point within Manhattan distance 1 of each embedding."""
    v = popcounts(fingerprints)
    rows, found = [np.arange(len(v))], [v]
    for i in range(32):
        unit = np.uint64(1 << 2 * i)
        count = (v >> np.uint64(2 * i)) & np.uint64(3)
        for able, moved in ((count < 2, v + unit), (count > 0, v - unit)):
            at = np.flatnonzero(able)
            rows.append(at)
            found.append(moved[at])
    return np.concatenate(rows), np.concatenate(found)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "key", "fp"])


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            rows, cell = cells(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[rows])], ["cell", "fp"])


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints of a cell that differ in at most `most` bits.

    Of any most + 1 bit blocks one is equal in a linked pair: only fingerprints
    that agree in a block are compared, a stretch at a time.
    """
    parent = list(range(len(fps)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    links = []
    edges = np.linspace(0, 64, most + 2).astype(int) if len(fps) > 64 else np.array([0])
    blocks = [(fps >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:])] or [np.zeros(len(fps), np.uint64)]
    for block in blocks:
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            group = order[a:b]
            for k in range(len(group) - 1):
                for j in np.flatnonzero(np.bitwise_count(fps[group[k + 1 :]] ^ fps[group[k]]) <= most).tolist():
                    x, y = int(group[k]), int(group[k + 1 + j])
                    p, q = root(x), root(y)
                    if p != q:
                        parent[p] = q
                        links.append((x, y))
    return links


def _link(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell may go on in the next batch."""

        def pairs(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(1, np.int64)
            sizes = np.diff(cuts)
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a in cuts[:-1][sizes == 2].reshape(-1, 1)[:, :1].T:  # the usual case, all at once
                near = np.bitwise_count((fp[a] ^ fp[a + 1]).view(np.uint64)) <= most
                src.append(fp[a][near])
                dst.append(fp[a + 1][near])
            for k in np.flatnonzero(sizes > 2).tolist():
                group = fp[cuts[k] : cuts[k + 1]]
                found = np.array(_forest(group.view(np.uint64), most), np.int64).reshape(-1, 2)
                src.append(group[found[:, 0]])
                dst.append(group[found[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

        for cell, fp in C.whole_runs(batches):
            yield pairs(cell, fp)

    return run


def simhash_components(docs: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, key, fp (long), component_id and label for each row; documents link at `distance` (at most 2) or fewer differing bits.

    key is a hash of doc_id and text: it tells rows with one doc_id apart.  label
    (a fingerprint) tells components apart; component_id doesn't where ids are
    null or shared.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the grid of radius 1 finds distances up to 2")
    spark = docs.sparkSession
    prints = C.checkpoint(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("key")).mapInArrow(_fingerprints, "doc_id long, key long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").mapInArrow(_deal, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell")
    links = C.checkpoint(dealt.mapInArrow(_link(distance), "src long, dst long").distinct())
    labels = components(links).withColumnRenamed("node", "fp")
    firsts = C.checkpoint(distinct.join(labels, "fp", "left").select("fp", "n", "first_id", F.coalesce("label", "fp").alias("label")))
    low = firsts.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_prints"))
    classes = C.join_hot(firsts, low, ["label"], firsts.count(), "n_prints").select("fp", "n", "component_id", "label")
    return C.join_hot(prints, classes, ["fp"], prints.count()).select("doc_id", "key", "fp", "component_id", "label")
