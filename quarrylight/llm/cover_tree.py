"""Exact top-k inner products by dual-tree search over cover trees.

Queries and each block of data have a cover tree: a node has a centre, the
covering radius of all points below it, and children that cover its points
within a fraction of that radius.  Pairs of a query node and a data node are
visited from the top; a pair is left out when no point below the data node can
reach the worst k-th score of the queries below the query node:

    <q, p> <= <cq, cp> + rq |cp| + rp |cq| + rq rp

Where children would hardly be tighter than their node, as among points that lie
in all directions, it stays whole, and its pairs with a query node are scored by
matrix products: in single precision where no sum on the way can leave 2**24, so
that they are exact, else in double precision.

The data's trees are built once and written as blocks; queries come to the tasks
in chunks of a bounded size, one chunk after another.  A task keeps the k best
of each query over all the blocks it reads and sends k rows for each on, so the
shuffle holds k rows for each query and task.

Components are floor(256 * x), as doubles; scores are exact integers below 2**53,
beyond that they are the double's value, held within the range of a long (0 where
infinite parts cancel).  Edge cases: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; shorter vectors count as padded with
zeros; rows that share an id are one query (the first by its vector), are no
candidates for it, and are candidates each for others; ties go to the smaller
id; fewer than k candidates are all returned; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Queries sent to the tasks at once, points in a data block, points in a leaf.
QUERIES, BLOCK, LEAF = 16_384, 8_192, 64
#: A child covers its points within this part of its parent's radius, unless a node would have more than MOST children.
SHRINK, MOST = 0.6, 48
#: A node stays whole if its children would leave their points this part of the mean distance: their bounds would leave nothing out.
LOOSE = 0.7
#: Queries and points whose scores are held at once; fewer points while a query has less than k candidates.
ROWS, COLUMNS, FEW = 1024, 512, 256

#: Scores are held within this, which a long and a double both have.
FARTHEST = 2.0**62


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    begin: int  # all points below stand from here
    end: int  # to here in the tree's vectors
    children: list[Node]


class CoverTree:
    """Centres are points of the set; every point below a node is within its radius of the centre.

    ``vectors`` are put so that the points below a node stand together; ``order`` has their places before that.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.squares = vectors, (vectors**2).sum(axis=1)
        self.longest = float(np.sqrt(self.squares.max())) if len(vectors) else 0.0
        found: list[np.ndarray] = []
        self.root = self._node(0, np.arange(len(vectors)), 0, found) if len(vectors) else None
        self.order = np.concatenate(found) if found else np.empty(0, np.int64)
        self.vectors = self._smallest(vectors[self.order])
        del self.squares

    def _smallest(self, vectors: np.ndarray) -> np.ndarray:
        """As 16-bit integers where that changes nothing: trees are stored and sent."""
        small = vectors.astype(np.int16) if self.longest < 1 << 15 else vectors
        return small if (small == vectors).all() else vectors

    def _away(self, centre: int, points: np.ndarray) -> np.ndarray:
        if self.longest < 1 << 25:  # sums of integers are exact so far
            return np.sqrt(np.maximum(self.squares[points] - 2 * (self.vectors[points] @ self.vectors[centre]) + self.squares[centre], 0))
        return np.sqrt(((self.vectors[points] - self.vectors[centre]) ** 2).sum(axis=1))

    def _node(self, centre: int, points: np.ndarray, begin: int, found: list[np.ndarray]) -> Node:
        away = self._away(centre, points)
        radius = float(away.max())
        node = Node(self.vectors[centre], float(np.sqrt(self.squares[centre])), radius * (1 + 1e-9) + 1e-6, begin, begin + len(points), [])
        if len(points) > LEAF and radius > 0 and np.isfinite(radius):
            near, owner, centres = away, np.zeros(len(points), np.int64), [centre]
            while near.max() > SHRINK * radius and len(centres) < MOST:  # separated centres, farthest first
                far = int(points[near.argmax()])
                d = self._away(far, points)
                closer = d < near
                owner[closer], near = len(centres), np.where(closer, d, near)
                centres.append(far)
            if near.sum() * (len(points) - 1) <= LOOSE * away.sum() * (len(points) - len(centres)):  # centres are near themselves and don't count
                for k, c in enumerate(centres):
                    if len(own := points[owner == k]):
                        node.children.append(self._node(c, own, node.children[-1].end if node.children else begin, found))
                return node
        found.append(points)
        return node


class Best:
    """The k best of each query so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the queries in `rows` with the candidates `ids`."""
        worst = self.score[rows, -1]
        if len(ids) > self.k and np.isinf(worst).any():  # k of these are so good at least
            others = np.where(ids[None, :] == self.ids[rows][:, None], -np.inf, scores)
            worst = np.maximum(worst, np.partition(others, -self.k, axis=1)[:, -self.k])
        # Scores in single precision are exact, and so are the worst ones that they are held against.
        worst = worst.astype(scores.dtype)
        reach = np.flatnonzero(scores.max(axis=1) >= worst)  # most queries find nothing
        if not len(reach):
            return
        rows, scores = rows[reach], scores[reach]
        at = np.flatnonzero(scores >= worst[reach][:, None])
        r, c = np.divmod(at, len(ids))
        row, s, i = rows[r], scores.ravel()[at].astype(np.float64), ids[c]
        last, last_id = self.score[row, -1], self.id[row, -1]
        new = (i != self.ids[row]) & ((s > last) | (s == last) & (i < last_id))
        if not new.any():
            return
        row, s, i = row[new], s[new], i[new]
        old = np.unique(row)
        row, s, i = np.r_[np.repeat(old, self.k), row], np.r_[self.score[old].ravel(), s], np.r_[self.id[old].ravel(), i]
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        first = np.searchsorted(row, old)  # each has k rows at least
        at = first[:, None] + np.arange(self.k)
        self.score[old], self.id[old] = s[at], i[at]


def _scores(queries: CoverTree, data: CoverTree) -> type:
    """The type in which all sums on the way to a score are exact, if there is one: none is above the product of the lengths."""
    whole = all(t.vectors.dtype == np.int16 for t in (queries, data))
    return np.float32 if whole and queries.longest * data.longest < 1 << 24 else np.float64


def dual_search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Offer every pair that may count; returns the number of pairs of points looked at."""
    looked = 0
    if queries.root is None or data.root is None:
        return looked
    kind = _scores(queries, data)
    points, ids = data.vectors.astype(kind), ids[data.order]

    def bound(q: Node, p: Node) -> float:
        b = float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return b + 1e-9 * abs(b) + 1e-6

    todo = [(bound(queries.root, data.root), queries.root, data.root)]
    while todo:
        most, q, p = todo.pop()
        if most < best.score[queries.order[q.begin : q.end], -1].min():
            continue
        if not q.children and not p.children:
            looked += (q.end - q.begin) * (p.end - p.begin)
            for a in range(q.begin, q.end, ROWS):
                some = slice(a, min(a + ROWS, q.end))
                rows, asked, at = queries.order[some], queries.vectors[some].astype(kind), p.begin
                while at < p.end:
                    step = FEW if np.isinf(best.score[rows, -1]).any() else COLUMNS
                    part = slice(at, min(at + step, p.end))
                    scores = asked @ points[part].T
                    if kind == np.float64:
                        scores = np.clip(np.nan_to_num(scores, nan=0.0), -FARTHEST, FARTHEST)
                    best.offer(rows, scores, ids[part])
                    at = part.stop
            continue
        split_q = q.children and (not p.children or q.radius >= p.radius)
        pairs = [(c, p) for c in q.children] if split_q else [(q, c) for c in p.children]
        todo += sorted(((bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])  # the best is looked at first
    return looked


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v the integer components as doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are integers
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: whole(c * 256)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_trees: dict[str, CoverTree] = {}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates among `vectors`."""
    spark = vectors.sparkSession
    data = usable(vectors)
    once = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    shape = once.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(int(shape["w"] or 0), int(data.agg(F.max(F.size("v"))).first()[0] or 0))
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([pickle.dumps(CoverTree(_matrix(part.column(1), width)), 5)], pa.binary())], ["ids", "tree"])

    chunks, found = max(1, -(-int(shape["n"]) // QUERIES)), None
    blocks = data.mapInArrow(build, "ids binary, tree binary")
    if chunks > 1:  # the data's trees are built once, whatever the number of passes
        once, blocks = C.checkpoint(once), C.checkpoint(blocks)
    for c in range(chunks):
        rows = once.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()  # about QUERIES rows
        matrix = np.zeros((len(rows), width))
        for r, row in enumerate(rows):
            matrix[r, : len(row["v"])] = row["v"]
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, np.array([r["vec_id"] for r in rows], np.int64), matrix))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            name, q_ids, q_matrix = sent.value
            if name not in _trees:
                _trees.clear()
                _trees[name] = CoverTree(q_matrix)
            best = Best(q_ids, k)
            for batch in batches:
                for ids, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    dual_search(_trees[name], pickle.loads(tree), np.frombuffer(ids, np.int64), best)
            filled = np.isfinite(best.score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, filled.sum(axis=1))), pa.array(best.id[filled]), pa.array(best.score[filled].astype(np.int64))], ["query_id", "vec_id", "score"])

        part = blocks.mapInArrow(run, "query_id long, vec_id long, score long")
        if chunks > 1:  # one chunk of queries is held at a time
            part = C.checkpoint(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
