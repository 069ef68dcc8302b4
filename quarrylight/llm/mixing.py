"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words, so each of its documents should be
taken target / source_size times: a whole number of copies and a fractional
one.  The fractions are rounded in pairs: mass (words) moves at random from one
document of a pair to the other until one of them is integral, which keeps every
document's expectation and the source's total.  A group of documents (a hash
class within a source, of a bounded size) leaves at most one document with a
fraction; these residuals meet in a reduction tree, 32 groups at a time, until
each source has one left, which is rounded by a coin.  So the total of a source
misses its target by less than one document.

All choices follow from hashes of the rows: reruns agree on any cluster.

Edge cases: a null text has no words; null sources form one source, last in
order; a null doc_id is an id like any other; repeated rows are rounded each;
documents without words are taken or not but add nothing; an empty table gives
no rows; other columns are ignored by `mixture` and kept by `mixed_documents`,
where of rows alike in doc_id, source and text those with the smaller hash of the
whole row come first.

Repeated rows are counted and numbered (nth), never sorted in one task; sources
and keys that hold many rows are joined by broadcast (`_common.join_hot`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Documents that are rounded together, and groups whose residuals meet.
GROUP, FAN = 1024, 32
_ROW = "doc_id long, key long, nth long, size long, rank int, part long, p double"


def row_key() -> F.Column:
    """Tells rows with one doc_id apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with rank and target.  One row for each source is all that meets in one task.

    What remains above the caps is shared by weight again until no target is
    above `most` times its source: that is one level of target / weight for all
    sources below their cap, found by going through the caps in ascending order.
    """
    one = Window.partitionBy(F.lit(0))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", cycle).withColumn("cap", most * F.col("source_size"))
    by_cap = one.orderBy(F.col("cap") / F.col("w"), "rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (share * F.sum("source_size").over(one) - before) / left)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level").alias("l")))
    final = level.withColumn("l", F.min(fits).over(one)["l"])
    return final.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("l") * F.col("w"), F.col("cap"))).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions, keeping the sum of p * size; at most one entry stays between 0 and 1."""
    p = p.copy()
    for k in np.flatnonzero((size == 0) & (p > 0) & (p < 1)):
        p[k] = float(rng.random() < p[k])
    i = -1
    for j in np.flatnonzero((p > 0) & (p < 1)).tolist():
        if i < 0:
            i = j
            continue
        wi, wj, pi, pj = float(size[i]), float(size[j]), p[i], p[j]
        up = min((1 - pi) * wi, pj * wj)  # words that can move from j to i
        down = min(pi * wi, (1 - pj) * wj)
        if rng.random() * (up + down) < down:
            full = up == (1 - pi) * wi
            p[i], p[j] = (1.0 if full else pi + up / wi), (0.0 if up == pj * wj else pj - up / wj)
        else:
            none = down == pi * wi
            p[i], p[j] = (0.0 if none else pi - down / wi), (1.0 if down == (1 - pj) * wj else pj + down / wj)
        open_ = [k for k in (i, j) if 1e-12 < p[k] < 1 - 1e-12]
        for k in (i, j):
            if k not in open_:
                p[k] = round(p[k])
        i = open_[0] if open_ else -1
    return p


def _round(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        columns = {k: table.column(k).fill_null(0).to_numpy() for k in ("doc_id", "key", "nth", "size", "p")}
        order = np.lexsort((columns["nth"], columns["key"], columns["doc_id"], C.bucket_of(columns["key"], 1 << 62)))
        rank, part = table.column("rank")[0].as_py(), table.column("part")[0].as_py()
        rng = np.random.default_rng([rank, part & (2**63 - 1), level])
        p = pivot(columns["p"][order], columns["size"][order], rng)
        if last:
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
        out = table.take(pa.array(order))
        return out.set_column(out.schema.get_field_index("p"), "p", pa.array(p))

    return run


def _numbered(counted: DataFrame, most: int = 4096) -> DataFrame:
    """A row for each of the `m` rows that a row of counted stands for, numbered by nth from 1.  What comes more than `most` times is dealt out before."""
    few = counted.where(F.col("m") <= most).withColumn("first", F.lit(0).cast("long"))
    stretches = counted.where(F.col("m") > most).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(most).cast("long")))).withColumn("m", F.least(F.lit(most), F.col("m") - F.col("first")))
    both = few.unionByName(stretches.repartition("key", "first"))
    return both.withColumn("nth", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("m")))).drop("first", "m")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, key, nth, source, size, source_size, target, copies and taken (copies * size) for each row.

    Sources by code point, null last, have `weights` in turn and share
    `share` times all words; no target is above `most` times its source.
    (key, nth) tells rows with one doc_id apart: see `row_key`.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    rows = C.checkpoint(plain.select("doc_id", "source", row_key().alias("key"), size.alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = C.checkpoint(targets(sums, weights, share, most).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = aims.select(F.col("source").alias("s"), "rank", "source_size", "target", rate.alias("rate"), "n", F.ceil(F.col("n") / GROUP).alias("parts"))
    numbered = _numbered(rows.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("m")))
    named = (F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"))
    sided = C.checkpoint(numbered.select("doc_id", "key", "nth", "size", *named))
    joined = C.join_hot(sided, full.withColumnsRenamed({"s": "source"}).select(*named, "n", "rank", "rate", "parts"), ["no_source", "name"], sided.count())
    start = joined.withColumn("part", F.pmod(F.xxhash64("key", "nth"), F.col("parts"))).withColumn("p", F.col("rate") - F.floor("rate"))
    deepest = int(aims.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    groups, level = max(1, -(-deepest // GROUP)), 0
    now, decided = start.select(*[c.split()[0] for c in _ROW.split(", ")]), None
    while True:
        now = C.checkpoint(now.groupBy("rank", "part").applyInArrow(_round(level, groups == 1), _ROW))
        whole = now.where("p = 0 OR p = 1")
        decided = whole if decided is None else decided.unionByName(whole)
        if groups == 1:
            break
        now = now.where("p > 0 AND p < 1").withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        groups, level = -(-groups // FAN), level + 1
    ends = full.select(F.col("rank"), F.col("s").alias("source"), "source_size", "target", F.floor("rate").cast("long").alias("whole"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    out = C.join_hot(decided, ends.join(aims.select("rank", "n"), "rank"), ["rank"], deepest)
    return out.select("doc_id", "key", "nth", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as `mixture` takes it, with the columns of docs."""
    taken = C.checkpoint(mixture(docs, **how).select("doc_id", "key", "copies"))
    same = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "key"
    keys = taken.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"), F.min("copies").alias("least")).where("total > 0")
    # The row travels as one struct: no column of docs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key")).select("row", *same)
    found = C.join_hot(rows, keys, ["no_id", "id", "key"], taken.count())
    alone = found.where("n = 1").select("row", "total")
    # Rows alike in doc_id, source and text: `least` copies of each, and one more for those that come first by the hash of the whole row.
    alike = found.where("n > 1").groupBy("no_id", "id", "key", "n", "total", "least", F.xxhash64("row").alias("hash")).agg(F.count(F.lit(1)).alias("m"), F.first("row").alias("row"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("no_id", "id", "key").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("m"), F.col("total") - F.col("n") * F.col("least") - before))
    shared = alike.select("row", (F.col("m") * F.col("least") + more).alias("total"))
    copies = alone.unionByName(shared).where("total > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
