"""Quality by an n-gram model with interpolated modified Kneser-Ney smoothing.

The model is over the bytes of texts with white space collapsed, of order 5,
trained on trusted texts.  Counting and scoring share one pass over buckets of
documents: a bucket counts the n-grams of its trusted texts and asks for the
distinct n-grams of all its texts, both as sorted shards.  The shards merge the
counts; lower orders (numbers of different left neighbours), discounts, and the
smoothed probabilities are DataFrame joins and aggregations over distinct
n-grams; the probabilities go back to the buckets, which score every document.
Nothing of the model is broadcast or collected but the discounts, three numbers
for each order.

A fifth of the trusted documents, by a hash of doc_id, is held out of training.
A document is kept if its perplexity is not above its language's quantile of the
held-out ones, times a slack; a language without any takes the quantile of all.

Edge cases: null and empty texts (or white space alone) have no perplexity and
are not kept; rows that share a doc_id are scored each; a null doc_id is never
trusted; a null language is one language; labels that share a doc_id are trusted
if one of them is; without trusted texts nothing has a perplexity; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

ORDER = 5
#: Bytes of text whose n-grams are held at once.
PART = 1 << 20
#: Bytes that may follow anything, with equal chances, under the unigrams.
_BYTES = 256


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, one for each byte (the first ones begin with zero bytes), and where each text's end."""
    flat = [b" ".join((t or b"").split()) for t in texts]
    sizes = np.array([len(t) for t in flat], np.int64)
    pad = bytes(ORDER - 1)
    raw = np.frombuffer(b"".join(pad + t for t in flat), np.uint8).astype(np.uint64)
    grams = np.zeros(max(0, len(raw) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        grams = (grams << np.uint64(8)) | raw[j : j + len(grams)]
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return grams[at], np.cumsum(sizes)


def _parts(texts: list[bytes | None]) -> Iterator[slice]:
    """The texts in stretches of about PART bytes, so that a bucket's n-grams aren't all held at once."""
    begin = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t or b"")
        if size >= PART or k == len(texts):
            yield slice(begin, k)
            begin, size = k, 0


def _shards(n: int):
    """N-grams dealt to shards by a hash: an order by (shard, n-gram), and (shard, from, to) in that order."""

    def cut(grams: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        shard = C.bucket_of(grams, n)
        order = np.lexsort((grams, shard))
        first = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(grams) else np.empty(0, np.int64)
        return order, list(zip(shard[order][first].tolist(), first.tolist(), np.r_[first[1:], len(grams)].tolist()))

    return cut


def _count_and_ask(n_shards: int):
    cut = _shards(n_shards)

    def run(packs: pa.Table, trusted: pa.Table) -> pa.Table:
        out = []
        if packs.num_rows:
            bucket = packs.column("bucket")[0].as_py()
            ids, texts = C.unpack(packs.column("pack"))
            good = np.isin(ids, np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in trusted.column("ids").to_pylist())]))
            found = []
            for part in _parts(texts):
                grams, ends = _grams(texts[part])
                own, inverse = np.unique(grams, return_inverse=True)
                found.append((own, np.bincount(inverse, weights=np.repeat(good[part], np.diff(np.r_[0, ends])), minlength=len(own))))
            values, inverse = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([c for _, c in found]), minlength=len(values)).astype(np.uint32)
            order, parts = cut(values)
            values, counts = values[order], counts[order]
            for s, a, b in parts:
                out.append((s, bucket, C.encode_sorted(values[a:b]), C.encode_planes(counts[a:b])))
        return pa.table({"shard": pa.array([r[0] for r in out], pa.int64()), "bucket": pa.array([r[1] for r in out], pa.int64()), "grams": pa.array([r[2] for r in out], pa.binary()), "counts": pa.array([r[3] for r in out], pa.binary())})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The distinct n-grams of a shard, and how often trusted texts hold each."""
    grams = np.concatenate([C.decode_sorted(x) for x in table.column("grams").to_pylist()])
    counts = np.concatenate([C.decode_planes(x, np.uint32) for x in table.column("counts").to_pylist()])
    values, inverse = np.unique(grams, return_inverse=True)
    return pa.table({"gram": pa.array(values.astype(np.int64)), "n": pa.array(np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64))})


def discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 of modified Kneser-Ney from the numbers of n-grams counted once to four times; one row."""
    m = counts.agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"m{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("m1"), F.col("m1") + 2 * F.col("m2"))
    fallback = (0.5, 1.0, 1.5)
    ds = []
    for k in (1, 2, 3):
        d = k - F.try_divide((k + 1) * y * F.col(f"m{k + 1}"), F.col(f"m{k}"))
        ds.append(F.when((F.col("m1") > 0) & (F.col("m2") > 0) & (F.col(f"m{k}") > 0) & (d > 0) & (d <= k), d).otherwise(F.lit(fallback[k - 1])).alias(f"d{k}"))
    return m.select(*ds)


def probabilities(asked: DataFrame) -> DataFrame:
    """(gram, p) for every asked n-gram, from its trusted count n (0: not seen) and those of the others.

    Order k works on k-byte keys; the lower orders count different left
    neighbours.  p_k(w | h) = max(c(hw) - d, 0) / c(h) + gamma(h) p_{k-1}(w | h'),
    and p_k = p_{k-1} where h was never seen.  A history h has at most 256 keys,
    so sums over it are windows of a bounded size.
    """
    tables = {ORDER: asked.select("gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        tables[k] = tables[k + 1].groupBy(shorter).agg(F.count_if(F.col("n") > 0).alias("n"))
    below = None
    for k in range(1, ORDER + 1):
        d = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = tables[k].crossJoin(F.broadcast(discounts(tables[k]))).select("gram", "n", d.alias("d"))
        history = Window.partitionBy(F.shiftrightunsigned("gram", 8))
        rows = rows.select("gram", "n", "d", F.sum("n").over(history).alias("total"), F.sum("d").over(history).alias("held"))
        lower = F.lit(1.0 / _BYTES)
        if below is not None:
            rows = rows.withColumn("s", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "s")
            lower = F.col("q")
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0))
        table = rows.select("gram", F.when(F.col("total") == 0, lower).otherwise((own + F.col("held") * lower) / F.col("total")).alias("p"))
        below = table.select(F.col("gram").alias("s"), F.col("p").alias("q"))
    return table


def _reply(asks: pa.Table, known: pa.Table) -> pa.Table:
    """To each bucket of a shard, the log probabilities of what it asked for, in its order."""
    grams, logs = known.column("gram").to_numpy().astype(np.uint64), np.log(known.column("p").to_numpy()).astype(np.float32)
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    blobs = [C.encode_planes(logs[np.searchsorted(grams, C.decode_sorted(x))]) for x in asks.column("grams").to_pylist()]
    return pa.table({"bucket": asks.column("bucket"), "shard": asks.column("shard"), "grams": asks.column("grams"), "logs": pa.array(blobs, pa.binary())})


def _score(packs: pa.Table, replies: pa.Table) -> pa.Table:
    ids, texts, n, mean = np.empty(0, np.int64), [], [], []
    if packs.num_rows:
        ids, texts = C.unpack(packs.column("pack"))
        known = np.concatenate([np.empty(0, np.uint64), *(C.decode_sorted(x) for x in replies.column("grams").to_pylist())])
        logs = np.concatenate([np.empty(0, np.float32), *(C.decode_planes(x, np.float32) for x in replies.column("logs").to_pylist())])
        order = np.argsort(known)
        known, logs = known[order], logs[order]
        for part in _parts(texts):
            grams, ends = _grams(texts[part])
            sums = np.r_[0.0, np.cumsum(logs[np.searchsorted(known, grams)], dtype=float)] if len(grams) else np.zeros(1)
            begins = np.r_[0, ends[:-1]]
            n += (ends - begins).tolist()
            mean += ((sums[ends] - sums[begins]) / np.maximum(1, ends - begins)).tolist()
    perplexity = [float(np.exp(-m)) if k else None for k, m in zip(n, mean)]
    return pa.table({"doc_id": C.id_column(ids), "key": pa.array([C.xxhash_of(t) for t in texts], pa.int64()), "n_bytes": pa.array(n, pa.int64()), "perplexity": pa.array(perplexity, pa.float64())})


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.1) -> DataFrame:
    """doc_id, lang, trusted, held_out, n_bytes, perplexity (by byte), threshold and keep for each row.

    Trusted are the documents with quality 1 in `labels`.
    """
    spark = docs.sparkSession
    _, n_bytes = C.shape_of(docs)
    buckets, shards = C.bucket_count(spark, n_bytes, 4), max(24, -(-n_bytes // (8 * C.bucket_bytes(n_bytes))))
    packed = C.pack_docs(docs, buckets)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            bucket = C.bucket_of(ids, buckets)
            keys = np.unique(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([ids[bucket == k].tobytes() for k in keys], pa.binary())], ["bucket", "ids"])

    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    trusted = good.where(~held).mapInArrow(gather, "bucket long, ids binary")
    asks = C.checkpoint(packed.groupBy("bucket").cogroup(trusted.groupBy("bucket")).applyInArrow(_count_and_ask(shards), "shard long, bucket long, grams binary, counts binary"))
    grams = C.checkpoint(asks.groupBy("shard").applyInArrow(_merge, "gram long, n long"))
    known = probabilities(grams)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = C.bucket_of(batch.column(0).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", "gram", "p"])

    placed = known.mapInArrow(place, "shard long, gram long, p double")
    replies = asks.select("shard", "bucket", "grams").groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(_reply, "bucket long, shard long, grams binary, logs binary")
    scores = packed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_score, "doc_id long, key long, n_bytes long, perplexity double")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), C.text_key().alias("key"))
    scored = scores.groupBy("doc_id", "key").agg(F.first("n_bytes").alias("n_bytes"), F.first("perplexity").alias("perplexity"))
    rows = plain.join(scored.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "n_bytes", "perplexity"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    marked = C.checkpoint(rows.join(good.select(F.col("doc_id").alias("g")), F.col("doc_id") == F.col("g"), "left").select("doc_id", "lang", F.col("g").isNotNull().alias("trusted"), (F.col("g").isNotNull() & held).alias("held_out"), "n_bytes", "perplexity"))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    limits = marked.where("held_out AND perplexity IS NOT NULL").groupBy("lang").agg(at.alias("own"))
    whole = marked.where("held_out AND perplexity IS NOT NULL").agg(at.alias("whole"))
    joined = marked.join(limits.select(F.col("lang").alias("l"), "own"), F.col("lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(whole)).withColumn("threshold", slack * F.coalesce("own", "whole"))
    return joined.select("doc_id", "lang", "trusted", "held_out", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))
