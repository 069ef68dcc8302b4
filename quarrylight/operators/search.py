"""Ranked full-text search over chunks: an inverted index as tables, and queries as joins.

What must match and what only ranks are apart: the must part picks chunks (a
share of the query's lemmas, or every quoted phrase), other clauses only add to
the score.  Fields score as one text: of each term the best field counts, with
the document frequency of the field that has it most often.  The category filter
stands above the facets, so facet counts don't see it.  One chunk for each URL
is shown; totals count URLs.

Each field is indexed twice, as exact terms and as lemmas.  A posting holds what
a query needs (positions, the field's length), statistics are one row for each
field, so a query reads the postings of its own terms and nothing that grows with
the corpus: no text, no table of lengths.  Phrases and excluded words are settled
by positions.

A query is small, so its terms are literals in the plan: the scan of postings is
pruned by them, and all that is shuffled are the postings of those terms.  Of an
index that isn't published a query makes the postings of its own terms alone,
once for all its clauses, in one pass over the texts that also counts the
statistics (`asked`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.analysis import RUSSIAN_STOP, exact_terms, lemma, number_terms
from quarrylight.functions.repair import document_number, looks_like_number
from quarrylight.functions.text import text_or_empty

from .checkpoints import checkpoint

#: Weights and length normalisation (b of BM25) of the fields that a query searches.
FIELDS = {"title": (4.0, 0.75), "attachment_title": (3.0, 0.75), "text": (1.0, 0.4), "section": (0.5, 0.75), "document_kind": (2.0, 0.75)}
FUZZY_FIELDS = ("title", "attachment_title", "text")
#: Phrase clauses that only rank: analyzer, field, weight, slop.
PHRASES = (("exact", "title", 12.0, 1), ("exact", "attachment_title", 10.0, 1), ("exact", "text", 6.0, 2), ("lemma", "text", 3.0, 3))
#: Where a quoted phrase may stand: analyzer, field.
QUOTED = (("exact", "text"), ("lemma", "text"), ("exact", "title"), ("exact", "attachment_title"))
ALL_IN_TITLE, BESIDE_PHRASE = 4.0, 2.0
NUMBER_SCORES = (40.0, 32.0, 24.0)
K1 = 1.2
CATEGORIES = ("news", "legal", "announcement", "media", "file")
DOC_TYPES = ("page", "pdf", "file")
# What a quoted phrase and a word with a minus are.
_PHRASE = re.compile(r"[«\"“]([^«»\"“”]{2,120})[»\"”]")
_MINUS = re.compile(r"(?:^|\s)[-−–—]([^\s\"«»]{2,60})")


@dataclass(frozen=True)
class Query:
    text: str
    phrases: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def parse(raw: str | None) -> Query:
    """Quoted phrases, words with a minus before them, and the rest."""
    rest, found = (raw or "").strip(), {"phrase": [], "minus": []}
    for name, pattern in (("phrase", _PHRASE), ("minus", _MINUS)):
        found[name] = [m.strip() for m in pattern.findall(rest) if m.strip()]
        rest = pattern.sub(" ", rest)
    return Query(re.sub(r"\s+", " ", rest).strip(), tuple(dict.fromkeys(found["phrase"])), tuple(dict.fromkeys(found["minus"])))


def places_of(text: str, kind: str = "exact") -> list[tuple[str, int]]:
    """The query's terms by the index's analyzer, each with its place; a stop word leaves a gap."""
    folded = text.translate(str.maketrans("ёЁ", "еЕ")).lower()
    words = re.findall(r"\w+", folded)
    return [(t, k) for k, w in enumerate(words) if (t := lemma(w) if kind == "lemma" else w)]


def terms_of(text: str, kind: str = "exact") -> list[str]:
    """The query's terms, each once."""
    return list(dict.fromkeys(t for t, _ in places_of(text, kind)))


def needed(n: int, most_all: int = 3, share: float = 0.75) -> int:
    """Up to three terms all must match, of more three quarters, rounded down."""
    return n if n <= most_all else int(share * n)


@dataclass
class Index:
    """chunks: chunk_id, url, the fields and filters; postings: kind, field, term, chunk_id, tf, len, positions; stats: kind, field, n, mean.

    tokens: chunk_id and each field's exact terms, where postings are yet to be made of them.
    """

    chunks: DataFrame
    postings: DataFrame
    stats: DataFrame
    fields: list[str] = field(default_factory=list)
    tokens: DataFrame | None = None


_COLUMNS = ["kind", "field", "term", "chunk_id", "tf", "len", "positions"]


def _grouped(ids: pa.Array, rows: np.ndarray, places: np.ndarray, codes: np.ndarray, words: pa.Array, sizes: np.ndarray, kind: str, name: str) -> pa.RecordBatch:
    """Postings of the tokens of some chunks: a row for each chunk and term."""
    order = np.lexsort((places, codes, rows))
    r, c = rows[order], codes[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])]) if len(r) else np.empty(0, np.int64)
    ends = np.r_[first, len(r)].astype(np.int32)
    constant = lambda v: pa.array([v] * len(first), pa.string())
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(places[order].astype(np.int32)))
    columns = [constant(kind), constant(name), words.take(pa.array(c[first])).cast(pa.string()), ids.take(pa.array(r[first])), pa.array(np.diff(ends).astype(np.int64)), pa.array(sizes[r[first]].astype(np.int64)), positions]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def _postings(fields: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0)
                for k, name in enumerate(fields, 1):
                    lists = part.column(k)
                    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    coded = lists.flatten().dictionary_encode()
                    rows = np.repeat(np.arange(len(sizes)), sizes)
                    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    codes = coded.indices.to_numpy()
                    yield _grouped(ids, rows, places, codes, coded.dictionary, sizes, "exact", name)
                    lemmas = pa.array([lemma(t) for t in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
                    codes = lemmas.indices.fill_null(-1).to_numpy()[codes] if len(codes) else codes
                    kept = codes >= 0
                    yield _grouped(ids, rows[kept], places[kept], codes[kept], lemmas.dictionary, np.bincount(rows[kept], minlength=len(sizes)), "lemma", name)

    return run


def build_index(chunks: DataFrame) -> Index:
    """Both analyzers over each field of chunks; a chunk's postings are made where the chunk is, without a shuffle."""
    fields = [f for f in FIELDS if f in chunks.columns]
    if "document_number" in chunks.columns and "document_number_normalized" not in chunks.columns:
        chunks = chunks.withColumn("document_number_normalized", document_number(F.col("document_number")))
    key = chunks.schema["chunk_id"].dataType.simpleString()
    tokens = chunks.select("chunk_id", *[exact_terms(F.col(f)).alias(f) for f in fields])
    postings = tokens.mapInArrow(_postings(fields), f"kind string, field string, term string, chunk_id {key}, tf long, len long, positions array<int>")
    return Index(chunks, postings, _stats(chunks, fields), fields, tokens)


def _asked(fields: list[str], wanted: dict[str, list[str]], starts: dict[str, set[str]]):
    """Like `_postings`, of some terms alone; rows without a term tell how many chunks were read (tf), their terms (len) and how many chunks have any (positions)."""
    firsts = {kind: starts.get(kind, set()) | {t[:1] for t in wanted.get(kind, ())} for kind in ("exact", "lemma")}
    stop = pa.array(sorted(RUSSIAN_STOP), pa.string())

    def words_of(distinct: pa.Array, kind: str) -> pa.Array:
        """The distinct terms as the analyzer has them, null where not asked for; a lemma begins like its term, so only such terms are stemmed."""
        first = pc.utf8_slice_codeunits(distinct, 0, 1)
        near = pa.array([f for f in first.unique().to_pylist() if f in firsts[kind] or f.lower()[:1] in firsts[kind]], pa.string())
        words = pc.if_else(pc.is_in(first, near), distinct, pa.scalar(None, pa.string()))
        if kind == "lemma":
            words = pa.array([None if w is None else lemma(w) for w in words.to_pylist()], pa.string())
        asked = pc.is_in(words, pa.array(wanted.get(kind, ()), pa.string()))
        if starts.get(kind):
            asked = pc.or_(asked, pc.is_in(pc.utf8_slice_codeunits(words, 0, 1), pa.array(sorted(starts[kind]), pa.string())))
        return pc.if_else(asked, words, pa.scalar(None, pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0)
                for k, name in enumerate(fields, 1):
                    lists = part.column(k)
                    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                    coded = lists.flatten().cast(pa.string()).dictionary_encode()
                    rows = np.repeat(np.arange(len(sizes)), sizes)
                    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    codes = coded.indices.to_numpy()
                    stopped = pc.is_in(coded.dictionary, stop).to_numpy(zero_copy_only=False)[codes]
                    for kind in wanted | starts:
                        own = sizes if kind == "exact" else np.bincount(rows[~stopped], minlength=len(sizes)).astype(np.int64)
                        words = words_of(coded.dictionary, kind).dictionary_encode()
                        new = words.indices.fill_null(-1).to_numpy()[codes]
                        kept = new >= 0
                        yield _grouped(ids, rows[kept], places[kept], new[kept], words.dictionary, own, kind, name)
                        told = [[kind], [name], [None], [None], [len(own)], [int(own.sum())], [[int((own > 0).sum())]]]
                        types = [pa.string(), pa.string(), pa.string(), ids.type, pa.int64(), pa.int64(), pa.list_(pa.int32())]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(told, types)], _COLUMNS)

    return run


def asked(index: Index, wanted: dict[str, Iterable[str]], fields: Iterable[str] | None = None, starts: dict[str, set[str]] | None = None) -> Index:
    """The index for a query that asks for some terms of each kind, or for all that begin with some letters.

    A published index stays as it is, its scans are pruned.  Else the postings
    of those terms are made once, with the statistics, and written to the shared
    folder: clauses read them there.
    """
    if index.tokens is None:
        return index
    use = [f for f in index.fields if fields is None or f in fields]
    terms = {kind: sorted(set(ts)) for kind, ts in wanted.items()}
    made = checkpoint(index.tokens.select("chunk_id", *use).mapInArrow(_asked(use, terms, starts or {}), index.postings.schema))
    told = made.where("term IS NULL").groupBy("kind", "field").agg(F.sum("tf").alias("n"), F.sum("len").alias("all"), F.sum(F.get("positions", F.lit(0)).cast("long")).alias("some"))
    stats = told.select("kind", "field", "n", (F.col("all").cast("double") / F.nullif("some", F.lit(0))).alias("mean"))
    return Index(index.chunks, made.where("term IS NOT NULL"), stats, index.fields)


def _stats(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """kind, field, n (chunks), mean (length of a field where it has terms): one scan, a row for each field and analyzer."""
    means = []
    for f in fields:
        words = exact_terms(F.col(f))
        for kind, terms in (("exact", words), ("lemma", F.filter(words, lambda t: ~t.isin(*RUSSIAN_STOP)))):
            means.append(F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), F.avg(F.nullif(F.size(terms), F.lit(0))).alias("mean")))
    whole = chunks.agg(F.count(F.lit(1)).alias("n"), F.array(*means).alias("m"))
    return whole.select("n", F.explode("m").alias("m")).select("m.kind", "m.field", "n", "m.mean")


def _idf(df: Column) -> Column:
    return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, b: Column | float) -> Column:
    return tf / (tf + K1 * (1 - b + b * F.col("len") / F.col("mean")))


def term_scores(index: Index, terms: list[str], fields: tuple[str, ...] | None = None, kind: str = "exact") -> DataFrame:
    """chunk_id, term, score: the best field's BM25 for each term, with the terms' largest document frequency."""
    use = [f for f in index.fields if fields is None or f in fields]
    index = asked(index, {kind: terms}, use)
    hits = index.postings.where((F.col("kind") == kind) & F.col("term").isin(*terms) & F.col("field").isin(*use))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).groupBy("term").agg(F.max("df").alias("df"))
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, (w, _) in FIELDS.items()])
    b = F.coalesce(*[F.when(F.col("field") == f, F.lit(b)) for f, (_, b) in FIELDS.items()])
    joined = hits.join(F.broadcast(df), "term").join(F.broadcast(index.stats.where(F.col("kind") == kind).drop("kind")), "field")
    return joined.groupBy("chunk_id", "term").agg(F.max(boost * _idf(F.col("df")) * _saturated(F.col("tf"), b)).alias("score"))


def match_terms(index: Index, text: str, fields: tuple[str, ...] | None = None, least: int | None = None, kind: str = "lemma") -> DataFrame:
    """chunk_id, score of chunks that have enough of the text's terms in any of the fields; none if no term is left of it."""
    terms = terms_of(text, kind)
    least = max(1, needed(len(terms)) if least is None else least)
    found = term_scores(index, terms, fields, kind).groupBy("chunk_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).select("chunk_id", "score")


def _stretches(places: list[tuple[int, int]], slop: int):
    """Rows of chunk_id, len and a column of sorted positions for each term to chunk_id, len, tf: what the phrase counts in the chunk.

    All rows of a batch stand on one line, each 2^32 places long, so the next
    place of a term is one search for the whole batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lines = np.arange(1, batch.num_rows + 1) << 32, []
            for k, shift in places:
                lists = batch.column(2 + k)
                sizes = np.diff(lists.offsets.to_numpy())
                lines.append(np.repeat(np.arange(batch.num_rows), sizes).astype(np.int64) * (1 << 32) + lists.flatten().to_numpy().astype(np.int64) + (1 << 31) - shift)
            starts = np.unique(np.concatenate(lines))
            rows = starts >> 32
            last = starts
            for line in lines:
                nexts = np.r_[line, np.int64(2**62)][np.searchsorted(line, starts)]
                last = np.maximum(last, np.where(nexts < ends[rows], nexts, np.int64(2**62)))
            wide = last - starts
            kept = wide <= slop
            tf = np.bincount(rows[kept], 1.0 / (1.0 + wide[kept]), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tf.astype(float))], ["chunk_id", "len", "tf"])

    return run


def phrase_scores(index: Index, phrase: str, name: str, kind: str = "exact", slop: int = 0) -> DataFrame | None:
    """chunk_id, score of chunks whose field has the phrase; None for a phrase without terms.

    `slop` is one budget for the whole phrase: the terms' places, less their
    places in the phrase, lie within it.  Each such stretch counts 1 / (1 + its
    width), and the sum scores like a term that has the idf of all of them.
    """
    places = places_of(phrase, kind)
    if not places or name not in index.fields:
        return None
    terms = list(dict.fromkeys(t for t, _ in places))
    index = asked(index, {kind: terms}, (name,))
    hits = index.postings.where((F.col("kind") == kind) & (F.col("field") == name) & F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index.stats.where((F.col("kind") == kind) & (F.col("field") == name)).select("n", "mean")
    idf = df.crossJoin(F.broadcast(stats)).agg(F.sum(_idf(F.col("df"))).alias("idf"), F.first("n").alias("n"), F.first("mean").alias("mean"))
    whole = hits.groupBy("chunk_id").agg(F.first("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).where(F.size("at") == len(terms))
    moved = whole.select("chunk_id", "len", *[F.element_at("at", t).alias(f"p{k}") for k, t in enumerate(terms)])
    found = moved.mapInArrow(_stretches([(terms.index(t), k) for t, k in places], slop), T.StructType([*moved.schema.fields[:2], T.StructField("tf", T.DoubleType())])).where("tf > 0")
    return found.crossJoin(F.broadcast(idf)).select("chunk_id", (F.col("idf") * _saturated(F.col("tf"), FIELDS[name][1])).alias("score"))


def _sum(parts: list[DataFrame]) -> DataFrame:
    """chunk_id, score: the sum of a chunk's scores."""
    return reduce(DataFrame.unionByName, parts).groupBy("chunk_id").agg(F.sum("score").alias("score"))


def quoted(index: Index, phrase: str) -> DataFrame | None:
    """chunk_id, score of chunks that have a quoted phrase in one of its fields; None for a phrase without terms."""
    index = asked(index, {kind: terms_of(phrase, kind) for kind in ("exact", "lemma")}, [name for _, name in QUOTED])
    parts = [p for kind, name in QUOTED if (p := phrase_scores(index, phrase, name, kind)) is not None]
    return _sum(parts) if parts else None


def has_phrase(c: Column, phrase: str) -> Column:
    """Do the phrase's exact terms stand in the column one after another?  For filters over texts without an index."""
    terms = [re.escape(t) for t in terms_in_order(phrase)]
    return F.rlike(F.concat(F.lit(" "), F.array_join(exact_terms(c), " "), F.lit(" ")), F.lit(" " + " ".join(terms) + " ")) if terms else F.lit(False)


def terms_in_order(text: str) -> list[str]:
    return [t for t, _ in places_of(text)]


def number_clauses(value: str) -> tuple[Column, Column, Column]:
    """The canonical number, the number as stored, or all of its parts."""
    want = document_number(F.lit(value))
    parts = number_terms(F.replace(want, F.lit("-"), F.lit("")))
    own = number_terms(F.col("document_number"))
    return F.col("document_number_normalized") == want, F.lower(F.trim(text_or_empty(F.col("document_number")))) == want, (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(own, p))


def number_matches(value: str) -> Column:
    canonical, stored, parts = number_clauses(value)
    return canonical | stored | parts


def add_number_scores(chunks: DataFrame, raw: str) -> DataFrame:
    """A query that looks like an act number ranks chunks that have it: constant scores for each clause."""
    if "document_number" not in chunks.columns:
        return chunks
    asked = looks_like_number(F.lit(raw)) & (document_number(F.lit(raw)) != "")
    more = [F.when(asked & c, w).otherwise(0.0) for c, w in zip(number_clauses(raw), NUMBER_SCORES)]
    return chunks.withColumn("score", F.col("score") + more[0] + more[1] + more[2])


def filters(chunks: DataFrame, *, number: str | None = None, kind: str | None = None, date_from: str | None = None, date_to: str | None = None, doc_type: str | None = None, attachment: bool | None = None) -> DataFrame:
    """Predicates that don't score; a date bound never matches a null date.  A number without letters or digits filters nothing."""
    if number and re.search(r"\w", number):
        chunks = chunks.where(number_matches(number))
    if kind:
        chunks = chunks.where(F.lower(F.trim("document_kind")) == kind.strip().lower())
    if date_from:
        chunks = chunks.where(F.col("sort_date") >= date_from)
    if date_to:
        chunks = chunks.where(F.col("sort_date") <= date_to)
    if doc_type:
        chunks = chunks.where(F.col("doc_type") == doc_type)
    return chunks if attachment is None else chunks.where(F.col("is_attachment") == attachment)


def _scored(must: list[DataFrame], should: list[DataFrame]) -> DataFrame:
    """chunk_id, score of the chunks that are in all of `must`: the sum of all scores."""
    out = must[0]
    for part, how in [*((m, "inner") for m in must[1:]), *((s, "left") for s in should)]:
        out = out.join(part.withColumnRenamed("score", "_more"), "chunk_id", how).withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop("_more")
    return out


def run_query(index: Index, raw: str, keep: bool = False, **how) -> DataFrame:
    """The matching chunks with their scores; an empty query matches all.  keep: scores are settled now, for a result that is read more than once."""
    q, chunks = parse(raw), filters(index.chunks, **how)
    if not (q.text or q.phrases or q.excluded):
        return chunks.withColumn("score", F.lit(0.0))
    said = (*q.phrases, *q.excluded, *([q.text] if q.text else []))
    index = asked(index, {kind: [t for s in said for t in terms_of(s, kind)] for kind in ("exact", "lemma")})
    must = [p for phrase in q.phrases if (p := quoted(index, phrase)) is not None]
    if len(must) < len(q.phrases):  # a phrase of marks alone stands nowhere
        return chunks.where("false").withColumn("score", F.lit(0.0))
    should: list[DataFrame] = []
    if q.text and q.phrases:  # free words beside a phrase only rank
        should.append(match_terms(index, q.text, least=1).withColumn("score", BESIDE_PHRASE * F.col("score")))
    elif q.text:
        must.append(match_terms(index, q.text))
        if not q.excluded:
            ranked = [(phrase_scores(index, q.text, name, kind, slop), boost) for kind, name, boost, slop in PHRASES]
            parts = [p.withColumn("score", boost * F.col("score")) for p, boost in ranked if p is not None]
            if terms_of(q.text, "lemma") and "title" in index.fields:
                weight = ALL_IN_TITLE / FIELDS["title"][0]  # the clause's weight stands for the field's
                parts.append(match_terms(index, q.text, ("title",), len(terms_of(q.text, "lemma"))).withColumn("score", weight * F.col("score")))
            should += [_sum(parts)] if parts else []
    out = [match_terms(index, word, FUZZY_FIELDS, len(terms_of(word, "lemma"))).select("chunk_id") for word in q.excluded if terms_of(word, "lemma")]
    found = _scored(must, should) if must else None
    for chunk_ids in out:
        if found is None:
            chunks = chunks.join(chunk_ids, "chunk_id", "left_anti")
        else:
            found = found.join(chunk_ids, "chunk_id", "left_anti")
    if found is None:
        return add_number_scores(chunks.withColumn("score", F.lit(0.0)), raw)
    return add_number_scores(chunks.join(checkpoint(found) if keep else found, "chunk_id"), raw)


def near_words(postings: DataFrame, term: str, most: int = 24) -> DataFrame:
    """Terms of the index within the edits that the term's length allows, with the same first letter; a swap is one edit."""
    edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    t = F.col("term")
    words = postings.where(F.startswith(t, F.lit(term[:1])) & F.length(t).between(len(term) - edits, len(term) + edits)).groupBy("term").agg(F.countDistinct("chunk_id").alias("df"))
    swaps = [term[:k] + term[k + 1] + term[k] + term[k + 2 :] for k in range(1, len(term) - 1)] if edits else []
    away = F.when(t.isin(*swaps), F.least(F.lit(1), F.levenshtein(t, F.lit(term)))).otherwise(F.levenshtein(t, F.lit(term))) if swaps else F.levenshtein(t, F.lit(term))
    return words.withColumn("edits", away).where(F.col("edits") <= edits).orderBy("edits", F.desc("df"), "term").limit(most)


def fuzzy_query(index: Index, raw: str, most: int = 24, **how) -> DataFrame:
    """Chunks with words near to 65 % of the query's lemmas; quotes and minus signs are plain text here."""
    terms, hits = terms_of(raw, "lemma"), None
    index = asked(index, {}, FUZZY_FIELDS, {"lemma": {t[:1] for t in terms}}) if terms else index
    postings = index.postings.where((F.col("kind") == "lemma") & F.col("field").isin(*FUZZY_FIELDS))
    for t in terms:
        near = near_words(postings, t, most).select("term", F.lit(t).alias("asked"), (1.0 / (1 + F.col("edits"))).alias("weight"))
        part = postings.join(F.broadcast(near), "term").groupBy("chunk_id", "asked").agg(F.max("weight").alias("score"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return filters(index.chunks, **how).where("false").withColumn("score", F.lit(0.0))
    found = hits.groupBy("chunk_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, int(0.65 * len(terms))))
    return filters(index.chunks, **how).join(found.drop("n"), "chunk_id")


def collapse(hits: DataFrame) -> DataFrame:
    """The best chunk of each URL; ties go to the earlier chunk."""
    order = Window.partitionBy("row.url").orderBy(F.desc("row.score"), "row.chunk_number" if "chunk_number" in hits.columns else "row.chunk_id")
    whole = hits.select(F.struct(*hits.columns).alias("row"))
    return whole.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def facets(hits: DataFrame, selected: str | None = None, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """category, n (URLs), selected: the fixed categories and `all`, before the category filter."""
    counts = hits.groupBy("content_category").agg(F.countDistinct("url").alias("n"))
    everything = hits.agg(F.countDistinct("url").alias("n")).select(F.lit("all").alias("content_category"), "n")
    fixed = hits.sparkSession.createDataFrame([(c,) for c in ("all", *categories)], "category string")
    return fixed.join(counts.unionByName(everything), F.col("category") == F.col("content_category"), "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), (F.col("category") == (selected or "all")).alias("selected"))


def page(hits: DataFrame, sort: str = "relevance", limit: int = 10, offset: int = 0, has_query: bool = True) -> DataFrame:
    """One page; null dates come last either way, equal rows by URL."""
    dates = {"date_desc": [F.desc_nulls_last("sort_date")], "date_asc": [F.asc_nulls_last("sort_date")]}.get(sort, [] if has_query else [F.desc_nulls_last("sort_date")])
    return hits.orderBy(*dates, F.desc("score"), "url").offset(offset).limit(limit)


@dataclass
class Result:
    items: DataFrame
    facets: DataFrame
    total: DataFrame
    mode: str


def search(index: Index, raw: str = "", *, category: str | None = None, sort: str = "relevance", limit: int = 10, offset: int = 0, categories: tuple[str, ...] = CATEGORIES, **how) -> Result:
    """The whole search; a query that finds nothing on the first page is tried again with near words."""
    check_options(raw, sort=sort, limit=limit, offset=offset, category=category, categories=categories, **how)
    hits, mode = run_query(index, raw, keep=True, **how), "exact"
    if offset == 0 and terms_of(raw, "lemma") and hits.isEmpty():
        hits, mode = fuzzy_query(index, raw, **how), "fuzzy"
    shown = hits.where(F.col("content_category") == category.strip().lower()) if category else hits
    total = shown.agg(F.countDistinct("url").alias("total"), F.least(F.count(F.lit(1)), F.lit(10_000)).alias("hits"))
    return Result(_whole(index, page(collapse(_keys(shown)), sort, limit, offset, bool(raw.strip())), shown, sort, limit, bool(raw.strip())), facets(hits, category, categories), total, mode)


def _keys(hits: DataFrame) -> DataFrame:
    """What a page is picked and ordered by."""
    return hits.select(*[c for c in ("chunk_id", "chunk_number", "url", "sort_date", "score") if c in hits.columns])


def _whole(index: Index, top: DataFrame, shown: DataFrame, sort: str, limit: int, has_query: bool) -> DataFrame:
    """The rows of a page, with all that the chunks know: only they carry texts."""
    mine = top.select(F.col("chunk_id").alias("_id"), F.col("url").alias("_url"), "score")
    rows = index.chunks.join(F.broadcast(mine), (F.col("chunk_id") == F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))).select(*shown.columns)
    return page(collapse(rows), sort, limit, 0, has_query)


def check_options(raw: str, *, sort: str = "relevance", limit: int = 10, offset: int = 0, category: str | None = None, date_from: str | None = None, date_to: str | None = None, categories: tuple[str, ...] = CATEGORIES, **rest) -> None:
    """Raise ValueError for what the search interface refuses."""
    if len((raw or "").strip()) == 1 or len(raw or "") > 300:
        raise ValueError("a query has 2 to 300 characters")
    if not ((raw or "").strip() or category or date_from or date_to or any(v is not None for v in rest.values())):
        raise ValueError("at least one condition")
    if sort not in ("relevance", "date_desc", "date_asc"):
        raise ValueError(f"no such order: {sort}")
    if not 1 <= limit <= 50 or not 0 <= offset <= 9000:
        raise ValueError("limit is 1 to 50, offset 0 to 9000")
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    if category is not None and category.strip().lower() not in categories:
        raise ValueError(f"no such category: {category}")
    if rest.get("doc_type") is not None and rest["doc_type"] not in DOC_TYPES:
        raise ValueError(f"no such type: {rest['doc_type']}")
    for name, most in (("number", 100), ("kind", 100)):
        if len(rest.get(name) or "") > most:
            raise ValueError(f"{name} has at most {most} characters")


def publish(index: Index, folder: str, version: str) -> None:
    """Write an index under a version and make it current.

    Postings are dealt to ranges of (kind, term, chunk_id) and sorted in them: a
    query's scan is pruned by term, and the postings of a very common word are in
    many files.  The pointer is a table that only grows: its last row is current,
    and going back is one more row.
    """
    order = ["kind", "term", "chunk_id"]
    index.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{version}/postings")
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version}/stats")
    index.chunks.write.mode("overwrite").parquet(f"{folder}/{version}/chunks")
    point_to(index.chunks.sparkSession, folder, version)


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    rows = spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def current(spark: SparkSession, folder: str) -> Index:
    version = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "at")).first()[0]
    part = lambda name: spark.read.parquet(f"{folder}/{version}/{name}")
    chunks = part("chunks")
    return Index(chunks, part("postings"), part("stats"), [f for f in FIELDS if f in chunks.columns])
