"""Catalogue queries over the full-text operators, on whole `documents` and `pages`, with their oracle SQL.

Documents stand in for chunks: the language is the category, ten documents of a
source share a URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import analysis, readability, text
from quarrylight.operators import search as S


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://h/"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 10).cast("string"))
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    return _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), url.alias("url"), title.alias("title"), "text", F.col("lang").alias("content_category"), F.col("n_chars"))


TERMS = ("the", "thorn", "erhe", "queeau")
_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents"
_BM25 = f"""
WITH tok AS ({_TOKENS}),
len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, avg(dl) AS mean FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'thorn', 'erhe', 'queeau') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.6 + 0.4 * dl / mean))) AS score, count(*) AS n_terms FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1)
"""


def _bm25(spark: SparkSession, d: str, terms: tuple[str, ...] = TERMS) -> DataFrame:
    index = S.build_index(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    return S.term_scores(index, list(terms)).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("n_terms"))


#: Four terms that many documents have, so that the share of them that must match decides.
COMMON = ("the", "of", "and", "to")


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(10)


def q_msm(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, COMMON).where(F.col("n_terms") >= S.needed(len(COMMON))).select("doc_id", "score", "n_terms")


def q_crossfields(spark: SparkSession, d: str) -> DataFrame:
    found = S.match_terms(S.build_index(chunks(spark, d).select("chunk_id", "title", "text")), "the of thorn erhe", least=2, kind="exact")
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


_CROSS = """
WITH f AS (SELECT doc_id, 'title' AS field, regexp_extract(text, '^([^.\\n]*)', 1) AS t FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents),
tok AS (SELECT doc_id, field, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')) AS term FROM f),
len AS (SELECT doc_id, field, count(*) AS dl FROM tok GROUP BY ALL), mean AS (SELECT field, avg(dl) AS mean FROM len GROUP BY 1),
tf AS (SELECT doc_id, field, term, count(*) AS tf FROM tok WHERE term IN ('the', 'of', 'thorn', 'erhe') GROUP BY ALL),
df AS (SELECT term, max(df) AS df FROM (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL) GROUP BY 1),
w AS (SELECT 'title' AS field, 4.0 AS boost, 0.75 AS b UNION ALL SELECT 'text', 1.0, 0.4),
s AS (SELECT doc_id, term, max(boost * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - b + b * dl / mean))) AS s FROM tf JOIN df USING (term) JOIN len USING (doc_id, field) JOIN mean USING (field) JOIN w USING (field) GROUP BY ALL)
SELECT doc_id, round(sum(s), 6) AS score FROM s GROUP BY 1 HAVING count(*) >= 2
"""


def _texts(spark: SparkSession, d: str) -> S.Index:
    return S.build_index(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))


def q_phrase(spark: SparkSession, d: str) -> DataFrame:
    found = S.phrase_scores(_texts(spark, d), "of the the", "text")
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def q_phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return S.phrase_scores(_texts(spark, d), "the and of", "text", slop=2).select(F.col("chunk_id").alias("doc_id"))


def q_phrase_lemma(spark: SparkSession, d: str) -> DataFrame:
    return S.phrase_scores(_texts(spark, d), "thing the", "text", "lemma").select(F.col("chunk_id").alias("doc_id"))


def q_lemma(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct term and what the lemma analyzer makes of it."""
    words = _docs(spark, d).select(F.explode(analysis.exact_terms(F.col("text"))).alias("term")).distinct()
    return words.select("term", analysis.stem("term").alias("lemma"))


def q_minus(spark: SparkSession, d: str) -> DataFrame:
    index = S.build_index(chunks(spark, d).select("chunk_id", "text"))
    return S.run_query(index, "and -the").select(F.col("chunk_id").alias("doc_id"))


def q_phrase_or(spark: SparkSession, d: str) -> DataFrame:
    index = S.build_index(chunks(spark, d).select("chunk_id", "title", "text"))
    return S.run_query(index, '"of the"').select(F.col("chunk_id").alias("doc_id"))


def q_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    index = S.build_index(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    return S.near_words(index.postings.where("kind = 'exact'"), "thron").select("term", F.col("df").cast("long").alias("df"), F.col("edits").cast("long").alias("edits"))


def q_facets(spark: SparkSession, d: str) -> DataFrame:
    found = S.facets(chunks(spark, d), "fr", ("en", "fr", "xx"))
    return found.select("category", F.col("n").cast("long").alias("n"), "selected")


def q_postfilter(spark: SparkSession, d: str) -> DataFrame:
    hits = chunks(spark, d).where(S.has_phrase(F.col("text"), "of"))
    counts = S.facets(hits, "en", ("en", "de"))
    shown = hits.where("content_category = 'en'").agg(F.countDistinct("url").alias("shown"))
    return counts.crossJoin(F.broadcast(shown)).select("category", F.col("n").cast("long").alias("n"), F.col("shown").cast("long").alias("shown"))


def q_total(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("content_category = 'en'").agg(F.countDistinct("url").alias("total"), F.least(F.count(F.lit(1)), F.lit(10_000)).cast("long").alias("hits"))


def q_collapse(spark: SparkSession, d: str) -> DataFrame:
    hits = chunks(spark, d).withColumn("score", F.col("n_chars").cast("double"))
    return S.collapse(hits).select("url", "chunk_id", "score")


def q_collapse_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("chunk_number"), F.col("l_extendedprice").alias("score"))
    return S.collapse(lines)


def q_sort_date(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    hits = orders.select(F.col("o_orderkey").cast("string").alias("url"), F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("sort_date"), F.col("o_totalprice").alias("score"))
    rows = S.page(hits, "date_asc", limit=50, offset=100)
    return rows.select("url", F.col("sort_date").cast("string").alias("sort_date"), "score")


def q_filters(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    hits = orders.select("o_orderkey", F.col("o_orderstatus").alias("doc_type"), F.col("o_orderpriority").alias("document_kind"), F.to_date("o_orderdate").alias("sort_date"), (F.col("o_custkey") % 2 == 0).alias("is_attachment"))
    return S.filters(hits, kind=" 1-URGENT ", date_from="1996-01-01", date_to="1996-12-31", doc_type="O", attachment=True).select("o_orderkey")


SEARCHED = "the thing of"
#: The categories of the stand-in chunks.
LANGUAGES = ("en", "de", "fr", "es")


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search, lemmas, phrase clauses and all, with facets above the filter; rows of the first page."""
    index = S.build_index(chunks(spark, d))
    return S.search(index, SEARCHED, category="en", categories=LANGUAGES).items.select("url", "chunk_id", F.round("score", 6).alias("score"))


def q_search_facets(spark: SparkSession, d: str) -> DataFrame:
    """What the same search says beside its page: the facets, which don't see the category, and the total, which does."""
    found = S.search(S.build_index(chunks(spark, d)), SEARCHED, category="en", categories=LANGUAGES)
    return found.facets.crossJoin(F.broadcast(found.total)).select("category", F.col("n").cast("long").alias("n"), "selected", F.col("total").cast("long").alias("total"), F.col("hits").cast("long").alias("hits"))


def q_fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    """A misspelt query, with the words near to its terms; all of them, so that the oracle need not break ties."""
    found = S.fuzzy_query(_texts(spark, d), "thron", most=1_000_000)
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def q_compact(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.compact(F.col("text")).alias("compact"))


def q_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(text.normalize_lines(F.col("text")), 256).alias("lines"))


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(analysis.exact_terms(F.col("text"))).cast("long").alias("n"), F.sha2(F.array_join(analysis.exact_terms(F.col("text")), " "), 256).alias("terms"))


def q_stop(spark: SparkSession, d: str) -> DataFrame:
    left = analysis.without(analysis.exact_terms(F.col("text")), ("the", "of", "and"))
    return _docs(spark, d).select("doc_id", F.size(left).cast("long").alias("n"))


def q_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.truncate(F.col("text"), 180).alias("short"))


def q_quality(spark: SparkSession, d: str) -> DataFrame:
    r = readability.readability(_docs(spark, d))
    return r.select("doc_id", F.col("score").cast("long").alias("score"), "reason")


def q_garbled(spark: SparkSession, d: str) -> DataFrame:
    return readability.garbled(_docs(spark, d)).groupBy("lang", "garbled").agg(F.count(F.lit(1)).alias("n"))


_ENGLISH = ", ".join(f"'{w}'" for w in readability.ENGLISH)
_RUSSIAN = ", ".join(f"'{w}'" for w in readability.RUSSIAN)
_QUALITY = f"""
WITH c AS (SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-zА-Яа-яЁё]{{2,}}') AS w, length(t) AS chars, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\\p{{Nd}}', '', 'g')) AS digits FROM c),
m AS (SELECT *, len(w) AS n,
  CASE WHEN letters > 0 THEN (length(t) - length(regexp_replace(t, '[А-Яа-яЁё]', '', 'g'))) / letters ELSE 0 END AS cyr,
  CASE WHEN letters > 0 THEN (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g'))) / letters ELSE 0 END AS lat,
  CASE WHEN chars > 0 THEN (length(t) - length(regexp_replace(t, '[{{}}\\[\\]\\\\|^~`_]', '', 'g'))) / chars ELSE 0 END AS sus,
  CASE WHEN chars > 0 THEN length(regexp_replace(t, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]', '', 'g')) / chars ELSE 0 END AS pri,
  CASE WHEN chars > 0 THEN (letters + digits) / chars ELSE 0 END AS aln,
  len([x FOR x IN w IF lower(x) IN ({_ENGLISH})]) AS eng, len([x FOR x IN w IF lower(x) IN ({_RUSSIAN}, {_ENGLISH})]) AS hits,
  CASE WHEN len(w) > 0 THEN len([x FOR x IN w IF regexp_matches(lower(x), '[аеёиоуыэюяaeiouy]')]) / len(w) ELSE 0 END AS vow,
  CASE WHEN len(w) > 0 THEN len([x FOR x IN w IF length(x) >= 4 AND x <> lower(x) AND x <> upper(x) AND x <> upper(x[1]) || lower(x[2:])]) / len(w) ELSE 0 END AS mix,
  CASE WHEN len(w) > 0 THEN list_sum([length(x) FOR x IN w]) / len(w) ELSE 0 END AS mean, CASE WHEN len(w) > 0 THEN len([x FOR x IN w IF length(x) <= 2]) / len(w) ELSE 0 END AS short FROM w),
r AS (SELECT *, cyr >= 0.28 AND n >= 3 AND mean >= 3.1 AS rus, lat >= 0.7 AND eng >= greatest(2, ceil(n * 0.04)) AS engl, digits >= 20 AND aln >= 0.55 AND n >= 3 AS tab FROM m),
u AS (SELECT *, letters >= 40 AND lat >= 0.7 AND NOT engl AS unk, n >= 10 AND mean < 3.1 AND short >= 0.45 AS frag, letters >= 40 AND cyr BETWEEN 0.18 AND 0.75 AND lat >= 0.2 AND hits < 2 AND short >= 0.35 AS impl FROM r),
s AS (SELECT *, greatest(0, least(100, CASE WHEN chars >= 80 THEN 15 WHEN chars >= 40 THEN 7 ELSE 0 END + CASE WHEN pri >= 0.98 THEN 10 WHEN pri >= 0.9 THEN 5 ELSE 0 END + CASE WHEN aln >= 0.55 THEN 10 WHEN aln >= 0.35 THEN 5 ELSE 0 END
  + CASE WHEN n >= 8 THEN 10 WHEN n >= 3 THEN 5 ELSE 0 END + CASE WHEN rus THEN 38 WHEN engl THEN 34 WHEN tab THEN 20 ELSE 0 END + CASE WHEN vow >= 0.65 THEN 8 WHEN vow >= 0.4 THEN 4 ELSE 0 END + least(9, hits * 3)
  - CASE WHEN unk THEN 35 ELSE 0 END - CASE WHEN frag THEN 30 ELSE 0 END - CASE WHEN impl THEN 25 ELSE 0 END - CASE WHEN mix >= 0.25 THEN 22 WHEN mix >= 0.12 THEN 10 ELSE 0 END - CASE WHEN sus >= 0.025 THEN 20 WHEN sus >= 0.01 THEN 8 ELSE 0 END)) AS score FROM u),
q AS (SELECT doc_id, lang, chars, CAST(score AS BIGINT) AS score, CASE WHEN chars < 80 THEN 'too_short' WHEN letters < 20 AND NOT tab THEN 'too_few_letters' WHEN unk THEN 'unknown_latin_glyph_layer' WHEN frag THEN 'fragmented_words' WHEN impl THEN 'implausible_mixed_script' WHEN mix >= 0.25 THEN 'suspicious_mixed_case' WHEN sus >= 0.025 THEN 'suspicious_symbols' WHEN score < 55 THEN 'low_quality_score' ELSE 'readable' END AS reason FROM s)
"""


QUERIES = {
    "q_bm25": q_bm25, "q_lemma": q_lemma, "q_phrase_lemma": q_phrase_lemma, "q_search_facets": q_search_facets, "q_fuzzy_search": q_fuzzy_search, "q_msm": q_msm, "q_crossfields": q_crossfields, "q_phrase": q_phrase, "q_phrase_slop": q_phrase_slop, "q_minus": q_minus, "q_phrase_or": q_phrase_or, "q_fuzzy": q_fuzzy, "q_facets": q_facets,
    "q_postfilter": q_postfilter, "q_total": q_total, "q_collapse": q_collapse, "q_collapse_lines": q_collapse_lines, "q_sort_date": q_sort_date, "q_filters": q_filters, "q_search": q_search, "q_compact": q_compact, "q_lines": q_lines,
    "q_tokens": q_tokens, "q_stop": q_stop, "q_truncate": q_truncate, "q_quality": q_quality, "q_garbled": q_garbled,
}

_V, _C = "[aeiouy]", "[^aeiouy]"


def _porter() -> str:
    """CTEs from voc(term) to lem(term, lemma): Porter's steps by regular expressions, and the stop words."""
    more, once = f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"^{_C}*{_V}+{_C}+$"
    cvc = f"{_C}{_V}[^aeiouywxY]$"
    has = lambda w, p: f"regexp_matches({w}, '{p}')"
    cut = lambda n: f"left(w, length(w) - {n})"

    def table(rules: dict[str, str], measure: str, extra: dict[str, str] | None = None) -> str:
        out = "CASE"
        for end in sorted(rules, key=lambda e: -len(e)):
            stem = cut(len(end))
            test = has(stem, measure) + (f" AND {extra[end].replace('STEM', stem)}" if extra and end in extra else "")
            out += f" WHEN suffix(w, '{end}') THEN CASE WHEN {test} THEN {stem} || '{rules[end]}' ELSE w END"
        return out + " ELSE w END"

    least = f"^{_C}*{_V}+{_C}"
    steps = [
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {has(cut(3), least)} THEN {cut(1)} ELSE w END WHEN suffix(w, 'ed') AND {has(cut(2), _V)} THEN {cut(2)} || '#' WHEN suffix(w, 'ing') AND {has(cut(3), _V)} THEN {cut(3)} || '#' ELSE w END",
        f"CASE WHEN NOT suffix(w, '#') THEN w WHEN {has('w', '(at|bl|iz)#$')} THEN {cut(1)} || 'e' WHEN length(w) > 2 AND w[-2] = w[-3] AND NOT {has('w', '[aeiouylsz]#$')} THEN {cut(2)} WHEN {has(cut(1), once)} AND {has(cut(1), cvc)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN {has('w', '[yY]$')} AND {has(cut(1), _V)} THEN {cut(1)} || 'i' ELSE w END",
        table(analysis.PORTER_2, least),
        table(analysis.PORTER_3, least),
        table(dict.fromkeys(analysis.PORTER_4, ""), more, {"ion": has("STEM", "[st]$")}),
        f"CASE WHEN suffix(w, 'e') AND ({has(cut(1), more)} OR {has(cut(1), once)} AND NOT {has(cut(1), cvc)}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {has(cut(1), more)} THEN {cut(1)} ELSE w END",
    ]
    out = "p0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM voc WHERE length(term) > 2)"
    for k, step in enumerate(steps):
        out += f",\np{k + 1} AS (SELECT term, {step} AS w FROM p{k})"
    stops = ", ".join(f"'{w}'" for w in sorted(analysis.RUSSIAN_STOP))
    return out + f",\nlem AS (SELECT term, CASE WHEN term IN ({stops}) THEN NULL ELSE coalesce(lower(w), term) END AS lemma FROM voc LEFT JOIN p{len(steps)} USING (term))"


def _lemmas(fields: str) -> str:
    """CTEs: f(doc_id, field, t) as given, tok(doc_id, field, p, term), lem, lt(doc_id, field, p, lemma)."""
    return f"""WITH f AS ({fields}),
arr AS (SELECT doc_id, field, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM f),
tok AS (SELECT doc_id, field, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM arr),
voc AS (SELECT DISTINCT term FROM tok),
{_porter()},
lt AS (SELECT doc_id, field, p, lemma FROM tok JOIN lem USING (term) WHERE lemma IS NOT NULL)"""


_ONE_FIELD = "SELECT doc_id, 'text' AS field, text AS t FROM documents"
_TWO_FIELDS = "SELECT doc_id, 'title' AS field, regexp_extract(text, '^([^.\\n]*)', 1) AS t FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents"


def _phrase_sql(name: str, tokens: str, field: str, words: list[str], slop: int) -> str:
    """A CTE name(doc_id, s): the phrase's score in a field, from a token table with columns doc_id, field, p, w."""
    n = len(words)
    at = ", ".join(f"list(p - {k}) FILTER (w = '{x}') AS a{k}" for k, x in enumerate(words))
    listed = ", ".join(f"'{x}'" for x in dict.fromkeys(words))
    weight, b = S.FIELDS[field]
    union = "list_distinct(flatten([" + ", ".join(f"a{k}" for k in range(n)) + "]))"
    ahead = ", ".join(f"list_min(list_filter(a{k}, lambda x: x >= v))" for k in range(n))
    every = " AND ".join(f"list_min(list_filter(a{k}, lambda x: x >= v)) IS NOT NULL" for k in range(n))
    return f"""{name}_a AS (SELECT doc_id, {at} FROM {tokens} WHERE field = '{field}' AND w IN ({listed}) GROUP BY doc_id HAVING count(DISTINCT w) = {len(dict.fromkeys(words))}),
{name}_v AS (SELECT doc_id, greatest({ahead}) - v AS wide FROM (SELECT *, unnest({union}) AS v FROM {name}_a) WHERE {every}),
{name}_f AS (SELECT doc_id, sum(1.0 / (1 + wide)) AS tf FROM {name}_v WHERE wide <= {slop} GROUP BY 1),
{name}_i AS (SELECT sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT count(DISTINCT doc_id) AS df FROM {tokens} WHERE field = '{field}' AND w IN ({listed}) GROUP BY w)),
{name}_l AS (SELECT doc_id, count(*) AS dl FROM {tokens} WHERE field = '{field}' GROUP BY 1),
{name} AS (SELECT doc_id, idf * tf / (tf + 1.2 * ({1 - b} + {b} * dl / (SELECT avg(dl) FROM {name}_l))) AS s FROM {name}_f JOIN {name}_l USING (doc_id), {name}_i)"""


def _cross_sql(name: str, words: list[str], fields: tuple[str, ...], least: int) -> str:
    """CTE name(doc_id, s): lemmas over several fields as one text."""
    listed, of = ", ".join(f"'{x}'" for x in words), ", ".join(f"'{x}'" for x in fields)
    w = " UNION ALL ".join(f"SELECT '{f}' AS field, {S.FIELDS[f][0]} AS boost, {S.FIELDS[f][1]} AS b" for f in fields)
    return f"""{name}_t AS (SELECT doc_id, field, lemma, count(*) AS tf FROM lt WHERE lemma IN ({listed}) AND field IN ({of}) GROUP BY ALL),
{name}_d AS (SELECT lemma, max(df) AS df FROM (SELECT field, lemma, count(*) AS df FROM {name}_t GROUP BY ALL) GROUP BY 1),
{name}_l AS (SELECT doc_id, field, count(*) AS dl FROM lt GROUP BY ALL), {name}_m AS (SELECT field, avg(dl) AS mean FROM {name}_l GROUP BY 1), {name}_w AS ({w}),
{name}_s AS (SELECT doc_id, lemma, max(boost * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - b + b * dl / mean))) AS s FROM {name}_t JOIN {name}_d USING (lemma) JOIN {name}_l USING (doc_id, field) JOIN {name}_m USING (field) JOIN {name}_w USING (field) GROUP BY ALL),
{name} AS (SELECT doc_id, sum(s) AS s FROM {name}_s GROUP BY 1 HAVING count(*) >= {least})"""


_EXACT_TOKENS, _LEMMA_TOKENS = "et AS (SELECT doc_id, field, p, term AS w FROM tok)", "ll AS (SELECT doc_id, field, p, lemma AS w FROM lt)"
_SEARCHED = S.terms_of(SEARCHED, "lemma")
SEARCH_SQL = f"""{_lemmas(_TWO_FIELDS)}, {_EXACT_TOKENS}, {_LEMMA_TOKENS},
{_cross_sql("must", _SEARCHED, ("title", "text"), S.needed(len(_SEARCHED)))},
{_cross_sql("entitled", _SEARCHED, ("title",), len(_SEARCHED))},
{_phrase_sql("ph1", "et", "title", SEARCHED.split(), 1)},
{_phrase_sql("ph2", "et", "text", SEARCHED.split(), 2)},
{_phrase_sql("ph3", "ll", "text", _SEARCHED, 3)},
hit AS (SELECT doc_id, lang, must.s + coalesce(entitled.s, 0) + coalesce(12 * ph1.s, 0) + coalesce(6 * ph2.s, 0) + coalesce(3 * ph3.s, 0) AS score,
  'https://h/' || source || '/' || CAST(doc_id // 10 AS VARCHAR) AS url FROM documents JOIN must USING (doc_id) LEFT JOIN entitled USING (doc_id) LEFT JOIN ph1 USING (doc_id) LEFT JOIN ph2 USING (doc_id) LEFT JOIN ph3 USING (doc_id))
"""
_URL = "'https://h/' || source || '/' || CAST(doc_id // 10 AS VARCHAR)"
_PADDED = "SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS t FROM documents"
ORACLE = {
    "q_bm25": _BM25 + "SELECT doc_id, round(score, 6) AS score, n_terms FROM s ORDER BY 2 DESC, 1 LIMIT 10",
    "q_lemma": _lemmas(_ONE_FIELD) + " SELECT term, lemma FROM lem",
    "q_phrase_lemma": f"{_lemmas(_ONE_FIELD)}, {_LEMMA_TOKENS} SELECT DISTINCT a.doc_id FROM ll AS a JOIN ll AS b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = '{analysis.lemma('thing')}' AND b.w = '{analysis.lemma('the')}'",
    "q_search": SEARCH_SQL + "SELECT url, doc_id AS chunk_id, round(score, 6) AS score FROM hit WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, doc_id) = 1 ORDER BY score DESC, url LIMIT 10",
    "q_search_facets": SEARCH_SQL + ", k AS (SELECT unnest(['all', 'en', 'de', 'fr', 'es']) AS category) SELECT category, CASE WHEN category = 'all' THEN (SELECT count(DISTINCT url) FROM hit) ELSE (SELECT count(DISTINCT url) FROM hit WHERE lang = category) END AS n, category = 'en' AS selected, (SELECT count(DISTINCT url) FROM hit WHERE lang = 'en') AS total, (SELECT least(count(*), 10000) FROM hit WHERE lang = 'en') AS hits FROM k",
    "q_fuzzy_search": f"{_lemmas(_ONE_FIELD)}, n AS (SELECT DISTINCT lemma, CASE WHEN lemma IN ('trhon', 'thorn', 'thrno') THEN 1 ELSE levenshtein(lemma, 'thron') END AS e FROM lem WHERE lemma LIKE 't%' AND length(lemma) BETWEEN 4 AND 6) SELECT doc_id, round(max(1.0 / (1 + e)), 6) AS score FROM lt JOIN n USING (lemma) WHERE e <= 1 GROUP BY 1",
    "q_msm": _BM25.replace("'the', 'thorn', 'erhe', 'queeau'", ", ".join(f"'{t}'" for t in COMMON)) + "SELECT doc_id, round(score, 6) AS score, n_terms FROM s WHERE n_terms >= 3",
    "q_crossfields": _CROSS,
    "q_phrase": f"{_lemmas(_ONE_FIELD)}, {_EXACT_TOKENS}, {_phrase_sql('ph', 'et', 'text', ['of', 'the', 'the'], 0)} SELECT doc_id, round(s, 6) AS score FROM ph",
    "q_phrase_slop": f"{_lemmas(_ONE_FIELD)} SELECT DISTINCT a.doc_id FROM tok AS a JOIN tok AS b ON a.doc_id = b.doc_id AND abs(b.p - 1 - a.p) <= 2 JOIN tok AS c ON a.doc_id = c.doc_id AND greatest(a.p, b.p - 1, c.p - 2) - least(a.p, b.p - 1, c.p - 2) <= 2 WHERE a.term = 'the' AND b.term = 'and' AND c.term = 'of'",
    "q_minus": f"{_lemmas(_ONE_FIELD)} SELECT DISTINCT doc_id FROM lt WHERE lemma = '{analysis.lemma('and')}' AND doc_id NOT IN (SELECT doc_id FROM lt WHERE lemma = '{analysis.lemma('the')}')",
    "q_phrase_or": f"{_lemmas(_TWO_FIELDS)}, {_LEMMA_TOKENS} SELECT doc_id FROM ({_PADDED}) WHERE t LIKE '% of the %' UNION SELECT a.doc_id FROM ll AS a JOIN ll AS b ON a.doc_id = b.doc_id AND a.field = b.field AND b.p = a.p + 1 WHERE a.field = 'text' AND a.w = '{analysis.lemma('of')}' AND b.w = '{analysis.lemma('the')}'",
    "q_fuzzy": f"WITH t AS (SELECT DISTINCT doc_id, term FROM ({_TOKENS})), v AS (SELECT term, count(*) AS df FROM t WHERE term LIKE 't%' AND length(term) BETWEEN 4 AND 6 GROUP BY 1) SELECT term, df, CAST(CASE WHEN term IN ('trhon', 'thorn', 'thrno') THEN 1 ELSE levenshtein(term, 'thron') END AS BIGINT) AS edits FROM v WHERE CASE WHEN term IN ('trhon', 'thorn', 'thrno') THEN 1 ELSE levenshtein(term, 'thron') END <= 1 ORDER BY edits, df DESC, term LIMIT 24",
    "q_facets": f"WITH c AS (SELECT lang, {_URL} AS url FROM documents) SELECT k.category, CASE WHEN k.category = 'all' THEN (SELECT count(DISTINCT url) FROM c) ELSE (SELECT count(DISTINCT url) FROM c WHERE lang = k.category) END AS n, k.category = 'fr' AS selected FROM (VALUES ('all'), ('en'), ('fr'), ('xx')) AS k(category)",
    "q_postfilter": f"WITH p AS ({_PADDED}), c AS (SELECT lang, {_URL} AS url FROM documents JOIN p USING (doc_id) WHERE t LIKE '% of %') SELECT k.category, CASE WHEN k.category = 'all' THEN (SELECT count(DISTINCT url) FROM c) ELSE (SELECT count(DISTINCT url) FROM c WHERE lang = k.category) END AS n, (SELECT count(DISTINCT url) FROM c WHERE lang = 'en') AS shown FROM (VALUES ('all'), ('en'), ('de')) AS k(category)",
    "q_total": f"SELECT count(DISTINCT {_URL}) AS total, least(count(*), 10000) AS hits FROM documents WHERE lang = 'en'",
    "q_collapse": f"SELECT {_URL} AS url, doc_id AS chunk_id, CAST(n_chars AS DOUBLE) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY {_URL} ORDER BY n_chars DESC, doc_id) = 1",
    "q_collapse_lines": "SELECT l_orderkey AS url, l_linenumber AS chunk_number, l_extendedprice AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1",
    "q_sort_date": "SELECT CAST(o_orderkey AS VARCHAR) AS url, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS sort_date, o_totalprice AS score FROM orders ORDER BY CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END ASC NULLS LAST, o_totalprice DESC, 1 LIMIT 50 OFFSET 100",
    "q_filters": "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND o_orderstatus = 'O' AND o_custkey % 2 = 0",
    "q_compact": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS compact FROM documents",
    "q_lines": "SELECT doc_id, sha256(array_to_string([x FOR x IN [trim(regexp_replace(y, '[ \\t]+', ' ', 'g')) FOR y IN string_split(text, chr(10))] IF x <> ''], chr(10))) AS lines FROM documents",
    "q_tokens": "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n, sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ')) AS terms FROM documents",
    "q_stop": "SELECT doc_id, len([x FOR x IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') IF x NOT IN ('the', 'of', 'and')]) AS n FROM documents",
    "q_truncate": "WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(left(t, 180), ' ,.;:-') || '…' END AS short FROM c",
    "q_quality": _QUALITY + "SELECT doc_id, score, reason FROM q",
    "q_garbled": _QUALITY + "SELECT lang, chars >= 80 AND reason <> 'readable' AS garbled, count(*) AS n FROM q GROUP BY ALL",
}
