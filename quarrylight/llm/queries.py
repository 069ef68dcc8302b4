"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_windows, read_windows
from .cover_tree import top_k
from .decontaminate import decontaminate
from .mixing import mixture
from .pii import KINDS, find_pii
from .quality import quality
from .simhash import simhash_components
from . import toxicity
from .substring_dedup import substring_dedup
from .token_output import read_token_files, token_files_folder, write_token_files

#: A vocabulary file of the installed public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.p = words.p WHERE hit.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op2_token_output(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    folder = token_files_folder(spark)
    write_token_files(table(spark, d, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return read_token_files(spark, folder, with_ids=False)


def op5_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP5 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN bwin ON dwin.n = bwin.n AND dwin.k = bwin.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash_components(table(spark, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    found = find_pii(table(spark, d, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["name"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("all")).alias("spans"))


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_chat(spark: SparkSession, d: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    talks = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = read_windows(format_windows(talks))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(F.array_join("losses", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("losses", ""), 256).alias("loss_sha256"), "formatted_chars")


#: The windows of `format_windows` (budget 512, history 128) in SQL, for the number of formatted characters.
_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tok, row_number() OVER o AS nth,
  length(text) + length(role) + 2 + len(regexp_extract_all(text || role, '[~<\[\]]')) + 7 AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY nth) AS upto, min(CASE WHEN role = 'system' THEN nth END) OVER (PARTITION BY conv_id) AS sys_nth FROM t),
s AS (SELECT *, nth = coalesce(sys_nth, 0) AS sys, upto - tok AS before, coalesce(max(CASE WHEN nth = sys_nth THEN tok END) OVER (PARTITION BY conv_id), 0) AS sys_tok,
  coalesce(max(CASE WHEN nth = sys_nth THEN chars END) OVER (PARTITION BY conv_id), 0) AS sys_chars FROM p),
r AS (SELECT *, greatest(1, 512 - 128 - sys_tok) AS room FROM s),
w AS (SELECT *, CASE WHEN before // room = (upto - 1) // room THEN 2 * (before // room) ELSE 2 * (before // room) + 1 END AS slot FROM r),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, slot ORDER BY nth) AS place, sum(tok) OVER (PARTITION BY conv_id, slot) AS fresh, nth > coalesce(sys_nth, nth) AS late FROM w),
h AS (SELECT *, least(128, greatest(0, 512 - fresh - CASE WHEN late THEN sys_tok ELSE 0 END)) AS allowed FROM v),
f AS (SELECT a.*, (SELECT coalesce(sum(b.chars), 0) FROM h AS b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND NOT b.sys AND b.before >= a.before - a.allowed AND b.before < a.before AND a.place = 1) AS recent FROM h AS a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN place = 1 THEN recent + CASE WHEN late THEN sys_chars ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op8_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


_OP8 = r"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return found.select("row.doc_id", "score", "predicted").withColumn("held_out", toxicity.held_out()).select("doc_id", "held_out", "score", "predicted")


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_token_output": op2_token_output, "op5_decontaminate": op5_decontaminate, "op7_simhash": op7_simhash, "op3_pii": op3_pii, "op4_quality": op4_quality, "op6_chat": op6_chat, "op8_exact_top_k": op8_exact_top_k, "op9_toxicity": op9_toxicity, "op10_mixing": op10_mixing}
ORACLE = {"op1_substring_dedup": _OP1, "op5_decontaminate": _OP5, "op6_chat": _OP6, "op8_exact_top_k": _OP8}
