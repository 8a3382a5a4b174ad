"""Queries of this subpackage over the given tables, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .bpe import Vocabulary, decode, encode
from .chat import chat_texts
from .decontaminate import contamination
from .html import extract
from .jaccard import similar_texts
from .language import fit, held_out, identify, learned_from
from .middle import fill_in_middle, restored
from .repair import damage, repaired_conversations
from .sampling import fingerprints
from .scoring import backoff_scores
from .suffixes import removal
from .urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    return decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(learned_from(docs))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(models, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.cross_entropy", "found.rejected")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_texts(table(spark, sf_dir, "conversations"))


ORACLES["op5_chat_formatting"] = """
WITH conv AS (
  SELECT conv_id, count(*) AS n_turns,
         list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, n_turns, turns, any_value(text) AS text FROM conv GROUP BY n_turns, turns)
SELECT f.conv_id, f.n_turns, f.text FROM firsts f
WHERE NOT EXISTS (
  SELECT 1 FROM conv c WHERE c.turns[1] = f.turns[1] AND c.n_turns > f.n_turns AND c.turns[1:f.n_turns] = f.turns)
"""


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


ORACLES["op10_lm_scoring"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
b AS (SELECT x.r, x.i, x.n, x.w, y.w AS v FROM w x LEFT JOIN w y ON y.r = x.r AND y.i = x.i - 1),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w), o1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
t AS (SELECT count(*) AS n FROM w),
j AS (
  SELECT b.r, b.v, c1.c - o1.c AS l1, coalesce(p.c - q.c, 0) AS lv, coalesce(c2.c - o2.c, 0) AS l2, greatest(t.n - b.n, 1) AS rest
  FROM b CROSS JOIN t JOIN c1 ON c1.w = b.w JOIN o1 ON o1.r = b.r AND o1.w = b.w
  LEFT JOIN c1 p ON p.w = b.v LEFT JOIN o1 q ON q.r = b.r AND q.w = b.v
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN o2 ON o2.r = b.r AND o2.v = b.v AND o2.w = b.w),
s AS (
  SELECT r, v, l2, (CASE WHEN l1 > 0 THEN l1 ELSE CAST(0.4 AS DOUBLE) END) / rest AS one, lv FROM j),
g AS (
  SELECT r, sum(ln(CASE WHEN v IS NULL THEN one WHEN l2 > 0 THEN l2 / CAST(greatest(lv, 1) AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) * one END)) AS log_score,
         sum(CASE WHEN v IS NOT NULL AND l2 = 0 THEN 1 ELSE 0 END) AS n_backoff
  FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(g.log_score, 0), 4) AS log_score, CAST(coalesce(g.n_backoff, 0) AS BIGINT) AS n_backoff
FROM d LEFT JOIN g ON g.r = d.r
"""


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repaired_conversations(conversations, damage(conversations))
    return found.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("repaired_sha256")).drop("text")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(x.cast("binary"), 256).alias(k) for k, x in digest.items()])


ORACLES["op12_fill_in_middle"] = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS us FROM documents),
g AS (SELECT *, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ord({0}[i]) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))"""
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE poly AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS k))),
src AS (SELECT row_number() OVER () AS r, 'c' || coalesce(CAST(conv_id AS VARCHAR), 'null') AS ck, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT src.*, xor({_CRC.format('k')}, CAST(4294967295 AS BIGINT)) % 20 AS f FROM src, poly),
dam AS (
  SELECT r, ck, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, r, copy) AS i, rtrim(text, {_WHITE_SQL}) AS bare FROM dam),
flt AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN bare[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         role[1:1] AS ini, lead(role[1:1]) OVER (PARTITION BY ck ORDER BY i) AS nxt FROM num),
summ AS (
  SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE nxt IS NOT NULL AND ini || nxt NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM flt GROUP BY ck),
ins(q, q2, cost, ops) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'),
  (0, 3, 6, 'II'), (1, 3, 6, 'II'), (2, 2, 6, 'II'), (3, 3, 6, 'II')),
wr(q, x, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ed AS (
  SELECT ck, i, q, q AS q2, 4 AS cost, 'D' AS op FROM flt, (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL SELECT ck, i, q, q2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K' FROM flt JOIN wr ON x = ini WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT ck, i, q, q2, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R' FROM flt, wr WHERE x <> 's' AND fault NOT IN ('blank', 'duplicate')),
stp AS (SELECT ck, i, ins.q, ed.q2, ins.cost + ed.cost AS cost, ins.ops || ed.op AS ops FROM ed JOIN ins ON ins.q2 = ed.q),
dp AS (
  SELECT ck, CAST(0 AS BIGINT) AS i, 0 AS q, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS w FROM summ
  UNION ALL
  SELECT dp.ck, dp.i + 1, stp.q2, min({{'c': w.c + stp.cost, 'a': w.a || stp.ops}}) FROM dp JOIN stp ON stp.ck = dp.ck AND stp.i = dp.i + 1 AND stp.q = dp.q
  GROUP BY dp.ck, dp.i + 1, stp.q2),
fin AS (SELECT dp.ck, min({{'c': w.c + ins.cost, 'a': w.a || ins.ops}}) AS w FROM dp JOIN summ ON summ.ck = dp.ck AND summ.n = dp.i JOIN ins ON ins.q = dp.q AND ins.q2 IN (0, 3) GROUP BY dp.ck),
let AS (SELECT ck, w.a[p] AS op, p, p - len(replace(w.a[1:p], 'I', '')) AS ni, len(replace(w.a[1:p], 'I', '')) AS i, len(replace(w.a[1:p - 1], 'D', '')) AS place,
               len(replace(w.a, 'D', '')) % 2 AS odd FROM (SELECT ck, w, unnest(range(1, len(w.a) + 1)) AS p FROM fin)),
rep AS (
  SELECT let.ck, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t
  FROM let LEFT JOIN flt ON flt.ck = let.ck AND flt.i = let.i WHERE op <> 'D' GROUP BY let.ck)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT ck, conv_id FROM src) c LEFT JOIN summ USING (ck) LEFT JOIN fin USING (ck) LEFT JOIN rep USING (ck)
"""


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    found = toxicity.score_texts(docs, net)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
