"""The dealt operators bound to the test tables, with production parameters.

Each query runs its operator over its whole table. Models are trained when the
query is called; results are lazy beyond that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, embedding_links, fill_middle, hard_negatives, html_text, language, ngram_join, packing, piece_codec,
               quality, substrings, toxicity, warc)
from .common import table
from .folds import held_out

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.filter(~held_out(5, 0)))
    return (language.predict(documents, model).withColumn("held_out", held_out(5, 0))
            .select("doc_id", "held_out", "lang_pred", "score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return (toxicity.score_texts(documents, model).withColumn("held_out", held_out(4, 2))
            .select("doc_id", "held_out", "score", "predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_links.embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("class_id").alias("component_id"),
                        F.coalesce(F.col("vec_id") == F.col("class_id"), F.lit(True)).alias("kept"))


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    records = rows.unionByName(more).select("conv_id", "turn", record.alias("record"))
    turns = chat.read_records(records, "record", ("conv_id", "turn"))
    formatted = chat.format_turns(turns, ("conv_id", "turn"))
    return chat.conversation_digests(formatted, "conv_id", ("turn",))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.assess(documents, model).select("doc_id", *quality.STATS, "base_failed", "kept", "probability")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_MODEL)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), "id % 100 = 0")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_sentencepiece, op3_html_extraction, op4_language_id, op5_toxicity,
    op6_embedding_near_dedup, op7_chat_formatting, op8_warc, op9_quality_rules, op10_best_fit_packing,
    op11_fill_in_middle, op12_substring_dedup, op13_hard_negatives)}

#: DuckDB SQL of the queries that SQL can express (added below, where it can).
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
                                                     lambda k: array_to_string(w[k:k + 4], ' ')))) AS gram
  FROM t WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 5 * c.n >= 4 * (p.n + q.n - c.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT l.doc_id, l.class_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.doc_id = l.class_id AS kept
FROM least l LEFT JOIN degree d ON d.doc_id = l.doc_id
"""

ORACLE_SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM q
"""

ORACLE_SQL["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT l.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN degree d ON d.vec_id = l.vec_id
"""

ORACLE_SQL["op7_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         15 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g'))
            + length(regexp_replace(text, '[\\#<:]', 'xx', 'g')) AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

ORACLE_SQL["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
h AS (
  SELECT *, CAST('0x' || digest[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || digest[9:16] AS BIGINT) % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, least(a, b) AS one, greatest(a, b) AS two FROM h),
c AS (
  SELECT *, substr(t, 1, one) AS pre, substr(t, one + 1, two - one) AS mid, substr(t, two + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

ORACLE_SQL["op12_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
windows AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS x FROM starts),
often AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS k FROM windows SEMI JOIN often USING (x)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
