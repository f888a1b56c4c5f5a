"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom.llm import (
    bpe, chat, divergence, exact_dedup, grid_join, hmm, minhash, mixing, pii, quality, token_counts, token_files,
    variants,
)
from authloom.llm.store import Store

SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
WORD_OR_SIGN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
NOISE = r"[#%&*$]{3}"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary package keeps a file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf, "documents"), percent=85)


def op2_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return grid_join.near_embeddings(_table(spark, sf, "embeddings"), cosine=0.95)


def op3_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf, "documents"))


def op5_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf, "documents"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents come in, are counted anew on cleaner texts, toxic ones go; the last batch arrives twice."""
    docs = _table(spark, sf, "documents")
    versions = {"word-1": WORD, "wordpunct-1": WORD_OR_SIGN}
    raw, clean = F.col("text"), F.regexp_replace("text", NOISE, "")
    toxic = _table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    # what each text came and comes to, counted in one pass and kept as small rows
    store = Store(spark, "rollup")
    counts = store.save(token_counts.counted(docs, versions, {"tokens": clean, "old_tokens": raw}), "counts")
    roll = token_counts.Rollup(spark, store)
    first = counts.withColumn("tokens", F.col("old_tokens")).withColumn("old_tokens", F.lit(None).cast("long"))
    roll.commit(1, first.select(F.lit("insert").alias("op"), "*"))
    roll.commit(2, counts.where("tokens <> old_tokens").select(F.lit("revise").alias("op"), "*"))
    gone = counts.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("op"), "*")
    for _ in range(2):
        roll.commit(3, gone)
    return roll.totals()


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf, "labels")))


def op8_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Shares proportional to the square root of each source's characters."""
    mixed = mixing.mix(_table(spark, sf, "documents"), alpha=0.5, seed=SEED)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.md5("text").alias("text_md5"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_forms(_table(spark, sf, "documents"))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_table(spark, sf, "documents"))


def op13_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_token_files": op9_token_files,
    "op10_source_mixing": op10_source_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_hidden_markov": op13_hidden_markov,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, row_number() OVER w AS pos,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
n AS (SELECT conv_id, max(pos) AS n_turns FROM p GROUP BY ALL),
whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_same
  FROM p JOIN n USING (conv_id) WHERE pos = n_turns GROUP BY n_turns, prefix
  HAVING NOT bool_or(prefix IN (SELECT prefix FROM p JOIN n USING (conv_id) WHERE pos < n_turns)))
SELECT conv_id, (pos - 1) // 256 AS part, n_turns, n_same,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM p JOIN whole USING (conv_id) GROUP BY ALL""",
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       sha256(t) AS text_sha256, doc_id = max(doc_id) OVER same AS kept
FROM d WINDOW same AS (PARTITION BY t)""",
    "op6_token_counts": f"""
WITH d AS (SELECT *, regexp_replace(coalesce(text, ''), '{NOISE}', '', 'g') AS clean FROM documents
           WHERE NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND labels.doc_id = documents.doc_id))
SELECT source, lang, v.name AS tokenizer, count(*) AS docs,
       CAST(sum(CASE v.name WHEN 'word-1' THEN len(regexp_extract_all(clean, '{WORD}'))
                ELSE len(regexp_extract_all(clean, '{WORD_OR_SIGN}')) END) AS BIGINT) AS tokens
FROM d CROSS JOIN (VALUES ('word-1'), ('wordpunct-1')) AS v(name) GROUP BY ALL""",
    "op10_source_mixing": f"""
WITH v AS (SELECT source AS src, sum(length(coalesce(text, '')))::DOUBLE AS volume FROM documents GROUP BY ALL),
r AS (SELECT src, CASE WHEN volume = 0 THEN 1.0::DOUBLE
                  ELSE sqrt(volume) / (SELECT sum(sqrt(volume)) FROM v) * (SELECT sum(volume) FROM v) / volume END AS rate FROM v),
k AS (SELECT src, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 41)::BIGINT)) AS k FROM r),
p AS (SELECT src, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY src ORDER BY k)) AS p FROM k),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS step FROM p),
u AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) || ':{SEED}'), 1, 13))::BIGINT
             / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, source, text, key, u, count(*) AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.src AND c.step <= u.u GROUP BY ALL),
e AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT doc_id, source, copy, md5(key || ':' || copy::VARCHAR || ':{SEED}') AS shuffle_key, md5(text) AS text_md5 FROM e""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
here AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d)
         JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v,
             coalesce((SELECT sum(n) FROM here h WHERE h.lang = s.lang AND h.source = s.source), 0)::BIGINT AS total,
             coalesce((SELECT sum(n) FROM here h WHERE h.lang = s.lang), 0)::BIGINT AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
             1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) AS p,
             1 + (1000000000 * (coalesce(sum(n) OVER (PARTITION BY g.lang, kept.term), 0)::BIGINT + 1)) // (lang_total + v) AS q
      FROM g JOIN kept USING (lang) LEFT JOIN here USING (lang, source, term)),
pairs AS (SELECT x.lang, x.source, y.source AS item,
                 coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source
          LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term
          WHERE a.term IS NULL OR b.term IS NOT NULL GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
