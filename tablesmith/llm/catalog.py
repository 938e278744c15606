"""The queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import bpe, chat, decontam, line_dedup, mixing, negatives, phrases, quality, repeats, simhash, suffix_dedup, token_counts, toxicity

_WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.tilings(docs.select("doc_id", "text"), items).drop("key")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicate_groups(docs).select("doc_id", "fingerprint", "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.score_documents(docs)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality_rules(docs, carry=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, _table(spark, sf_dir, "labels")).drop("ratio")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], chats.schema)
    return chat.digest_turns(chat.format_turns(chats.unionByName(probe)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, with_kept=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(negatives.flipped(rows))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeated_windows(docs, with_kept=False)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL = {
    "op5_quality_rules": rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, len(ws) AS n_words, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM w),
m AS (SELECT l.doc_id, source, n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR 100 * n_dup_lines > 50 * n_lines AS failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT mean, CASE WHEN var > 0 AND mean * (1 - mean) / var - 1 > 0 THEN mean * (1 - mean) / var - 1 ELSE size END AS weight
  FROM (SELECT avg(x / n) AS mean, var_pop(x / n) AS var, avg(n) AS size FROM h)),
bad AS (SELECT source FROM h, p WHERE (x + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, pos, string_split(t, chr(10))[pos] AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(pos)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM c)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM c)), '')) AS kept_sha256
FROM k GROUP BY doc_id""",
    "op8_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op11_hard_negatives": """
WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
  CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS score FROM f a JOIN f b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3""",
    "op12_phrase_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM t, unnest(pieces) AS u(piece)),
g AS (SELECT lang, ws[i : i + k - 1] AS ids FROM w, unnest(range(1, len(ws) + 1)) AS a(i), unnest([1, 2, 3, 4, 5]) AS b(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, ids, count(*) AS a FROM g GROUP BY lang, ids HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE len(ids) > 1),
x AS (SELECT lang, ids[i : i + k - 1] AS ids, max(a) AS longer FROM c, unnest(range(1, len(ids) + 1)) AS p(i), unnest([2, 3, 4]) AS q(k)
  WHERE k < len(ids) AND i + k - 1 <= len(ids) GROUP BY lang, ids[i : i + k - 1]),
o AS (SELECT c.* FROM c LEFT JOIN x ON c.lang = x.lang AND c.ids = x.ids WHERE x.longer IS NULL OR 100 * x.longer < 100 * c.a),
s AS (SELECT o.lang, o.ids, o.a, l.a AS l, r.a AS r, n.n, 1000::HUGEINT * o.a * n.n // (l.a::HUGEINT * r.a) AS score, k
  FROM o JOIN n ON o.lang = n.lang, unnest([1, 2, 3, 4]) AS q(k), f l, f r
  WHERE k < len(o.ids) AND l.lang = o.lang AND l.ids = o.ids[1 : k] AND r.lang = o.lang AND r.ids = o.ids[k + 1 : len(o.ids)]
  QUALIFY row_number() OVER (PARTITION BY o.lang, o.ids ORDER BY score, k) = 1)
SELECT lang, row_number() OVER v AS rank, array_to_string(ids, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM s
WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ids, ' ')) QUALIFY row_number() OVER v <= 2000""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
