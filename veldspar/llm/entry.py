"""The registered queries of this subpackage and their SQL.

Each query applies its operator to the whole table with production parameters.  Rows with a null
doc_id keep their row where there is one for each row; their held_out is null, and no label is learned from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, huffman, language, licenses, pieces, quality, rules, simhash, substrings, toxicity, trie
from .common import crc_rest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def _classified(scored: DataFrame, modulus: int, rest: int, least: float) -> DataFrame:
    return scored.select("doc_id", (crc_rest("doc_id", modulus) == rest).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=crc_rest("doc_id", 3) != 1)
    return _classified(toxicity.score(docs, weights), 3, 1, 0.7)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"), usable=crc_rest("doc_id", 5) != 0)
    return _classified(quality.score(docs, trees), 5, 0, 0.3)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), rules.POLICIES["standard"])
    base = F.col("failed").bitwiseAND(F.lit(rules.POLICIES["base"].mask)) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language.train(docs, usable=crc_rest("doc_id", 4) != 2)
    return language.predict(docs, models).select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.with_shared_starts(trie.numbered(table(spark, sf_dir, "conversations"))))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(audit.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(chat.ADDED_ID, 0, "user", chat.ADDED_TEXT), (chat.ADDED_ID, 1, "assistant", chat.ADDED_TEXT)]
    added = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.round_trip(told, tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    numbered = (op1_decontaminate, op2_substrings, op3_toxicity, op4_quality, op5_licenses, op6_simhash, op7_huffman, op8_pieces, op9_rules, op10_language, op11_trie, op12_audit, op13_chat)
    return {f.__name__: f for f in numbered}


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, ws[i:i+4] AS win FROM g),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM h) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM f) GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
x AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_bangs > n_words THEN 128 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM x
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force, round trips or held-out rows."""
    return {"op5_licenses": licenses.sql(), "op9_rules": OP9_SQL, "op11_trie": trie.SQL, "op12_audit": audit.SQL, "op13_chat": chat.SQL}
