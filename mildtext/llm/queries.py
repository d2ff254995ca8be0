"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.llm import bpe, chat, exact, jaccard, kdtree, packing, periods, quality, secrets, structure, substring, toxicity, urls
from mildtext.llm.common import read


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the byte-level vocabulary and decoded again."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), vocabulary, 2048), 2048)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(chat.format_conversations(turns))


# The stated rules on hosts and paths.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the stated rules, the rest by rules mined from what those decide."""
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a lexicon that is learned from labelled ones outside the held-out third."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


def op6_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th vector, out of all."""
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by base rules and by cutoffs certified on labelled ones per language."""
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base spans, and weak ones that are linked."""
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents whose five-word shingles are at least 80% alike, as components."""
    return jaccard.join(read(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words in windows of 35 that occur elsewhere too."""
    kept = substring.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # a text that lost nothing still has its own white space
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired by the cheapest edits."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure.digests(structure.repair(structure.damage(turns)), turns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, one in ten of which is made periodic first."""
    return periods.digests(periods.collapse(periods.plant(read(spark, sf_dir, "documents"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of those with equal text."""
    return exact.groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_chat_format": op10_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_kd_tree_top_k": op6_kd_tree_top_k,
    "op2_quality_rules": op2_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op1_substring_dedup": op1_substring_dedup,
    "op8_url_filter": op8_url_filter,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, lang, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
            FROM documents
        ), g AS (
            SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest([w[j : j + 4] FOR j IN range(1, len(w) - 3)]) AS five FROM t
        ), again AS (
            SELECT doc_id, unnest(range(i, i + 5)) AS place FROM
                (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1
        ), r AS (
            SELECT doc_id, count(DISTINCT place) AS n FROM again GROUP BY doc_id
        ), c AS (
            SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                   CAST(len(l) AS BIGINT) AS n_lines,
                   CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
                   CAST(len(w) - len(list_distinct(w)) AS BIGINT) AS n_not_distinct
            FROM t LEFT JOIN r USING (doc_id)
        ), b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
        ), good AS (
            SELECT lang, unnest(['symbols', 'marks', 'dup_lines', 'repeats', 'not_distinct']) AS rule,
                   unnest([n_symbols, n_marks, n_dup_lines, n_repeat_words, n_not_distinct]) AS count,
                   unnest([n_words, n_words, n_lines, n_words, n_words]) AS base
            FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(quality) = 1)
        ), cutoffs AS (
            SELECT unnest([100, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15, 10, 5]) AS cut
        ), tried AS (
            SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (100 * count >= cut * base) AS k FROM good, cutoffs GROUP BY ALL
        ), sure AS (
            SELECT lang, rule, cut,
                   k < n * 0.01 AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))
                                              FOR i IN range(0, k + 1)])
                       <= 0.05 / 5 / (SELECT count(DISTINCT lang) + count(DISTINCT CASE WHEN lang IS NULL THEN 1 END) FROM good) AS ok
            FROM tried
        ), cuts AS (
            SELECT lang, rule, min(cut) AS cut FROM sure s
            WHERE ok AND NOT EXISTS (SELECT 1 FROM sure f WHERE f.lang IS NOT DISTINCT FROM s.lang AND f.rule = s.rule AND f.cut >= s.cut AND NOT f.ok)
            GROUP BY ALL
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT EXISTS (
                   SELECT 1 FROM cuts WHERE cuts.lang IS NOT DISTINCT FROM b.lang AND 100 * CASE rule
                       WHEN 'symbols' THEN n_symbols WHEN 'marks' THEN n_marks WHEN 'dup_lines' THEN n_dup_lines
                       WHEN 'repeats' THEN n_repeat_words ELSE n_not_distinct END
                     >= cut * CASE rule WHEN 'dup_lines' THEN n_lines ELSE n_words END
               ) AS kept
        FROM b
    """,
    "op6_kd_tree_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op13_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)
    """,
}
