"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, exact_dedup, minhash, packing, quality, suffix_array, suffix_tree, token_count, toxicity
from lodestone.llm.common import documents


def tokenizer(name: str) -> str:
    """Place of an installed vocabulary file; pass another path to the operators to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE = "byte_bpe_50k.json"


PIECE_MODEL = "piece_bpe_32k.model"


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_substring_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.remove_repeated_words(documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_removed", "kept_sha256", "text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeated_bytes(documents(spark, sf_dir)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer(BYTE_BPE))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.with_other_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer(PIECE_MODEL))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir), tokenizer(BYTE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_forest": op1_minhash_forest,
        "op2_substring_tree": op2_substring_tree,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_suffix_array": op5_suffix_array,
        "op6_bpe": op6_bpe,
        "op7_preference_format": op7_preference_format,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_preference_format": """
            WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
            a AS (
                SELECT conv_id, turn AS last_turn, text AS answer FROM c WHERE role = 'assistant'
                QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
            j AS (
                SELECT c.*, a.last_turn, a.answer, o.answer AS instead
                FROM c LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN a AS o ON xor(c.conv_id, 1) = o.conv_id
                WHERE a.last_turn IS NULL OR c.turn <= a.last_turn),
            sides AS (
                SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM j
                UNION
                SELECT conv_id, 'rejected', turn, role,
                       CASE WHEN turn IS NOT DISTINCT FROM last_turn AND role = 'assistant' AND text = answer THEN instead ELSE text END AS t
                FROM j WHERE t IS NOT NULL),
            turns AS (
                SELECT pair_id, turn, list_sort(list([role, text]) FILTER (side = 'chosen')) AS c, list_sort(list([role, text]) FILTER (side = 'rejected')) AS r
                FROM sides GROUP BY ALL),
            splits AS (
                SELECT pair_id, min(turn) AS first, min(turn) FILTER (c IS DISTINCT FROM r) AS split,
                       max(greatest(coalesce(len(c), 0), coalesce(len(r), 0))) AS most
                FROM turns GROUP BY ALL),
            parts AS (
                SELECT s.*, split IS NULL OR turn < split AS is_prompt, CASE WHEN is_prompt THEN 'prompt' ELSE side END AS part,
                       CAST(floor((turn - CASE WHEN is_prompt THEN first ELSE split END) / 256) AS BIGINT) AS chunk,
                       CAST(('0x' || substr(md5(role || chr(10) || text), 1, 8))::BIGINT % CAST(ceil(most / 256) AS BIGINT) AS BIGINT) AS shard,
                       '<|im_start|>' || role || chr(10) AS header, header || text || '<|im_end|>' || chr(10) AS rendered
                FROM sides AS s JOIN splits ON s.pair_id IS NOT DISTINCT FROM splits.pair_id),
            places AS (
                SELECT *, coalesce(sum(length(rendered)) OVER (
                    PARTITION BY pair_id, chunk, shard, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
                FROM parts WHERE NOT is_prompt OR side = 'chosen')
            SELECT pair_id, chunk, shard,
                   coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'prompt'), '') AS prompt,
                   coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'chosen'), '') AS chosen,
                   coalesce(string_agg(rendered, '' ORDER BY turn, role, text) FILTER (part = 'rejected'), '') AS rejected,
                   coalesce(string_agg((pos + length(header)) || '-' || (pos + length(rendered)), ',' ORDER BY pos) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
                   coalesce(string_agg((pos + length(header)) || '-' || (pos + length(rendered)), ',' ORDER BY pos) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_loss
            FROM places GROUP BY pair_id, chunk, shard""",
        "op8_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    }
