"""The operators' registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from ._common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    from .line_dedup import EXACT_CHARS, duplicate_lines

    return duplicate_lines(table(spark, sf_dir, "documents"), exact_chars=EXACT_CHARS)


def op2_best_fit_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats")
    )


def op4_cover_tree(spark, sf_dir):
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_factorisation_machine(spark, sf_dir):
    from .quality_model import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_minhash_odd_sketch(spark, sf_dir):
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_weighted_fair_mix(spark, sf_dir):
    from pyspark.sql import functions as F

    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op9_suffix_array_rules(spark, sf_dir):
    from .quality_rules import quality_stats

    return quality_stats(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_cover_tree": op4_cover_tree,
        "op5_factorisation_machine": op5_factorisation_machine,
        "op6_minhash_odd_sketch": op6_minhash_odd_sketch,
        "op7_license_scan": op7_license_scan,
        "op8_weighted_fair_mix": op8_weighted_fair_mix,
        "op9_suffix_array_rules": op9_suffix_array_rules,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    from .license_scan import scan_sql
    from .line_dedup import LINES_SQL
    from .mixing import MIX_SQL

    return {"op1_line_dedup": LINES_SQL, "op7_license_scan": scan_sql(), "op8_weighted_fair_mix": MIX_SQL}
