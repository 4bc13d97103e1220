"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, fixity, hard_negatives, mixture, packing, quality_model, quality_rules, secrets, simhash, spelling, substring_dedup, toxicity, url_filters


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_url_filters": url_filters.op1_url_filters,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality_model": quality_model.op3_quality_model,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_mixture": mixture.op5_mixture,
        "op6_packing": packing.op6_packing,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_merkle_fixity": fixity.op9_merkle_fixity,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_secret_scan": secrets.op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters.sql(),
        "op5_mixture": mixture.sql(),
        "op8_exact_dedup": exact_dedup.sql(),
        "op9_merkle_fixity": fixity.sql(),
        "op10_quality_rules": quality_rules.sql(),
        "op11_spelling_variants": spelling.sql(),
        "op12_hard_negatives": hard_negatives.sql(),
    }
