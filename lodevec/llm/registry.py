"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from lodevec.llm import ann, langid, lattice, packing, quality, simhash, tokenbin, toxicity, urlfilter, warc


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_token_binary": tokenbin.op2_token_binary,
        "op3_nearest_neighbours": ann.op3_nearest_neighbours,
        "op4_url_filter": urlfilter.op4_url_filter,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_warc_revisits": warc.op7_warc_revisits,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": langid.op9_language_id,
        "op10_sentencepiece": lattice.op10_sentencepiece,
        "sentencepiece_viterbi": lattice.sentencepiece_viterbi,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"op3_nearest_neighbours": ann.OP3_SQL, "op4_url_filter": urlfilter.OP4_SQL, "op7_warc_revisits": warc.OP7_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
