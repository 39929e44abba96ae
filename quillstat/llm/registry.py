"""Registered corpus queries: ``name -> f(spark, sf_dir) -> DataFrame`` and their DuckDB SQL."""

from __future__ import annotations

from . import ann, conversations, mixing, near_vectors, packing, phrases, repeats, secrets, simhash, topk, toxicity, url_filter, warc


def queries():
    return {
        "op1_secret_scan": secrets.query,
        "op2_best_fit_packing": packing.query,
        "op3_mixing": mixing.query,
        "op4_simhash": simhash.query,
        "op5_warc": warc.query,
        "op6_toxicity": toxicity.query,
        "op7_top_k": topk.query,
        "op8_ann": ann.query,
        "op9_repeats": repeats.query,
        "op10_url_filter": url_filter.query,
        "op11_phrases": phrases.query,
        "op12_near_vectors": near_vectors.query,
        "op13_conversation_repair": conversations.query,
    }


def oracle_sql():
    return {
        "op5_warc": warc.ORACLE,
        "op7_top_k": topk.ORACLE,
        "op11_phrases": phrases.ORACLE,
        "op12_near_vectors": near_vectors.ORACLE,
    }
