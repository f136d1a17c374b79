"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.llm import divergence, exact_search, fingerprints, line_dedup, mixing, ngram_join, packing, quality_rules, site_quality, store, substring_dedup, toxicity, warc_zip, whitening


def op1_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(store.read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    judged = toxicity.judge(store.read(spark, sf_dir, "documents").select("doc_id", "text"), store.read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "toxic", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in toxicity.CATEGORIES])


def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(store.read(spark, sf_dir, "documents"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(store.read(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.digest(store.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_warc_zip(spark, sf_dir):
    return warc_zip.round_trip(spark, store.read(spark, sf_dir, "pages")).drop("url")


def op7_site_quality(spark, sf_dir):
    judged = site_quality.judge(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "kept", *[F.round(c, 6).alias(c) for c in ("p_doc", "host_rate", "path_rate", "posterior")])


def op8_mixing(spark, sf_dir):
    return mixing.plan(store.read(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir, tokenizer="word_bpe_49k.json"):
    import public_tokenizers

    return packing.pack(store.read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer)).drop("source")


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(store.read(spark, sf_dir, "documents"))


def op11_divergence(spark, sf_dir):
    return divergence.audit(store.read(spark, sf_dir, "documents"))


def op12_exact_search(spark, sf_dir):
    return exact_search.top_k(store.read(spark, sf_dir, "embeddings"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(store.read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_fingerprints, op4_ngram_join, op5_line_dedup, op6_warc_zip, op7_site_quality, op8_mixing, op9_packing, op10_substring_dedup, op11_divergence, op12_exact_search, op13_whitening)}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op4_ngram_join": ngram_join.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op6_warc_zip": warc_zip.ORACLE, "op8_mixing": mixing.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "op11_divergence": divergence.ORACLE, "op12_exact_search": exact_search.ORACLE}
