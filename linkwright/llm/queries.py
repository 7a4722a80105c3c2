"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.llm.common import fold, table
from linkwright.llm.language_model import score_documents
from linkwright.llm.licenses import scan_licenses
from linkwright.llm.mixing import mix_sources
from linkwright.llm.oracles import ORACLES
from linkwright.llm.packing import pack_documents
from linkwright.llm.pii import pseudonymise_documents
from linkwright.llm.quality import quality_documents
from linkwright.llm.simhash import simhash_components
from linkwright.llm.telephony import telephony_documents
from linkwright.llm.topk import exact_topk, quantize
from linkwright.llm.toxicity import toxicity_documents


def op1_telephony(spark, sf_dir):
    return telephony_documents(table(spark, sf_dir, "documents"))


def op2_gru_language_model(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), ~fold(7, 2))


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def _labels(spark, sf_dir, name, modulus, remainder):
    return table(spark, sf_dir, "labels").where(~fold(modulus, remainder)).select("doc_id", F.col(name).alias("label"))


def op5_quality_mil(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_documents(docs, _labels(spark, sf_dir, "quality", 4, 2))
    return out.select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


def op6_toxicity_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity_documents(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    return out.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted", "evidence")


def op7_simhash(spark, sf_dir):
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark, sf_dir):
    vectors = quantize(table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


def op10_pii_feistel(spark, sf_dir):
    return pseudonymise_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_gru_language_model": op2_gru_language_model,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_mil": op5_quality_mil,
    "op6_toxicity_knn": op6_toxicity_knn,
    "op7_simhash": op7_simhash,
    "op8_license_scan": op8_license_scan,
    "op9_exact_topk": op9_exact_topk,
    "op10_pii_feistel": op10_pii_feistel,
}

__all__ = ["ORACLES", "QUERIES"]
