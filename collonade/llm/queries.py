"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from collonade.llm import bpe, centroids, filter_audit, licences, matroska, outliers, packing, pii, quality, simhash, style_tree, toxicity, url_filter
from collonade.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Words of a shingle: of the query, and of the pipeline's stage.
QUERY_SHINGLE, STAGE_SHINGLE = 3, 5


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.parse(matroska.store(table(spark, sf_dir, "documents"))))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary()))


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.digests(outliers.judge(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary()))


def op5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digests(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.group(table(spark, sf_dir, "documents"), QUERY_SHINGLE, similar=None))


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.digests(style_tree.extract(table(spark, sf_dir, "pages")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digests(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digests(url_filter.judge(table(spark, sf_dir, "pages")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings")))


ALL = (op1_matroska, op2_bpe, op3_outliers, op4_packing, op5_ranking, op6_simhash, op7_style_tree, op8_licences, op9_toxicity, op10_pii, op11_filter_audit, op12_url_filter, op13_centroids)
QUERIES = {f.__name__: f for f in ALL}
#: The others can't be written in SQL as a whole; the tests hold them against brute force.
ORACLES = {"op11_filter_audit": filter_audit.SQL, "op12_url_filter": url_filter.SQL, "op13_centroids": centroids.sql()}
