"""Cleaning and mixing of a document corpus: each stage works on all that the one before it kept.

language: documents whose language cannot be told go; where the corpus teaches none, those without a letter. quality: those that the classifier scores low go. near_duplicates: one
document of each group of five-word-shingle similarity 0.8 stays, that with the smallest id, also where rows share an id or have
none; wordless texts belong to no group. decontamination: benchmark passages
are cut out, documents that are mostly such passages go. mixing: sources are brought to their target weights; documents that
the mix does not take go, the others say how many of their words it takes and how many whole times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.llm import decontam, langid, minhash, mixing, quality
from rasterlane.llm.common import drop_path, table, written

LEAST_LANGUAGE_SCORE = 0.5
LEAST_QUALITY_SCORE = 0.3
RESULT = "_mx_result_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs, F.lit(True))
    if net is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    told = langid.predict(docs, net, docs.columns, names=("_li_lang", "_li_score"))
    return told.where((F.col("_li_lang") != "und") & (F.col("_li_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.predict(docs, trees, docs.columns, name="_q_score").where(F.col("_q_score") >= LEAST_QUALITY_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by a key of this stage alone: ids may repeat, clash or be null
    keyed, _ = written(docs.withColumns({"_nd_key": F.monotonically_increasing_id(), "_nd_text": F.xxhash64("text")}), "keyed")
    told = minhash.near_duplicates(keyed, k=5, num=4, den=5, id_col="_nd_key").select("_nd_key", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_nd_text", "_nd_key")
    first = told.join(keyed.select("_nd_key", "doc_id", "_nd_text"), "_nd_key").groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(first.select(F.col("first._nd_key").alias("_nd_key")), "_nd_key", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # results whose names a column of the documents has already are left out
    took = mixing.mix_sources(docs, keep=docs.columns, prefix=RESULT).where(F.col(f"{RESULT}taken") > 0)
    had = {c.lower() for c in docs.columns}
    return took.select(*docs.columns, *[F.col(c).alias(c.removeprefix(RESULT)) for c in took.columns if c.startswith(RESULT) and c.removeprefix(RESULT) not in had])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed),
]

#: SQL cannot express the trained stages; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = path
    return docs
