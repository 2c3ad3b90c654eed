"""Queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, licenses, packing, quality_rules, simhash, spherical, training_order, transcripts, winnowing
from .tables import table


def op1_pu_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_conversations(table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op7_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.line_report(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_spherical_cap_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pu_quality_classifier,
        op2_training_order_shards,
        op3_transcript_roles,
        op4_best_fit_packing,
        op5_robust_quality_rules,
        op6_simhash_near_dedup,
        op7_winnowed_line_dedup,
        op8_licence_scan,
        op9_spherical_cap_near_dedup,
        op10_byte_bpe,
    )
}
#: The others iterate, fit a model, tokenize or hash, beyond SQL; tests hold each against brute force.
ORACLES: dict[str, str] = {
    "op9_spherical_cap_near_dedup": """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
), f as (
    select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
    where label is not null and vec_id is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), links as (
    select a.vec_id as x, b.vec_id as y from f a join f b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reached as (
    select vec_id, vec_id as root from v union select l.y as vec_id, r.root from reached r join links l on l.x = r.vec_id
), roots as (
    select vec_id, min(root) as root from reached group by vec_id
), counts as (
    select x, count(*) as n from links group by x
)
select v.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, v.vec_id)::bigint as component_id, coalesce(root = v.vec_id, true) as kept
from v left join counts on x = v.vec_id left join roots on roots.vec_id = v.vec_id
""",
}
