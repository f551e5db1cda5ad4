"""Queries of the operators on the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import bpe, hmm, hostpaths, keypoints, langid, licenses, lshforest, packing, rotated, surrogates
from loglattice.llm.common import read, remainder

#: Files of public tokenizers; they stay where they are.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A deployment passes its own secret key; this one is for queries on synthetic tables.
SURROGATE_KEY = b"synthetic tables only"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostpaths.main_text(read(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read(spark, sf_dir, "documents")).drop("detections")


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: those drawn from all embeddings."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), keypoints.drawn(F.col("embedding")).alias("image"))
    return keypoints.near_duplicates(vectors)


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_corpus(read(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    key = surrogates.checked_key(docs, SURROGATE_KEY)
    got = surrogates.replace(docs, key)
    return got.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",").alias("kinds"))


def op7_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out), PIECES)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, score="score").select("doc_id", "held_out", "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rotated_codes, op2_host_paths, op3_license_scan, op4_image_copies, op5_hmm_score, op6_surrogates, op7_multi_length_packing, op8_lsh_forest, op9_language_id, op10_byte_bpe)}


#: Links within a label by cosine, and what they reach.
ROTATED_SQL = """with recursive rows as (select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e from embeddings),
 good as (select * from rows where e is not null and label is not null and vec_id is not null and len(e) > 0
  and not list_aggregate([x is null or isnan(x) or isinf(x) for x in e], 'bool_or') and list_aggregate([x <> 0 for x in e], 'bool_or')),
 pairs as (select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
 reach(a, b) as (select r, r from good union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
 parts as (select reach.a as r, min(rows.vec_id) as component_id from reach join rows on rows.r = reach.b group by reach.a),
 links as (select a as r, count(*) as n from pairs group by a)
 select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from rows left join links using (r) left join parts using (r)"""
#: Runs of five words that documents share, and what links of at least 0.8 reach.
FOREST_SQL = r"""with recursive rows as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 runs as (select distinct r, array_to_string(w[i : i + 4], ' ') || '/' || least(len(w), 5) as s from rows, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0 and doc_id is not null),
 sizes as (select r, count(*) as n from runs group by r),
 common as (select a.r as a, b.r as b, count(*) as c from runs a join runs b on a.s = b.s and a.r <> b.r group by a.r, b.r),
 pairs as (select a, b, c = x.n and c = y.n as same from common join sizes x on x.r = a join sizes y on y.r = b where 5 * c >= 4 * (x.n + y.n - c)),
 reach(a, b) as (select r, r from sizes union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
 parts as (select reach.a as r, min(rows.doc_id) as component_id from reach join rows on rows.r = reach.b group by reach.a),
 links as (select a as r, count(*) as n, min(case when same then o.doc_id end) as class_id from pairs join rows o on o.r = b group by a)
 select doc_id, least(doc_id, coalesce(class_id, doc_id)) as class_id, coalesce(n, 0) as n_links, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from rows left join links using (r) left join parts using (r)"""


def oracle_sql() -> dict[str, str]:
    """The other operators hold trained models, tokenizers, keyed permutations or images: tests compare them with brute force,
    other libraries or round trips."""
    return {"op1_rotated_codes": ROTATED_SQL, "op8_lsh_forest": FOREST_SQL}
