"""Every registered query: names and types of its columns, one row for each of its table, and SQL where there is some."""

import os

import pytest
from check_sql import compare

from loglattice.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
#: Columns that a query gives at least, its table, and whether it has one row for each of its rows.
CONTRACT = {
    "op1_rotated_codes": ("vec_id bigint, n_links bigint, component_id bigint, kept boolean", "embeddings", True),
    "op2_host_paths": ("page_id bigint, url string, text string, n_chars bigint", "pages", True),
    "op3_license_scan": ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", "documents", True),
    "op4_image_copies": ("image_id bigint, n_links bigint, component_id bigint, kept boolean", "embeddings", True),
    "op5_hmm_score": ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", "documents", True),
    "op6_surrogates": ("doc_id bigint, text string", "documents", True),
    "op7_multi_length_packing": ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "documents", False),
    "op8_lsh_forest": ("doc_id bigint, n_links bigint, component_id bigint, kept boolean", "documents", True),
    "op9_language_id": ("doc_id bigint, held_out boolean, lang_pred string, score double", "documents", True),
    "op10_byte_bpe": ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "documents", True),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    columns, table, one = CONTRACT[name]
    got = catalog.queries()[name](spark, DATA)
    assert dict(c.split() for c in columns.split(", ")).items() <= dict(got.dtypes).items()
    if one:
        assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_equals_sql(spark, name):
    n, differs = compare(spark, DATA, name)
    assert n > 100 and not differs


def test_model_gains_on_held_out_text(spark):
    """Per token of held-out documents, the states tell more than single words."""
    rows = catalog.queries()["op5_hmm_score"](spark, DATA).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert rows["sum(score)"] / rows["sum(n_tokens)"] > rows["sum(base_score)"] / rows["sum(n_tokens)"] + 0.1


def test_languages_of_held_out_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = catalog.queries()["op9_language_id"](spark, DATA).where("held_out and lang_pred <> 'und'").join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
