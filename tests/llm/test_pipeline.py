"""The stages on a small table: what they keep, replace and pack."""

import corpus_pipeline
from loglattice.llm import packing
from loglattice.llm.catalog import WORD_BPE


def test_stages(spark, tmp_path):
    base = [f"the house number {i} of the old town stands beside the river and nobody has lived in it since winter {i} came" for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(40, base[0], "en", "s", 1), (41, base[1].upper() + "!", "en", "s", 1), (42, "123 ... 456", "en", "s", 1), (43, None, "en", "s", 0), (44, "please write to the old house at jo.doe@mail.example.com today", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {*range(42), 44}
    assert set(kept[1]) == {*range(40), 44}
    assert "jo.doe" not in kept[2][44] and {k: v for k, v in kept[2].items() if k != 44} == {k: v for k, v in kept[1].items() if k != 44}
    ids = packing.word_ids(WORD_BPE).encode
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == sum(len(x) for x in ids(list(kept[2].values())))
