"""The corpus pipeline against plain Python over the smallest table, and on odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendscope.llm import language_id, packing, pii, tokens
from tests.llm.test_table_operators import brute_groups
from tests.llm.test_text_operators import base_of

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for start, kind, end in sorted(base_of(text)):
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_is_its_stages(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    languages, _, cover = language_id.guesses(language_id.fit(documents), [t for _, t in rows])
    rows = [r for r, l, c in zip(rows, languages, cover) if l != "und" and c >= language_id.LEAST_COVER]
    groups, _ = brute_groups(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, redacted(t)) for i, t in rows if not any(x in t for x in items)]
    encoder, want = tokens.encoder(), []
    for i, t in rows:
        ids = encoder.plain(t) + packing.END_ID.to_bytes(4, "little")
        want += [(i, s, zlib.crc32(ids[4 * s : 4 * s + 8192]), len(ids) // 4) for s in range(0, len(ids) // 4, packing.SEQUENCE)]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "ids_crc32", "doc_tokens").collect())) == sorted(want)
    assert 20 < len(rows) < documents.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, nothing):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "pii", "packing"]
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns, name
        kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept))
    one = corpus_pipeline.one_of_each_group(spark, odd, SF)
    ids = sorted(r["doc_id"] for r in one.filter(F.col("doc_id").isNotNull()).collect())
    assert ids == [i for i in range(16) if i not in (1, 2, 8)] and one.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("name", ["n_chars"])
def test_length_follows_the_redaction(spark, name):
    docs = spark.createDataFrame([(1, "call +1 (234) 567-8901 now", 26)], f"doc_id long, text string, {name} long")
    row = corpus_pipeline.without_personal_data(spark, docs, SF).first()
    assert row["text"] == "call [PHONE] now" and row[name] == len(row["text"])
