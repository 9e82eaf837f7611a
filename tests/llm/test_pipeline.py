"""The pipeline's stages against what their operators say by brute force."""

import hashlib
import struct
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from quarry.llm import bpe, mixing, toxicity
from quarry.llm.common import table

from .test_operators import SF, brute_components


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    clean = corpus_pipeline.reject_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.score(docs, table(spark, SF, "labels"), keep=["doc_id"]).collect() if r.score >= 0.7}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = corpus_pipeline.drop_near_duplicates(spark, clean, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in clean.collect()])})
    mixed = corpus_pipeline.mix_sources(spark, single, SF).cache()
    want = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == want
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == want
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in single.collect()}
    for r in out:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_repeated_documents_leave_one(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (5, "A b c d"), (None, "x y"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=repr) == [3, 8, None]


def test_run_on_odd_tables(spark, tmp_path):
    """Empty documents, null texts, repeated rows and clashing columns run through all stages."""
    from .test_operators import ODD, clashing

    docs = clashing(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame([(7, 0, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("empty", docs.limit(0)), ("odd", docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").collect() == []
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    assert {r.doc_id for r in out} <= {i for i, _, _ in ODD} and all(r.n_tokens >= 0 for r in out)
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        assert stage(spark, docs, f"file://{tmp_path}/odd").columns == docs.columns
