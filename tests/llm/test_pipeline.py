"""The pipeline's stages on whole small tables."""

import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from studyloom.llm import packing, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "near dedup", "pii", "packing"]
    good = stages["quality rules"](spark, docs, SF)
    from test_operators import brute_verdict

    kept = {r["doc_id"] for r in docs.collect() if brute_verdict(r["text"])}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept

    single = stages["exact dedup"](spark, good, SF)
    groups = defaultdict(list)
    for r in good.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(min(g) for g in groups.values())

    apart = stages["near dedup"](spark, single, SF)
    from test_operators import brute_near

    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert {r["doc_id"] for r in apart.collect()} == {i for i, _, c in brute_near(rows, 5) if i == c}

    private = stages["pii"](spark, apart, SF)
    assert private.columns == docs.columns
    assert private.where(F.length("text") != F.col("n_chars")).count() == 0
    old = {r["doc_id"]: r["text"] for r in apart.collect()}
    for r in pii.with_pseudonyms(apart).collect():
        for p in r["pii"]:
            assert p["value"] in old[r["doc_id"]]

    packed = stages["packing"](spark, private, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in private.collect()}
    ours = {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()}
    assert ours == {tuple(r)[:5] for r in packed}
    assert sum(r["length"] for r in packed) == packing.tokenised_pieces(private).agg(F.sum("length")).first()[0]


def test_stages_of_odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows, empty tables and clashing columns go through every stage."""
    from test_operators import SCHEMA, odd_texts

    names = ["copy", "repetition", "pii", "gone_id", "id", "node"]
    docs = spark.createDataFrame(odd_texts(), SCHEMA).select("*", *(F.lit(1).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    left = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs, SF), SF)
    texts = [r["text"] for r in left.collect()]
    assert None in texts or "" in texts  # a text without words is linked with nothing
    assert corpus_pipeline.pack(spark, docs, SF).where("doc_id = 0").count() == 2  # the row stands there twice
