"""Every stage of the pipeline against a brute-force version, on its own input."""

import pytest

import corpus_pipeline
from propwise.llm import mixing

from .test_text_operators import (ODD, SCHEMA, SF, brute_components, brute_exact, brute_fp, brute_targets, check_packing,
                                  norm, words_of)


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("kind", ["table", "odd rows", "empty"])
def test_stages_equal_brute_force(spark, kind):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    docs = (whole if kind == "table" else spark.createDataFrame(ODD if kind == "odd rows" else [], SCHEMA).unionByName(
        whole.where("doc_id > 100").limit(40) if kind == "odd rows" else whole.limit(0)))
    docs = docs.cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]

    spoken = stages["language_id"](spark, docs, SF).cache()
    assert key(spoken.collect()) == key(r for r in docs.collect() if any(map(str.isalpha, r.text or "")))

    single = stages["exact_dedup"](spark, spoken, SF).cache()
    rows = spoken.collect()
    assert key({norm(r.text) for r in single.collect()}) == key({norm(r.text) for r in rows})
    keep = {digest: i for _, i, _, digest in brute_exact([(r.doc_id, r.text) for r in rows])}
    assert key(r.doc_id for r in single.collect()) == key(keep.values())

    apart = stages["simhash_near_dedup"](spark, single, SF).cache()
    rows = single.collect()
    comp = brute_components([brute_fp(r.text) for r in rows], [r.doc_id for r in rows])
    assert key(r.doc_id for r in apart.collect()) == key(set(comp))
    assert set(map(str, apart.collect())) <= set(map(str, rows))

    mixed = stages["mixing"](spark, apart, SF).cache()
    assert mixed.columns == docs.columns
    size, taken = {}, {}
    for r in apart.collect():
        size[r.source] = size.get(r.source, 0) + len(words_of(r.text))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
    goal = brute_targets(size) if size else {}
    slack = 2 + 2 * sum(size.values()) / 2 ** mixing.SLOT_BITS
    assert all(abs(taken.get(s, 0) - goal[s]) <= slack for s in goal)
    words = {r.doc_id: len(words_of(r.text)) for r in apart.collect()}
    for i, n in words.items():
        assert sum(len(words_of(r.text)) for r in mixed.collect() if r.doc_id == i) <= 3 * n

    packed = stages["packing"](spark, mixed, SF).collect()
    if mixed.count():
        check_packing([(r.doc_id, r.text) for r in mixed.collect()], packed)
    else:
        assert packed == []


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF).cache()
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "length", "ids_crc32", "doc_tokens"]
    assert got.agg({"length": "sum"}).collect() == docs.agg({"length": "sum"}).collect()
    assert key(set(got.select("doc_id", "doc_tokens").collect())) == key(set(docs.select("doc_id", "doc_tokens").collect()))
    assert got.columns == docs.columns and set(columns) <= set(got.columns)
