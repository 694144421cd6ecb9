"""The pipeline's stages against brute force on the smallest tables."""

import pandas as pd

import corpus_pipeline
from tessera.llm import pii
from tessera.llm._io import table
from tests.llm.test_exact import brute_components


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, data).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            want, _ = brute_components(list(before.items()))
            assert set(after) == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            items = pd.read_parquet(f"{data}/benchmark.parquet").text
            gone = {i for i, t in before.items() if any(x in t for x in items)}
            assert gone and not gone & set(after)
        elif name == "pii":
            s = pii.Surrogates(b"tessera-surrogates")
            assert {i: r.text for i, r in after.items()} == {i: pii.replace(t, s)[0] for i, t in before.items()}
        if name != "byte_bpe":
            assert docs.columns == columns
        seen.append(len(after))
    assert seen[0] < 200 and seen[1] < seen[0] and seen[-1] == seen[-2] > 0
    assert corpus_pipeline.run(spark, data).count() == seen[-1]
