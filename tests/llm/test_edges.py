"""Every operator on awkward rows and on no rows at all."""

import pytest

from tessera.llm import bpe, decontaminate, fingerprint, html_text, lm_score, ngram_join, pii, quality, secrets, shards
from tessera.llm.registry import tokenizer

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def operators(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 0)], LABELS)
    items = spark.createDataFrame([(1, "jumps over the lazy dog and then it rests"), (2, None), (3, "")], ITEMS)
    return {
        "pii": lambda: pii.surrogate_texts(docs, "k"),
        "pii_stage": lambda: pii.without_pii(docs, "k"),
        "bpe": lambda: bpe.digests(docs, *tokenizer()),
        "decontaminate": lambda: decontaminate.contaminated(docs, items),
        "decontaminate_stage": lambda: decontaminate.keep_clean(docs, items),
        "quality": lambda: quality.judge(docs, labels),
        "quality_stage": lambda: quality.keep_good(docs, labels),
        "join": lambda: ngram_join.near_duplicates(docs),
        "join_stage": lambda: ngram_join.keep_one(docs),
        "html": lambda: html_text.extract(docs.withColumnRenamed("text", "html")),
        "lm": lambda: lm_score.score(docs),
        "secrets": lambda: secrets.digests(docs),
        "fingerprints": lambda: fingerprint.fingerprint_edits(docs),
        "shards": lambda: shards.placement(docs),
    }


#: Rows out for the eleven awkward rows: all of them unless stated.
ROWS = {"decontaminate": 4, "decontaminate_stage": 7, "quality_stage": None, "join_stage": None}


@pytest.mark.parametrize("name", ["pii", "pii_stage", "bpe", "decontaminate", "decontaminate_stage", "quality", "quality_stage", "join", "join_stage", "html", "lm", "secrets", "fingerprints", "shards"])
def test_awkward_and_empty(spark, messy, name):
    out = operators(spark, messy)[name]()
    n = out.count()
    want = ROWS.get(name, messy.count())
    assert n == want if want is not None else 0 < n <= messy.count()
    if name.endswith("_stage"):
        assert out.columns == messy.columns
    none = operators(spark, messy.where("doc_id = -1"))[name]()
    assert none.count() == 0 and none.columns == out.columns


def test_keep_one_keeps_first_of_copies(spark, messy):
    kept = sorted(r.doc_id for r in ngram_join.keep_one(messy).collect() if r.doc_id)
    assert kept == [1, 3, 4, 5, 6, 7, 9]  # 2 copies 1, 8 is near it
    marks = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(messy).collect()}
    assert marks[2] == 1 and marks[8] == 1 and marks[3] == 3 and marks[6] == 6


def test_repeated_runs_agree(spark, messy):
    for f in (fingerprint.fingerprint_edits, shards.placement):
        a, b = (sorted(map(str, f(messy.repartition(k)).collect())) for k in (1, 4))
        assert a == b


def test_no_labels_gives_half(spark, messy):
    out = quality.judge(messy, spark.createDataFrame([], LABELS))
    assert {r.score for r in out.collect()} == {0.5}
