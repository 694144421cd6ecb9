"""Long inputs, clashing columns, and results that must not depend on company or order."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _text, bpe, fingerprint, html_text, ngram_join, pii, quality, secrets, shards
from tessera.llm.registry import tokenizer


def test_wide_pieces_like_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer()
    v = bpe.vocabulary(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["a" * 5000, "ab" * 3000, base64.b64encode(rng.randbytes(9000)).decode(), "".join(rng.choice("etaoinshrdlu") for _ in range(6000)), "=" * 5000, "日本語" * 1000]
    ids, at = v.encode(texts)
    assert v.spaced
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(t)
    other = bpe.Vocabulary(v.ranks, f"(?:{pattern})")  # not the known one: whole texts are split by it
    t = "it's  spaced \n\n out, 12 ways"
    assert not other.spaced and other.encode([t])[0].tolist() == enc.encode_ordinary(t)


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(1)
    run = base64.b64encode(rng.randbytes(90_000)).decode()
    numbers = " ".join(f"{rng.getrandbits(80):020x}" for _ in range(20_000))
    began = time.time()
    rows = {r.doc_id: r for r in secrets.digests(spark.createDataFrame([(1, run), (2, numbers)], "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert rows[1].spans == f"entropy:0:{len(run)}"
    want = ",".join(f"hex:{21 * i}:{21 * i + 20}" for i in range(20_000))
    assert rows[2].spans == want and rows[2].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_running_sums_and_maxima(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, xs array<bigint>")
    got = df.select("i", secrets.running(F.col("xs"), lambda a, b: a + b).alias("s"), secrets.running(F.col("xs"), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == np.cumsum(rows[r.i]).tolist() and r.m == np.maximum.accumulate(np.array(rows[r.i], int)).tolist()


def test_pages_without_article_tags(data):
    pages = pd.read_parquet(f"{data}/pages.parquet").html.tolist()
    kept = [html_text.main_text(h) for h in pages]
    bare = [html_text.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", h)) for h in pages]
    assert sum(a == b for a, b in zip(kept, bare, strict=True)) >= 0.9 * len(pages)
    assert sum(map(len, bare)) >= 0.9 * sum(map(len, kept))


def test_marks_on_a_wrapper_do_not_empty_a_page():
    inner = "<p>The words of the page are here, and there are many of them for all that want to read what it is about.</p>" * 3
    for html in (f"<div class='content-sidebar-wrap'>{inner}</div>", f"<div id=page-header-and-content><nav><a href=x>Home</a></nav>{inner}</div>"):
        assert html_text.main_text(html).count("The words of the page") == 3
    assert html_text.main_text(f"{inner}<div class=comments><p>A reader says that this is the best of all pages there are.</p></div>").count("\n") == 2


@pytest.mark.parametrize("shape", ["<div>x", "<p>a b</p>", "<svg>a", "<li><div>", "<a href=x>", "</b>", "<table><td>y"])
def test_pages_of_many_tags(shape):
    began = time.time()
    html_text.main_text(shape * 20_000)
    assert time.time() - began < 10


def test_scores_do_not_depend_on_company():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("good", "bad", "text!", "the", "of")) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    together = quality.scores(model, *_text.buffers(pa.array(texts)))
    alone = np.concatenate([quality.scores(model, *_text.buffers(pa.array([t]))) for t in texts])
    assert (together == alone).all()


def test_fit_on_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "fine words here" if i % 2 else "$$$ ### !!!") for i in range(60)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    a, b = (quality.fit(d, labels) for d in (docs, docs.repartition(5)))
    assert a.bias == b.bias and (a.weights == b.weights).all()
    assert quality.fit(docs, labels, most_bytes=5).bias == 0.0  # no text is as short


def test_names_are_distinct_whatever_the_role():
    s = pii.Surrogates(b"key")
    for script in ("latin", "cyrillic", "greek"):
        words = sorted(pii._listed(script)) + {"latin": ["Ann", "Bea", "Cyd", "Dora", "Edna"], "cyrillic": ["Вера", "Нина"], "greek": ["Ζωή"]}[script]
        new = {}
        for w in words:
            found = {s.name_part(w, role) for role in ("f", "m", "n", "s")}
            assert len(found) == 1 and w not in found
            new[w] = found.pop()
        assert len(set(new.values())) == len(words)


def test_one_person_one_surrogate_across_titles():
    s = pii.Surrogates(b"key")
    text, spans = pii.replace("Dr. Anna Weber came. Frau Anna Weber left. Anna Weber stayed, said Mrs. Weber, and Anna slept.", s)
    names = [text[a:b] for a, b, k in spans if k == "name"]
    assert len(set(names)) == 2 and "Anna" not in text and "Weber" not in text


def test_many_entities_in_one_text():
    text = " ".join(f"Frau Muster{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} user{i}@mail.example.org +1 212 555 {i % 10000:04d}" for i in range(20_000))
    began = time.time()
    assert len(pii.detect(text)) == 60_000
    assert time.time() - began < 60


def test_columns_of_helpers_names_are_kept(spark):
    text = "token = abcdefghijkl12345 and more words in it"
    docs = spark.createDataFrame([(i, text, i, "k", 7, "h") for i in range(40)], "doc_id long, TEXT string, _size long, _rn string, _Base long, _html string")
    sized = docs.withColumns({"size": F.lit(10), "text_crc32": F.lit(1)})
    out = shards.assign(sized, key_col="doc_id", shards=4)
    assert sorted((r._size, r._rn) for r in out.collect()) == [(i, "k") for i in range(40)]
    assert out.columns == [*sized.columns, "shard", "slot"]
    found = secrets.scan(docs, text_col="TEXT")
    assert {r._Base for r in found.collect()} == {7} and found.columns == [*docs.columns, "secrets"]
    pages = html_text.extract(docs, html_col="TEXT")
    assert {r._html for r in pages.collect()} == {"h"}


def test_one_record_repeated(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 3000, "doc_id long, text string").repartition(4)
    out = shards.placement(docs).toPandas()
    counts = out.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_edited_texts_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {}
    for i, (k, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want[k] = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprint_edits(docs).collect()} == want


def test_repeated_ids_are_cut(spark):
    rows = [(5, f"text number {i} of one id") for i in range(300)] + [(None, "x y z")] * 3 + [(7, "same")] * 50
    out = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text").where("not _ghost")
    assert out.count() == 353 and out.where("_next is null").count() == 0
    assert out.where("_id = 5").select("_b").distinct().count() > 5


def test_keep_one_where_ids_repeat(spark):
    a, b = "one two three four five six seven eight nine ten", "other words that have nothing to do with it at all"
    rows = [(1, a), (2, a), (2, b), (3, "short"), (3, "short"), (4, None), (4, None), (5, a + " eleven")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, a), (2, b), (3, "short"), (4, ""), (4, "")])
