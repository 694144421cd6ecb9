"""Vectors, chunks, embeddings, the change log, streams, logs, catalog, SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, dml, logs, rag, search, sqlapi, vector
from tessera.sources import arrow
from tessera.sources import documents as D
from tessera.streaming import cdc


def test_nearest_of_axes(spark):
    df = spark.createDataFrame([("doc1", [1.0, 0.0, 0.0]), ("doc2", [0.0, 1.0, 0.0]), ("doc3", [0.0, 0.0, 1.0]), ("none", [])], "id string, vector array<float>")
    assert [r.id for r in vector.knn(df, [0.9, 0.1, 0.0], 1).collect()] == ["doc1"]
    assert vector.knn(df, [0.9, 0.1, 0.0], 1, compat=True).first().id == "none"
    model, indexed = vector.lsh_index(df.where(F.size("vector") > 0))
    assert vector.lsh_search(model, indexed, [0.9, 0.1, 0.0], 1).first().id == "doc1"


def test_hybrid(spark):
    docs = D.sample(spark)
    like_a_violin = [0.9, 0.4, 0.1]
    assert [r.id for r in vector.hybrid(docs, like_a_violin, 2, "category = 'strings'").collect()] == ["violin", "harp"]
    assert [r.id for r in vector.hybrid(docs, like_a_violin, 2, "category = 'strings'", compat=True).collect()] == ["cello", "harp"]


def test_embedding_values():
    raw = rag.Embedding(normalize=False)
    e = rag.embed_text("a", raw)
    assert e[268] == 3.0 and e[204] == 0.5 and np.count_nonzero(e) == 2
    e = rag.embed_text("é", raw)
    assert e[164] == 1.0 and e[76] == 0.5 and e[1] == 2.0
    assert abs(np.linalg.norm(rag.embed_text("Hello, world!")) - 1) < 1e-5
    assert rag._bytes_hash("Hello") == 0x63F0BFACF2C00F6B
    assert not rag.embed_text("").any()


def test_windows(spark):
    df = spark.createDataFrame([("a", "x" * 2048), ("b", "y" * 2049), ("c", ""), ("d", None)], "id string, text string")
    got = {(r.id, r.start_offset, r.end_offset, r.total_chunks) for r in rag.chunk_windows(df).collect()}
    assert got == {("a-0", 0, 2048, 1), ("b-0", 0, 2048, 2), ("b-1", 1848, 2049, 2)}
    with pytest.raises(ValueError):
        rag.Chunking(max_tokens=10, overlap_tokens=10)


def test_token_chunks():
    c = rag.Chunking(max_tokens=4, overlap_tokens=1, min_tokens=2)
    got = rag.split_tokens("a b. c d e f g h", c)
    assert got == [("a b.", 2, 0, 4), ("d e f g", 4, 7, 14), ("g h", 2, 13, 16)]
    assert rag.split_tokens("   ", c) == [] and rag.split_tokens("one two", c) == [("one two", 2, 0, 7)]


def test_retrieval_table(spark):
    docs = spark.createDataFrame([("a-b", "alpha beta gamma"), ("z", "totally different words here")], "id string, text string")
    chunks = rag.ingest(docs, created_at="2025-01-01").cache()
    top = rag.search(chunks, "alpha beta gamma", 1).first()
    assert (top.id, top.doc_id) == ("a-b-0", "a-b") and top.score < 1e-6
    assert rag.search(chunks, "alpha beta gamma", 1, compat=True).first().doc_id == "a"
    assert sorted(r.doc_id for r in rag.list_docs(chunks).collect()) == ["a-b", "z"]
    assert rag.delete_doc(chunks, "a").count() == 2 and rag.delete_doc(chunks, "a", compat=True).count() == 1
    new = rag.update_doc(chunks, spark.createDataFrame([("z", "new")], "id string, text string"))
    assert [r.text for r in rag.get_doc(new, "z").collect()] == ["new"]
    assert json.loads(chunks.first().metadata)["created_at"] == "2025-01-01"


def test_text_search(spark):
    df = spark.createDataFrame([("1", "Rust is safe.", "c", '{"tag":"x1"}'), ("2", "rusty nail", "c", "{}")], "id string, text string, category string, metadata string")
    find = lambda q, **o: [r.id for r in search.search(df, q, **o).collect()]
    assert find("RUST") == ["1"] and find("rust", partial=True) == ["1", "2"] and find("rust", case_sensitive=True) == []
    assert find("x1") == ["1"] and find("x1", metadata=False) == [] and find("Rust is") == [] and find("", metadata=False) == ["1"]


def test_store(spark, tmp_path):
    store = dml.Store(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("1", "a", "c", "{}"), ("2", "b", "c", "{}"), ("1", "later", "c", '{"k":1}')], "id string, text string, category string, metadata string").coalesce(1)
    store.upsert("x", rows)
    assert {r.id: r.text for r in store.scan("x").collect()} == {"1": "later", "2": "b"}
    store.delete("x", ["2", "absent"])
    store.upsert("x", spark.createDataFrame([("1", "again")], "id string, text string"))
    assert [(r.id, r.text) for r in store.scan("x").collect()] == [("1", "again")]
    status = store.multi({"operation": "insert", "collections": ["x", "y"], "documents": [{"id": "p"}, {"id": "q"}, {"id": "r"}]})
    assert sorted((r.collection, r.id) for r in status.collect()) == [("x", "p"), ("x", "r"), ("y", "q")]
    done = store.multi({"operation": "update", "collections": ["x", "y"], "documents": [{"id": "q", "metadata": {"m": 1}}]})
    assert [(r.collection, r.id, r.status) for r in done.collect()] == [("y", "q", "updated")]
    assert store.get("y", "q").first().metadata == '{"m":1}'
    store.multi({"operation": "delete", "collections": ["x"], "documents": [{"id": "p"}]})
    assert sorted(r.id for r in store.scan("x").collect()) == ["1", "r"]
    store.drop_collection("x")
    assert store.scan("x").count() == 0 and store.scan("y").count() == 1
    with pytest.raises(dml.OperationError):
        store.multi({"operation": "insert", "collections": []})
    events = cdc.run_now(cdc.subscribe(cdc.feed(spark, store.path), ["y"], ["x:absent"]), "feed_test", checkpoint=str(tmp_path / "ck"))
    got = sorted((r.event_type, r.collection, r.id) for r in events.collect())
    assert got == [("delete", "x", "absent"), ("insert", "y", "q"), ("update", "y", "q")]
    assert all(r.data is None for r in events.collect() if r.event_type == "delete")


def test_subscriptions(spark):
    events = spark.createDataFrame([("insert", "p", "1"), ("insert", "o", "2")], "event_type string, collection string, id string")
    assert cdc.subscribe(events).count() == 2
    table = spark.createDataFrame([("s", "collection", "p"), ("s", "document", "p:1"), ("t", "all", "")], "subscriber string, kind string, key string")
    got = sorted((r.subscriber, r.id) for r in cdc.subscribe_by(events, table).collect())
    assert got == [("s", "1"), ("t", "1"), ("t", "2")]


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"level":"INFO","session_id":"a","message":"m"}\n\n{bad\n{"level":"warn","sessionId":"a"}\n{"fields":{"session":"a"},"username":"u"}\n{"user":"u","session":5}\n')
    entries = logs.read(spark, str(path))
    assert entries.count() == 4
    assert logs.by_session(entries, "a").count() == 3 and logs.by_session(entries, "a", compat=True).count() == 2
    assert logs.by_user(entries, "u").count() == 2 and logs.by_level(entries, "WARN").count() == 1


def test_catalog(spark):
    c = catalog.Catalog.empty(spark).create_user({"id": "u", "username": "u"})
    with pytest.raises(catalog.CatalogError):
        c.create_user({"id": "u"})
    c = c.put("tenants", {"id": "t", "name": "T", "owner": "u"}).put("environments", {"id": "e", "name": "E", "tenant": "t"}).put("collections", {"id": "c", "name": "C", "environment": "e"})
    assert [r.id for r in c.list_environments("t").collect()] == ["e"] and [r.id for r in c.list_collections("e").collect()] == ["c"]
    assert c.drop_collection("e", "c").list_collections("e").count() == 0
    with pytest.raises(catalog.CatalogError):
        c.list_environments("none")
    c = c.put("sessions", {"id": "s", "username": "u", "started": 1, "seen": 1, "active": True}).touch("s", 9).end("s")
    assert c.get("sessions", "s").first().seen == 9 and not c.get("sessions", "s").first().active and c.expire(10).sessions.count() == 0


def test_sql_view(spark):
    docs = D.sample(spark)
    assert sqlapi.sql(spark, 'SELECT "id" FROM docs WHERE category = \'strings\'', docs).count() == 3
    assert sqlapi.sql(spark, "SELECT count(*) AS n FROM docs", docs, compat=True).count() == 0
    assert sqlapi.sql(spark, "SELECT id FROM docs", docs.limit(0), compat=True).first().value == ""
    assert sqlapi.sql(spark, "SELECT id FROM docs", docs.limit(0)).count() == 0
    other = docs.limit(3)
    assert sqlapi.sql(spark, "SELECT id FROM few RIGHT SEMI JOIN docs ON few.id = docs.id", docs, few=other).count() == 3


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"documents":[{"id":"1","text":"t","metadata":{"a":1}},{"id":"2","vector":[1,2]}]}')
    (tmp_path / "b.json").write_text('[{"id":"3","metadata_json":"{bad"}]')
    a = {r.id: r for r in D.read_json(spark, str(tmp_path / "a.json")).collect()}
    assert a["1"].metadata == '{"a":1}' and a["2"].vector == [1.0, 2.0] and a["2"].metadata == "{}"
    assert D.read_json(spark, str(tmp_path / "b.json")).first().metadata == "{}"
    (tmp_path / "n.txt").write_text("whole\ntext")
    r = D.read_text(spark, str(tmp_path / "n.txt")).first()
    assert (r.id, r.text) == ("n", "whole\ntext") and r.source.endswith("n.txt")


def test_subscription_messages(spark):
    rows = [
        ("a", 1, '{"action":"subscribe","collection":"x"}'),
        ("a", 2, '{"action":"subscribe","collection":"x","id":"1"}'),
        ("a", 3, '{"action":"unsubscribe","collection":"x"}'),
        ("b", 1, '{"action":"subscribe","collection":"x"}'),
        ("b", 2, '{"action":"unsubscribe","collection":"x"}'),
        ("c", 1, "not json"),
        ("c", 2, '{"action":"shout","collection":"x"}'),
        ("c", 3, '{"action":"subscribe","collection":5}'),
        ("d", 1, '{"action":"subscribe","collection":"y","id":7}'),
        ("d", 2, None),
    ]
    got = cdc.subscriptions(spark.createDataFrame(rows, "subscriber string, at long, message string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "document", "x:1"), ("b", "all", ""), ("c", "all", ""), ("d", "collection", "y")]


def test_compaction(spark, tmp_path):
    store = dml.Store(spark, str(tmp_path / "store"), cached=1)
    store.compact("x")  # nothing there yet
    store.insert("x", spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string"))
    store.insert("y", spark.createDataFrame([("1", "other")], "id string, text string"))
    store.update("x", spark.createDataFrame([("1", "c")], "id string, text string"))
    store.delete("x", ["2"])
    assert store.get_cached("x", "1")[1] is False
    assert store.get_cached("x", "1")[1] is True
    assert store.get_cached("y", "1")[1] is False
    assert store.get_cached("x", "1")[1] is False  # one collection is kept
    store.compact("x")
    store.compact("x")
    assert [(r.id, r.text, r.emit) for r in store.log().where("collection = 'x'").collect()] == [("1", "c", False)]
    assert store.scan("y").first().text == "other"
    store.delete("x", ["1"])
    assert store.scan("x").isEmpty() and store.get_cached("x", "1")[0].isEmpty()
    store.compact("x")
    assert store.log().where("collection = 'x'").isEmpty()


def test_arrow_streams(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "b", None)], "a long, b string, c array<double>")
    assert sorted(map(tuple, arrow.from_ipc(arrow.to_ipc(df), df.schema).collect())) == [(1, None, [1.5]), (2, "b", None)]
    assert arrow.from_ipc(arrow.to_ipc(df.limit(0)), df.schema).isEmpty()


def test_session_notes(spark):
    empty = catalog.Catalog.empty(spark)
    assert empty.notes("s").isEmpty()
    c = empty.put("sessions", {"id": "s", "username": "u", "started": 1, "seen": 1, "active": True})
    c = c.note(spark.createDataFrame([("s", "Info", "m", 2), ("s", "error", "n", 1), (None, "info", "o", 3), ("t", "info", "p", 4)], "session string, level string, message string, at long"))
    assert [r.message for r in c.notes("s").collect()] == ["n", "m"]
    assert [r.message for r in c.notes("s", "INFO").collect()] == ["m"]
    assert {r.message for r in c.clear_notes("s").session_log.collect()} == {"o", "p"}
    assert {r.message for r in c.clean_notes().session_log.collect()} == {"m", "n"}
