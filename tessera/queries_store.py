"""Registered queries over what is written first: the store, files of documents and logs, the catalog, and retrieval tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml, logs, rag
from tessera.operators.catalog import Catalog
from tessera.plans.compile import Engine
from tessera.queries import _log_lines, _LOGS_SQL, agg, pipeline, query
from tessera.sources import arrow, documents
from tessera.sources.documents import Tables
from tessera.streaming import cdc


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all nodes share; a local session without one takes a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera-{what}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["customer"].df.select("id", "text", "category", "vector", F.to_json("metadata").alias("metadata"))


def _filled(spark: SparkSession, sf_dir: str) -> dml.Store:
    """A store with all customers, by market segment."""
    store = dml.Store(spark, scratch(spark, "store"))
    docs = _customers(spark, sf_dir)
    store.insert("customers", docs)
    store.insert("archive", docs.where("category = 'BUILDING'"))
    return store


_C = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS text, c_mktsegment AS category FROM customer"


@query(_C)
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).scan("customers").select("id", "text", "category")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS text, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS category FROM customer")
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.update("customers", _customers(spark, sf_dir).where("id % 3 = 0").withColumn("category", F.lit("changed")))
    return store.scan("customers").select("id", "text", "category")


@query(f"{_C} WHERE c_custkey NOT IN (1, 5, 9)")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.delete("customers", ["1", "5", "9", "no such"])
    return store.scan("customers").select("id", "text", "category")


@query("SELECT 'customers' AS collection, count(*) AS n FROM customer")
def store_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.drop_collection("archive")
    return store.all().groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_C} WHERE c_custkey = 7")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).get("customers", "7").select("id", "text", "category")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'vector' AS category, '' AS text, CAST(len(embedding) AS INT) AS size FROM embeddings")
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = dml.Store(spark, scratch(spark, "store"))
    store.insert_vectors("vectors", Tables(spark, sf_dir)["embeddings"].df.select("id", "vector"))
    return store.scan("vectors").select("id", "category", "text", F.size("vector").alias("size"))


@query("SELECT step, hit, n FROM (VALUES (1, false, 1), (2, true, 1), (3, false, 0)) AS t(step, hit, n)")
def store_get_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document read anew, from the kept snapshot, and after it was deleted."""
    store = _filled(spark, sf_dir)
    rows = []
    for step in (1, 2, 3):
        if step == 3:
            store.delete("customers", ["7"])
        found, hit = store.get_cached("customers", "7")
        rows.append((step, hit, found.count()))
    store.forget()
    return spark.createDataFrame(rows, "step int, hit boolean, n long")


@query(f"SELECT id, text, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'changed' ELSE category END AS category, 1 AS rows FROM ({_C}) WHERE id <> '4'")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was compacted has each document once."""
    store = _filled(spark, sf_dir)
    store.update("customers", _customers(spark, sf_dir).where("id % 3 = 0").withColumn("category", F.lit("changed")))
    store.delete("customers", ["4"])
    store.compact("customers")
    rows = store.log().where("collection = 'customers'").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    return store.scan("customers").join(rows, "id", "full").select("id", "text", "category", "rows")


@query(_C)
def sink_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as Arrow streams, read back."""
    docs = _customers(spark, sf_dir).select("id", "text", "category")
    return arrow.from_ipc(arrow.to_ipc(docs), docs.schema)


@query("""WITH m AS (SELECT concat('s', user_id % 50) AS subscriber, event_id AS t, CASE WHEN event_id % 7 = 0 THEN 'ping' WHEN event_id % 3 = 0 THEN 'unsubscribe' ELSE 'subscribe' END AS action,
    CASE WHEN event_id % 2 = 0 THEN 'collection' ELSE 'document' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat(event_type, ':', user_id % 4) END AS key FROM events),
h AS (SELECT subscriber, kind, key FROM m WHERE action <> 'ping' GROUP BY ALL HAVING max_by(action, t) = 'subscribe')
SELECT * FROM h UNION ALL SELECT DISTINCT subscriber, 'all', '' FROM m WHERE subscriber NOT IN (SELECT subscriber FROM h)""")
def cdc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions that messages made of the events leave."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = lambda c, n: F.pmod(F.col(c), F.lit(n))
    action = F.when(number("event_id", 7) == 0, "ping").when(number("event_id", 3) == 0, "unsubscribe").otherwise("subscribe")
    one = F.when(number("event_id", 2) != 0, number("user_id", 4).cast("string"))
    message = F.to_json(F.struct(action.alias("action"), F.col("event_type").alias("collection"), one.alias("id")))
    return cdc.subscriptions(e.select(F.concat(F.lit("s"), number("user_id", 50)).alias("subscriber"), F.col("event_id").alias("at"), message.alias("message")))


_SEGMENT = "(SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"SELECT collection, event_type, count(*) AS n FROM (SELECT 'customers' AS collection, 'insert' AS event_type FROM customer UNION ALL SELECT 'archive', 'insert' FROM {_SEGMENT} UNION ALL SELECT 'customers', 'update' FROM {_SEGMENT} UNION ALL SELECT 'customers', 'delete' FROM range(3)) GROUP BY ALL")
def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates and deletes make events; dropping a collection makes none."""
    store = _filled(spark, sf_dir)
    store.update("customers", store.scan("archive"))
    store.delete("customers", ["1", "2", "3"])
    store.drop_collection("archive")
    return cdc.events_of(store.log()).groupBy("collection", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'customers' AS collection, id, text, CASE WHEN id = '2' THEN 'changed' ELSE category END AS category FROM ({_C}) WHERE id <> '4' UNION ALL SELECT 'archive', id, text, CASE WHEN id = '2' THEN 'changed' ELSE category END FROM ({_C}) WHERE category = 'BUILDING' AND id <> '4' UNION ALL SELECT 'customers', 'a', 'first', '' UNION ALL SELECT 'archive', 'b', 'second', ''")
def store_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert round-robin, update and delete over two collections."""
    store = _filled(spark, sf_dir)
    names = ["customers", "archive"]
    store.multi({"operation": "insert", "collections": names, "documents": [{"id": "a", "text": "first"}, {"id": "b", "text": "second"}]})
    store.multi({"operation": "update", "collections": names, "documents": [{"id": "2", "category": "changed"}, {"id": "no such"}]})
    store.multi({"operation": "delete", "collections": names, "documents": [{"id": "4"}]})
    return store.all().select("collection", "id", "text", "category")


# -- files


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS text, 'nation' AS category, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as one JSON file of documents, read back."""
    nations = Tables(spark, sf_dir)["nation"].df
    docs = nations.select(F.struct("id", "text", F.lit("nation").alias("category"), F.struct("metadata.n_regionkey").alias("metadata")).alias("d"))
    path = scratch(spark, "json")
    docs.agg(F.to_json(F.struct(F.collect_list("d").alias("documents"))).alias("value")).write.text(path)
    return documents.read_json(spark, path).select("id", "text", "category", F.get_json_object("metadata", "$.n_regionkey").alias("region"))


@query("SELECT r_name AS text, 4 AS size FROM region")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names as text files, one each, read as documents with the placeholder vector."""
    names = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name", F.col("r_name").alias("value"))
    path = scratch(spark, "text")
    names.repartition("r_name").write.partitionBy("r_name").text(path)
    docs = documents.envelope(documents.read_text(spark, f"{path}/*/part-*"))
    return documents.with_placeholder(docs).select(F.btrim("text", F.lit("\n")).alias("text"), F.size("vector").alias("size"))


@query(_LOGS_SQL)
def logs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in JSON lines, broken lines among them, written and read."""
    path = scratch(spark, "log")
    _log_lines(spark, sf_dir).write.text(path)
    return logs.read(spark, path).select("target", "message")


# -- catalog: regions as tenants, nations as environments, customers as collections


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    return Catalog(
        users=spark.createDataFrame([("u", "owner", ["0", "1"])], "id string, username string, tenants array<string>"),
        tenants=read("region").select(text("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("u").alias("owner")),
        environments=read("nation").select(text("n_nationkey").alias("id"), F.col("n_name").alias("name"), text("n_regionkey").alias("tenant")),
        collections=read("customer").select(text("c_custkey").alias("id"), F.col("c_name").alias("name"), text("c_nationkey").alias("environment")),
        sessions=read("events").groupBy(text("user_id").alias("id")).agg(F.max("event_type").alias("username"), F.min("event_id").alias("started"), F.max("event_id").alias("seen"), F.lit(True).alias("active")),
    )


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def catalog_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).list_tenants("u")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'new', 'added'")
def catalog_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).put("environments", {"id": "new", "name": "added", "tenant": "2"}).list_environments("2")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_nationkey = 3 AND c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3)")
def catalog_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An environment's collections after the first was dropped."""
    catalog = _catalog(spark, sf_dir)
    first = catalog.collections.where("environment = '3'").select(F.min(F.col("id").cast("long"))).first()[0]
    return catalog.drop_collection("3", str(first)).list_collections("3")


@query("SELECT username FROM (VALUES ('owner'), ('second')) AS t(username)")
def catalog_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).create_user({"id": "v", "username": "second", "tenants": []}).users.select("username")


@query("SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id = 3 THEN 1000000000 ELSE max(event_id) END AS seen, user_id <> 5 AS active FROM events GROUP BY user_id HAVING user_id = 3 OR max(event_id) >= (SELECT max(event_id) / 2 FROM events)")
def catalog_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after one was touched, one was ended, and old ones expired."""
    catalog = _catalog(spark, sf_dir)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0]
    return catalog.touch("3", 1_000_000_000).end("5").expire(-(-last // 2)).sessions.select("id", "seen", "active")


@query("SELECT event_type AS message, event_id AS at FROM events WHERE user_id = 3 AND event_id % 5 = 1")
def catalog_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session's warnings, after another's entries were cleared and those of unknown sessions dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.pmod("event_id", F.lit(5)) == 1, "Warn").otherwise("info")
    entries = e.select(F.col("user_id").cast("string").alias("session"), level.alias("level"), F.col("event_type").alias("message"), F.col("event_id").alias("at"))
    unknown = entries.limit(1).withColumn("session", F.lit("no such"))
    catalog = _catalog(spark, sf_dir).note(entries).note(unknown).clear_notes("5").clean_notes()
    assert catalog.notes("5").isEmpty() and catalog.notes("no such").isEmpty()
    return catalog.notes("3", "WARN").select("message", "at")


# -- retrieval

_STEP = "(xor({0}, {1}::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
_OFFSET = "14695981039346656037::HUGEINT"
_TURNS = "SELECT concat(conv_id, '-', turn) AS id, row_number() OVER () AS r, text FROM conversations"
_SLOTS = f"""
c AS (SELECT id, r, i, ord(substr(text, i::BIGINT, 1)) AS c FROM t, LATERAL (SELECT unnest(range(1, length(text) + 1)) AS i)),
g AS (SELECT id, r, c, lead(c, 1) OVER w AS c2, lead(c, 2) OVER w AS c3, lead(c, 3) OVER w AS c4 FROM c WINDOW w AS (PARTITION BY r ORDER BY i)),
h1 AS (SELECT *, {_STEP.format(_OFFSET, 'c')} AS h FROM g),
h2 AS (SELECT *, {_STEP.format('h', 'c2')} AS k FROM h1),
h3 AS (SELECT *, {_STEP.format('k', 'c3')} AS l FROM h2),
h4 AS (SELECT *, {_STEP.format('l', 'c4')} AS m FROM h3),
n AS (SELECT r, h AS x FROM h4 UNION ALL SELECT r, k FROM h4 WHERE c2 IS NOT NULL UNION ALL SELECT r, l FROM h4 WHERE c3 IS NOT NULL UNION ALL SELECT r, m FROM h4 WHERE c4 IS NOT NULL),
w AS (SELECT r, unnest(regexp_extract_all(text, '\\S+')) AS word FROM t),
d AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, list_reduce(list_prepend({_OFFSET}, [('0x' || substr(x, (2 * j + 1)::BIGINT, 2))::INT::HUGEINT FOR j IN range(length(x) // 2)]), lambda p, q: {_STEP.format('p', 'q')}) AS y FROM d),
s AS (SELECT r, x % 384 AS slot, 1.0 AS v FROM n UNION ALL SELECT r, (x // 4294967296) % 384, 0.5 FROM n UNION ALL SELECT w.r, y % 384, 2.0 FROM w JOIN b USING (word)),
v AS (SELECT r, slot, sum(v)::DOUBLE AS v FROM s GROUP BY r, slot)
"""


@query(f"WITH t AS ({_TURNS}), {_SLOTS} SELECT t.id, v.slot::BIGINT AS slot, v.v AS value FROM v JOIN t USING (r)")
def embed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's filled slots before it is scaled."""
    v = rag.embed(rag.Embedding(normalize=False))("text")
    rows = Tables(spark, sf_dir)["conversations"].df.select("id", F.posexplode(v).alias("slot", "value"))
    return rows.where("value <> 0").select("id", F.col("slot").cast("long").alias("slot"), F.col("value").cast("double").alias("value"))


_QUESTION = "the with and of that"


@query(f"""WITH t AS ({_TURNS} WHERE length(text) <= 2048 UNION ALL SELECT NULL, 0, '{_QUESTION}'), {_SLOTS},
size AS (SELECT r, sqrt(sum(v * v)) AS size FROM v GROUP BY r),
dot AS (SELECT v.r, sum(v.v * q.v) AS dot FROM v JOIN (SELECT * FROM v WHERE r = 0) q USING (slot) WHERE v.r > 0 GROUP BY v.r),
far AS (SELECT concat(t.id, '-0') AS id, t.id AS doc_id, sqrt(2 - 2 * coalesce(dot.dot, 0) / (size.size * (SELECT size FROM size WHERE r = 0))) AS far FROM t JOIN size USING (r) LEFT JOIN dot USING (r) WHERE t.r > 0)
SELECT id, doc_id, round(far, 3) AS score FROM far ORDER BY far, id LIMIT 10""")
def rag_search_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten turns, of those that are one chunk, nearest to a question."""
    turns = Tables(spark, sf_dir)["conversations"].df.select("id", "text")
    chunks = rag.ingest(turns.where(F.length("text") <= 2048), created_at="2025-01-01T00:00:00+00:00")
    return rag.search(chunks, _QUESTION, 10).select("id", "doc_id", F.round("score", 3).alias("score"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.chunk_windows(Tables(spark, sf_dir)["documents"].df.select("id", "text"))


_CHUNK_SQL = "SELECT d.doc_id::VARCHAR AS doc_id, concat(d.doc_id, '-', i) AS id, i AS chunk_index FROM documents d, LATERAL (SELECT unnest(range(0, CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil((length(text) - 2048) / 1848.0)::BIGINT + 1 END)) AS i) WHERE length(text) > 0"
_LONGEST = "(SELECT max_by(doc_id, struct_pack(a := length(text), b := -doc_id))::VARCHAR FROM documents)"


def _longest(spark: SparkSession, sf_dir: str) -> str:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return str(docs.agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id")))).first()[0])


@query(f"SELECT id, chunk_index FROM ({_CHUNK_SQL}) WHERE doc_id = {_LONGEST}")
def rag_get_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.get_doc(_chunks(spark, sf_dir), _longest(spark, sf_dir)).select("id", "chunk_index")


@query(f"SELECT id, chunk_index FROM ({_CHUNK_SQL}) WHERE id = concat({_LONGEST}, '-1')")
def rag_get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.get_chunk(_chunks(spark, sf_dir), f"{_longest(spark, sf_dir)}-1").select("id", "chunk_index")


@query(f"SELECT id, doc_id FROM ({_CHUNK_SQL}) WHERE doc_id <> {_LONGEST}")
def rag_delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.delete_doc(_chunks(spark, sf_dir), _longest(spark, sf_dir)).select("id", "doc_id")


@query("SELECT concat(conv_id, '-', turn, '-0') AS id, CASE WHEN role = 'user' THEN 'asked anew' ELSE substr(text, 1, 2048) END AS text FROM conversations WHERE length(text) > 0 AND (role = 'user' OR length(text) <= 2048)")
def rag_update_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, those of users replaced; only documents of one chunk are returned."""
    turns = Tables(spark, sf_dir)["conversations"].df
    stamp = {"created_at": "2025-01-01T00:00:00+00:00"}
    chunks = rag.ingest(turns.select("id", "text"), **stamp)
    new = turns.where("category = 'user' and length(text) > 0").select("id", F.lit("asked anew").alias("text"))
    return rag.update_doc(chunks, new, **stamp).where("total_chunks = 1").select("id", "text")


# -- pipelines

pipeline("project_nothing", "region", [{"project": {"include": [], "exclude": []}}], {"id": "id", "text": "text"}, "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS text FROM region")
pipeline("group_no_field", "orders", [{"group": {"by": ["category"], "aggregations": [agg("sum", "s"), agg("max", "m"), agg("count", "n")]}}], {"status": "_id.category", "s": "s", "m": "m", "n": "n"}, "SELECT o_orderstatus AS status, 0.0::DOUBLE AS s, 0.0::DOUBLE AS m, count(*) AS n FROM orders GROUP BY 1")
pipeline("search_many_words", "documents", [{"search": {"query": "the and", "include_metadata": False}}], {"id": "id"}, "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE false")
pipeline("search_nothing_partial", "region", [{"search": {"query": "", "partial_match": True}}], {"id": "id"}, "SELECT CAST(r_regionkey AS VARCHAR) AS id FROM region")
_DOWN = [{"sort": [{"field": "metadata.o_totalprice", "order": "desc"}]}, {"skip": 100}]
pipeline("skip_alone", "orders", _DOWN, {"id": "id"}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) OFFSET 100")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS order_id FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def join_full_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"from": "orders", "local_field": "metadata.c_custkey", "foreign_field": "metadata.o_custkey", "as": "o", "join_type": "full"}
    return Engine(Tables(spark, sf_dir)).run("customer", [{"join": spec}]).frame().select("id", F.col("`o.id`").alias("order_id"))
