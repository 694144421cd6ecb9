"""The registered queries of the engine itself, each with its DuckDB twin.

Queries run over whole tables; limits appear only where they are the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml, logs, rag, search, sqlapi, vector
from tessera.plans.compile import Engine, Rows, quoted
from tessera.sources.documents import Tables
from tessera.streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def pipeline(name: str, collection: str, spec: list, columns: dict[str, str], sql: str) -> None:
    """Register an aggregation pipeline; ``columns`` maps output names to paths of the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine(Tables(spark, sf_dir)).run(collection, spec)
        df = rows.frame()
        return df.select(*(rows.value(path).column.alias(out) if not rows.value(path).is_json else rows.value(path).text().alias(out) for out, path in columns.items()))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def match(*filters: tuple, logic: str = "and") -> dict:
    return {"match": {"logic": logic, "filters": [{"field": f, "op": op, "value": v} for f, op, v in filters]}}


def agg(op: str, name: str, field: str | None = None) -> dict:
    return {"op": op, "as": name} | ({"field": field} if field else {})


ORDER = {"id": "id", "status": "category", "total": "metadata.o_totalprice"}
ORDER_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_totalprice AS total FROM orders"

# -- predicates

for _op, _sym in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    pipeline(f"match_{_op}", "orders", [match(("metadata.o_totalprice", _op, 150000))], ORDER, f"{ORDER_SQL} WHERE o_totalprice {_sym} 150000")
pipeline("match_eq", "orders", [match(("category", "eq", "F"))], ORDER, f"{ORDER_SQL} WHERE o_orderstatus = 'F'")
pipeline("match_ne", "orders", [match(("category", "ne", "F"))], ORDER, f"{ORDER_SQL} WHERE o_orderstatus <> 'F'")
pipeline("match_in", "orders", [match(("category", "in", ["O", "P", 3]))], ORDER, f"{ORDER_SQL} WHERE o_orderstatus IN ('O', 'P')")
pipeline("match_and_range", "orders", [match(("metadata.o_totalprice", "gte", 100000), ("metadata.o_totalprice", "lte", 200000), ("category", "eq", "O"))], ORDER, f"{ORDER_SQL} WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'O'")
pipeline("match_or", "orders", [match(("metadata.o_totalprice", "gt", 300000), ("category", "eq", "P"), logic="or")], ORDER, f"{ORDER_SQL} WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
pipeline("match_empty_or", "orders", [match(logic="or")], ORDER, f"{ORDER_SQL} WHERE false")
pipeline("match_missing", "orders", [match(("metadata.nothing", "ne", 1))], ORDER, f"{ORDER_SQL} WHERE false")
pipeline("match_cross_kind", "orders", [match(("category", "lt", 5))], ORDER, ORDER_SQL)  # every string sorts below every number
pipeline("match_contains", "customer", [match(("text", "contains", "0001"))], {"id": "id", "name": "text"}, "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE contains(c_name, '0001')")
pipeline("match_json_gt", "events", [match(("metadata.props.k", "gt", 50))], {"id": "id", "user_id": "metadata.user_id"}, "SELECT CAST(event_id AS VARCHAR) AS id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
pipeline("match_json_eq", "events", [match(("metadata.props.k", "eq", 7))], {"id": "id"}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE json_extract_string(props, '$.k') = '7'")
pipeline("match_json_in", "events", [match(("metadata.props.k", "in", [1, 2, "3", 5.5]))], {"id": "id"}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2')")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def match_contains_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir)["documents"]
    rows = Rows(docs.df.withColumn("metadata", F.struct(F.split("text", " ", -1).alias("words"))), frozenset())
    return Engine({"d": rows}).run("d", [match(("metadata.words", "contains", "the"))]).frame().select("id")


# -- order, limits, projections

pipeline("sort_limit", "lineitem", [{"sort": [{"field": "metadata.l_extendedprice", "order": "desc"}]}, {"limit": 20}], {"id": "id", "price": "metadata.l_extendedprice"}, "SELECT concat(l_orderkey, '-', l_linenumber) AS id, l_extendedprice AS price FROM lineitem ORDER BY l_extendedprice DESC, concat(l_orderkey, '-', l_linenumber) LIMIT 20")
pipeline("sort_multi", "orders", [{"sort": [{"field": "category"}, {"field": "metadata.o_totalprice", "order": "desc"}]}, {"limit": 50}], ORDER, f"{ORDER_SQL} ORDER BY o_orderstatus, o_totalprice DESC, id LIMIT 50")
pipeline("limit_by_id", "customer", [{"limit": 10}], {"id": "id"}, "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY id LIMIT 10")
pipeline("limit_skip", "customer", [{"skip": 5}, {"limit": 10}], {"id": "id"}, "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY id LIMIT 10 OFFSET 5")
pipeline("sort_json", "events", [{"sort": [{"field": "metadata.props.k", "order": "desc"}]}, {"limit": 25}], {"id": "id", "k": "metadata.props.k"}, "SELECT CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS k FROM events ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, id LIMIT 25")
pipeline("project_include", "orders", [{"project": {"include": ["id", "metadata.o_custkey", "metadata.absent"], "exclude": ["id"]}}], {"id": "id", "custkey": "metadata.o_custkey"}, "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS custkey FROM orders")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS category, c_nationkey, c_custkey, '' AS rest FROM customer")
def project_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(Tables(spark, sf_dir)).run("customer", [{"project": {"exclude": ["text", "metadata.c_acctbal", "vector", "_source_collection", "no.such"]}}])
    df = rows.frame()
    rest = ",".join(sorted(set(df.columns) - {"id", "category", "metadata"}) + sorted(set(df.schema["metadata"].dataType.names) - {"c_nationkey", "c_custkey"}))
    return df.select("id", "category", "metadata.c_nationkey", "metadata.c_custkey", F.lit(rest).alias("rest"))


# -- groups

pipeline("group_count", "orders", [{"group": {"by": ["category"], "aggregations": [agg("count", "n")]}}], {"status": "_id.category", "n": "n"}, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")


def _rounded(name: str, collection: str, spec: list, columns: dict[str, str], rounded: dict[str, int], sql: str) -> None:
    pipeline(name, collection, spec, columns, sql)
    base = QUERIES[name]
    QUERIES[name] = lambda spark, sf_dir: base(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in rounded.items()})


_rounded("group_stats", "lineitem", [{"group": {"by": ["category"], "aggregations": [agg("count", "n"), agg("sum", "total", "metadata.l_extendedprice"), agg("avg", "mean", "metadata.l_quantity"), agg("min", "low", "metadata.l_discount"), agg("max", "high", "metadata.l_tax"), agg("sum", "nothing", "text")]}}], {"flag": "_id.category", "n": "n", "total": "total", "mean": "mean", "low": "low", "high": "high", "nothing": "nothing"}, {"total": 2, "mean": 6}, "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_discount) AS low, max(l_tax) AS high, 0.0::DOUBLE AS nothing FROM lineitem GROUP BY 1")
_rounded("group_multi", "lineitem", [{"group": {"by": ["category", "metadata.l_linestatus"], "aggregations": [agg("count", "n"), agg("sum", "total", "metadata.l_quantity")]}}], {"flag": "_id.category", "status": "_id.metadata.l_linestatus", "n": "n", "total": "total"}, {"total": 2}, "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2")
_rounded("group_empty_by", "orders", [{"group": {"by": [], "aggregations": [agg("count", "n"), agg("avg", "mean", "metadata.o_totalprice")]}}], {"n": "n", "mean": "mean"}, {"mean": 4}, "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
pipeline("group_no_rows", "orders", [match(("category", "eq", "none")), {"group": {"by": [], "aggregations": [agg("count", "n")]}}], {"n": "n"}, "SELECT count(*) AS n FROM orders WHERE false HAVING count(*) > 0")
pipeline("group_json", "events", [{"group": {"by": ["metadata.props.k"], "aggregations": [agg("count", "n")]}}], {"k": "_id.metadata.props.k", "n": "n"}, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
_rounded("group_having", "orders", [{"group": {"by": ["metadata.o_custkey"], "aggregations": [agg("count", "n"), agg("sum", "total", "metadata.o_totalprice")]}}, match(("n", "gte", 15))], {"custkey": "_id.metadata.o_custkey", "n": "n", "total": "total"}, {"total": 2}, "SELECT o_custkey AS custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) >= 15")
_rounded("analytics_pipeline", "lineitem", [match(("category", "eq", "R")), {"group": {"by": ["metadata.l_linestatus"], "aggregations": [agg("sum", "revenue", "metadata.l_extendedprice"), agg("avg", "mean", "metadata.l_extendedprice"), agg("count", "n")]}}, {"sort": [{"field": "revenue", "order": "desc"}]}, {"limit": 3}], {"status": "_id.metadata.l_linestatus", "revenue": "revenue", "mean": "mean", "n": "n"}, {"revenue": 2, "mean": 4}, "SELECT l_linestatus AS status, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY sum(l_extendedprice) DESC LIMIT 3")

# -- search

_HAY = "lower(text)"
_TOKENS = "list_contains(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]'), '{1}')"
pipeline("search_token", "documents", [{"search": {"query": "The", "include_metadata": False}}], {"id": "id"}, f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {_TOKENS.format(_HAY, 'the')}")
pipeline("search_case", "documents", [{"search": {"query": "The", "include_metadata": False, "case_sensitive": True}}], {"id": "id"}, f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {_TOKENS.format('text', 'The')}")
pipeline("search_partial", "documents", [{"search": {"query": "Tion", "partial_match": True, "include_metadata": False}}], {"id": "id"}, f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains({_HAY}, 'tion')")
pipeline("search_metadata", "documents", [{"search": {"query": "src3"}}], {"id": "id"}, "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src3' OR list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]'), 'src3')")
pipeline("search_restarts", "conversations", [match(("category", "eq", "nobody")), {"search": {"query": "user", "partial_match": True}}], {"id": "id"}, "SELECT concat(conv_id, '-', turn) AS id FROM conversations WHERE contains(lower(text), 'user') OR contains(lower(role), 'user')")

# -- joins

_CUSTOMER_ORDERS = {"from": "orders", "local_field": "metadata.c_custkey", "foreign_field": "metadata.o_custkey", "as": "o"}


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(Tables(spark, sf_dir)).run("customer", [{"lookup": _CUSTOMER_ORDERS}]).frame()
    return df.select("id", F.size("o").cast("bigint").alias("n"), F.round(F.aggregate("o", F.lit(0.0), lambda s, x: s + x["metadata"]["o_totalprice"]), 2).alias("total"))


def _join(how: str, sql_how: str) -> None:
    spec = [{"join": _CUSTOMER_ORDERS | {"join_type": how}}]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(Tables(spark, sf_dir)).run("customer", [match(("category", "eq", "BUILDING")), *spec]).frame()
        # rows of the foreign side without a partner come bare: their own id, no o.id
        return df.select("id", quoted("o.id").alias("order_id"), "category")

    QUERIES[f"join_{how}"] = run
    ORACLE_SQL[f"join_{how}"] = sql_how


_PAIRS = "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS order_id, c_mktsegment AS category FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') {} JOIN orders ON c_custkey = o_custkey"
_BARE = "SELECT CAST(o_orderkey AS VARCHAR) AS id, NULL::VARCHAR AS order_id, o_orderstatus AS category FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
_join("inner", _PAIRS.format("INNER"))
_join("left", _PAIRS.format("LEFT"))
_join("right", f"{_PAIRS.format('INNER')} UNION ALL {_BARE}")
_join("full", f"{_PAIRS.format('LEFT')} UNION ALL {_BARE}")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def join_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [{"join": {"from": "region", "local_field": "metadata.n_regionkey", "foreign_field": "metadata.r_regionkey", "as": "r", "join_type": "inner"}}, match(("r.text", "ne", "ASIA"))]
    return Engine(Tables(spark, sf_dir)).run("nation", spec).frame().select("id", quoted("r.text").alias("region"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, 'region' AS source FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'nation' FROM nation UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(Tables(spark, sf_dir)).run("region", [{"union": {"collections": ["nation", "supplier", "unknown"]}}]).frame().select("id", F.col("_source_collection").alias("source"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, NULL::VARCHAR AS source FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), NULL, 'region' FROM region")
def cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"source": "nation", "stages": [{"lookup": {"from": "supplier", "local_field": "metadata.n_nationkey", "foreign_field": "metadata.s_nationkey", "as": "s"}}, {"union": {"collections": ["region"]}}]}
    df = Engine(Tables(spark, sf_dir)).run_cross(spec).frame()
    return df.select("id", F.when(F.col("s").isNotNull(), F.size("s")).cast("bigint").alias("suppliers"), F.col("_source_collection").alias("source"))


# -- SQL

def _sql(name: str, collection: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: sqlapi.sql(spark, text, Tables(spark, sf_dir)[collection].df)
    ORACLE_SQL[name] = oracle


_DOCS = "WITH docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS category, o_orderpriority AS text, o_totalprice AS total, o_custkey AS cust FROM orders) "
_M = "metadata.o_totalprice"
_sql("sql_filter", "orders", f"SELECT id, category FROM docs WHERE category = 'F' AND {_M} > 100000", _DOCS + "SELECT id, category FROM docs WHERE category = 'F' AND total > 100000")
_sql("sql_agg", "orders", f"SELECT category, count(*) AS n, round(sum({_M}), 2) AS total, round(stddev_samp({_M}), 4) AS sd, bool_or({_M} > 300000) AS large FROM docs GROUP BY category HAVING count(*) > 1", _DOCS + "SELECT category, count(*) AS n, round(sum(total), 2) AS total, round(stddev_samp(total), 4) AS sd, bool_or(total > 300000) AS large FROM docs GROUP BY category HAVING count(*) > 1")
_sql("sql_window", "orders", f"SELECT id, row_number() OVER w AS rn, rank() OVER (PARTITION BY category ORDER BY text) AS rk, lag(id) OVER w AS before, ntile(4) OVER w AS quarter, round(sum({_M}) OVER (PARTITION BY category ORDER BY {_M}, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three FROM docs WINDOW w AS (PARTITION BY category ORDER BY {_M}, id)", _DOCS + "SELECT id, row_number() OVER w AS rn, rank() OVER (PARTITION BY category ORDER BY text) AS rk, lag(id) OVER w AS before, ntile(4) OVER w AS quarter, round(sum(total) OVER (PARTITION BY category ORDER BY total, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three FROM docs WINDOW w AS (PARTITION BY category ORDER BY total, id)")
_sql("sql_setops", "orders", "SELECT text FROM docs WHERE category = 'F' INTERSECT SELECT text FROM docs WHERE category = 'O' UNION SELECT category FROM docs EXCEPT SELECT 'P'", _DOCS + "SELECT text FROM docs WHERE category = 'F' INTERSECT SELECT text FROM docs WHERE category = 'O' UNION SELECT category FROM docs EXCEPT SELECT 'P'")
_sql("sql_grouping_sets", "orders", "SELECT category, text, grouping(category) AS g, count(*) AS n FROM docs GROUP BY GROUPING SETS ((category, text), (category), ())", _DOCS + "SELECT category, text, CAST(grouping(category) AS TINYINT) AS g, count(*) AS n FROM docs GROUP BY GROUPING SETS ((category, text), (category), ())")
_sql("sql_cube", "orders", "SELECT category, text, count(*) AS n FROM docs GROUP BY CUBE (category, text)", _DOCS + "SELECT category, text, count(*) AS n FROM docs GROUP BY CUBE (category, text)")
_sql("sql_semi_anti", "orders", f"SELECT id FROM docs a WHERE {_M} > 200000 AND EXISTS (SELECT 1 FROM docs b WHERE b.category = 'P' AND b.metadata.o_custkey = a.metadata.o_custkey) AND a.metadata.o_custkey NOT IN (SELECT metadata.o_custkey FROM docs WHERE category = 'F' AND {_M} > 400000)", _DOCS + "SELECT id FROM docs a WHERE total > 200000 AND EXISTS (SELECT 1 FROM docs b WHERE b.category = 'P' AND b.cust = a.cust) AND a.cust NOT IN (SELECT cust FROM docs WHERE category = 'F' AND total > 400000)")
_sql("sql_qualify", "orders", f"SELECT id, category FROM docs QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_M} DESC, id) <= 3", _DOCS + "SELECT id, category FROM docs QUALIFY row_number() OVER (PARTITION BY category ORDER BY total DESC, id) <= 3")
_sql("sql_distinct_on", "orders", "SELECT DISTINCT ON (category) id, category FROM docs ORDER BY category, id", _DOCS + "SELECT DISTINCT ON (category) id, category FROM docs ORDER BY category, id")
_sql("sql_quoted", "orders", 'SELECT "id" AS "i d" FROM docs WHERE "category" = \'P\'', _DOCS + "SELECT id AS \"i d\" FROM docs WHERE category = 'P'")
_sql("sql_functions", "orders", "SELECT id, strpos(text, '-') AS p, ends_with(text, 'W') AS e, gcd(CAST(id AS BIGINT), 12) AS g, lcm(CAST(id AS BIGINT), 6) AS l, upper(text) AS u, coalesce(nullif(category, 'O'), 'none') AS c, lpad(id, 8, '0') AS pad FROM docs", _DOCS + "SELECT id, CAST(strpos(text, '-') AS INT) AS p, suffix(text, 'W') AS e, gcd(CAST(id AS BIGINT), 12) AS g, lcm(CAST(id AS BIGINT), 6) AS l, upper(text) AS u, coalesce(nullif(category, 'O'), 'none') AS c, lpad(id, 8, '0') AS pad FROM docs")
_sql("sql_recursive", "nation", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n, (SELECT count(*) FROM docs WHERE metadata.n_nationkey < n) AS below FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n, (SELECT count(*) FROM nation WHERE n_nationkey < n) AS below FROM t")
_sql("sql_similar", "orders", "SELECT id FROM docs WHERE text SIMILAR TO '%(HIGH|URGENT)'", _DOCS + "SELECT id FROM docs WHERE text SIMILAR TO '.*(HIGH|URGENT)'")
_sql("sql_percentile", "orders", f"SELECT category, median({_M}) AS mid, corr({_M}, metadata.o_custkey) IS NOT NULL AS c, count(DISTINCT metadata.o_custkey) AS d FROM docs GROUP BY category", _DOCS + "SELECT category, median(total) AS mid, corr(total, cust) IS NOT NULL AS c, count(DISTINCT cust) AS d FROM docs GROUP BY category")

# -- vectors

_PROBE = [((i * 37) % 19 - 9) / 30 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x!r}::FLOAT" for x in _PROBE) + "]"
_DISTANCE = f"sqrt(list_sum([pow(embedding[i]::DOUBLE - ({_PROBE_SQL})[i]::DOUBLE, 2) for i in range(1, 65)]))"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round({_DISTANCE}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE}, id LIMIT 10")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(Tables(spark, sf_dir)["embeddings"].df, _PROBE, 10).withColumn("distance", F.round("distance", 6))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS category, round({_DISTANCE}, 6) AS distance FROM embeddings WHERE label IN (1, 3) ORDER BY {_DISTANCE}, id LIMIT 5")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vector.hybrid(Tables(spark, sf_dir)["embeddings"].df, _PROBE, 5, "category IN ('1', '3')")
    return df.select("id", "category", F.round("distance", 6).alias("distance"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE label = 2 ORDER BY id LIMIT 5")
def hybrid_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.hybrid(Tables(spark, sf_dir)["embeddings"].df, _PROBE, 5, "category = '2'", compat=True).select("id")


@query("SELECT query_id, CAST(vec_id AS VARCHAR) AS id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(list_sum([pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2) for i in range(1, 65)])), CAST(e.vec_id AS VARCHAR)) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 5")
def knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir)["embeddings"].df
    queries = e.where("id % 100 = 0").select(F.col("id").cast("bigint").alias("query_id"), "vector")
    return vector.knn_many(e, queries, 5).select("query_id", "id", "rank")


# -- retrieval


@query("SELECT d.doc_id::VARCHAR AS doc_id, i AS chunk_index, md5(substr(text, (i * 1848 + 1)::BIGINT, 2048)) AS digest, ((least(i * 1848 + 2048, length(text)) - i * 1848) // 4)::BIGINT AS token_count, CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil((length(text) - 2048) / 1848.0)::BIGINT + 1 END AS total_chunks FROM documents d, LATERAL (SELECT unnest(range(0, CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil((length(text) - 2048) / 1848.0)::BIGINT + 1 END)) AS i) WHERE length(text) > 0")
def chunk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = rag.chunk_windows(Tables(spark, sf_dir)["documents"].df.select("id", "text"))
    return chunks.select("doc_id", "chunk_index", F.md5("text").alias("digest"), "token_count", "total_chunks")


_TOKEN_CHUNKS_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS d, text, regexp_extract_all(text, '\S+') AS words, regexp_split_to_array(text, '\S+') AS gaps FROM documents WHERE text IS NOT NULL),
p AS (SELECT d, unnest(range(0, len(words))) AS i, unnest(words) AS w, unnest(gaps[: len(words)]) AS g FROM t),
s AS (SELECT d, i, sum(length(g) + length(w)) OVER (PARTITION BY d ORDER BY i) AS stop, length(w) AS n FROM p),
e AS (SELECT d, list(stop - n ORDER BY i) AS a, list(stop ORDER BY i) AS b FROM s GROUP BY d),
k AS (SELECT t.d, t.text, len(words) AS total, e.a, e.b, unnest(range(0, CASE WHEN len(words) <= 512 THEN 1 ELSE ceil((len(words) - 512) / 462.0)::BIGINT + 1 END)) AS k FROM t JOIN e USING (d)),
x AS (SELECT d, k, text, total <= 512 AS whole, 462 * k + 512 >= total AS last, a[462 * k + 1]::BIGINT AS lo, CASE WHEN 462 * k + 512 >= total THEN length(text) ELSE b[462 * k + 512] END::BIGINT AS hi, total FROM k),
y AS (SELECT d, k, last, total, CASE WHEN whole THEN 0 ELSE lo END AS lo, CASE WHEN whole THEN length(text) ELSE hi END AS hi, CASE WHEN whole THEN text ELSE substr(text, lo + 1, hi - lo) END AS piece FROM x),
z AS (SELECT d, k, last, lo, hi, CASE WHEN last OR NOT regexp_matches(piece, '[.!?\n]') THEN piece ELSE regexp_extract(piece, '^(?s:.*)[.!?\n]') END AS piece FROM y),
f AS (SELECT d, k, last, lo, CASE WHEN last THEN hi ELSE lo + length(piece) END AS hi, len(regexp_extract_all(piece, '\S+')) AS n FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY d) AS c FROM f WHERE n >= 50 OR last)
SELECT concat(d, '-', i) AS id, d AS doc_id, n::BIGINT AS token_count, lo::BIGINT AS start_offset, hi::BIGINT AS end_offset, c AS total_chunks FROM r
"""


@query(_TOKEN_CHUNKS_SQL)
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.chunk_tokens(Tables(spark, sf_dir)["documents"].df.select("id", "text")).select("id", "doc_id", "token_count", "start_offset", "end_offset", "total_chunks")


@query("SELECT concat(conv_id, '-', turn) AS id, 384::INT AS dimension, CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM conversations")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rag.embed()("text")
    return Tables(spark, sf_dir)["conversations"].df.select("id", v.alias("v")).select("id", F.size("v").alias("dimension"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


@query()
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = rag.ingest(Tables(spark, sf_dir)["documents"].df.select("id", "text", F.lit("table").alias("source")), created_at="2025-01-01T00:00:00+00:00")
    return rag.search(chunks, "the with and of that", 10).select("id", "doc_id", F.round("score", 5).alias("score"))


@query("SELECT DISTINCT conv_id::VARCHAR AS doc_id FROM conversations WHERE length(text) > 0")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir)["conversations"].df.select(F.col("metadata.conv_id").cast("string").alias("id"), "text")
    return rag.list_docs(rag.chunk_windows(docs))


# -- changes


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a change log: user is the document, kind the operation."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.pmod("event_id", F.lit(7)) == 0, "delete").when(F.pmod("event_id", F.lit(3)) == 0, "insert").otherwise("update")
    return events.select(F.col("user_id").cast("string").alias("id"), op.alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("batch"), F.col("event_id").alias("place"), F.col("event_type").alias("text"), F.lit("c").alias("category"), F.array().cast("array<float>").alias("vector"), F.col("props").alias("metadata"), F.lit(True).alias("emit"), F.col("event_type").alias("collection"))


_LOG_SQL = "WITH log AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS collection, CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'insert' ELSE 'update' END AS op, epoch_us(ts) AS batch, event_id AS place, props FROM events) "


@query(_LOG_SQL + "SELECT collection, id, props AS metadata FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY batch DESC, place DESC) AS rn FROM log) WHERE rn = 1 AND op <> 'delete'")
def cdc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.snapshot(_change_log(spark, sf_dir)).select("collection", "id", "metadata")


@query(_LOG_SQL + "SELECT op AS event_type, collection, id, count(*) AS n FROM log WHERE collection = 'click' OR concat(collection, ':', id) IN ('view:1', 'purchase:2') GROUP BY ALL")
def cdc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cdc.events_of(_change_log(spark, sf_dir))
    return cdc.subscribe(events, ["click"], ["view:1", "purchase:2"]).groupBy("event_type", "collection", "id").agg(F.count(F.lit(1)).alias("n"))


def _events_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.with_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def cdc_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.tumbling(_events_at(spark, sf_dir), "1 day", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def cdc_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.sliding(_events_at(spark, sf_dir), "2 hours", "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k")
def cdc_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.sessions(_events_at(spark, sf_dir), "12 hours", "user_id").select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL")
def cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling count once more, as a stream over the table's files with a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parq*")
    out = cdc.run_now(cdc.tumbling(cdc.with_time(stream, "ts"), "1 day", late="1 day"), "tessera_cdc_stream", mode="complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).getFileStatus(target).isDirectory()


_SPEC = [{"id": "1", "text": "new text"}, {"id": "2", "category": "changed", "metadata": {"a": 1}}, {"id": "no such"}, {"id": "3"}]


@query("SELECT * FROM (VALUES ('a', '1', 'new text', '{}'), ('b', '2', '', '{\"a\":1}'), ('a', 'no such', '', '{}'), ('b', '3', '', '{}')) AS t(collection, id, text, metadata)")
def cross_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    op, names, docs = dml.parse_operation({"operation": "insert", "collections": ["a", "b"], "documents": _SPEC})
    return dml.round_robin(dml.documents_frame(spark, docs), names).select("collection", "id", "text", "metadata")


@query("SELECT 'customer' AS collection, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 1 THEN 'new text' ELSE c_name END AS text, CASE WHEN c_custkey = 2 THEN 'changed' ELSE c_mktsegment END AS category FROM customer WHERE c_custkey IN (1, 2, 3)")
def cross_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir)["customer"].df
    current = docs.select(F.lit("customer").alias("collection"), "id", "text", "category", "vector", F.to_json("metadata").alias("metadata"))
    pairs = dml.documents_frame(spark, _SPEC).withColumn("collection", F.explode(F.array(F.lit("customer"), F.lit("other"))))
    return dml.updated(current, pairs).select("collection", "id", "text", "category")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def cross_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = Tables(spark, sf_dir)["customer"].df
    return current.join(dml.documents_frame(spark, _SPEC).select("id"), "id", "left_anti").select("id")


# -- logs: the events table written as JSON lines in memory


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.pmod("event_id", F.lit(5)) == 0, "ERROR").when(F.pmod("event_id", F.lit(5)) == 1, "warn").otherwise("INFO")
    line = F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("message"), F.concat(F.lit("u"), "user_id").alias("user"), F.struct(F.concat(F.lit("s"), F.pmod("user_id", F.lit(10))).alias("sessionId")).alias("fields"), F.col("event_id").cast("string").alias("target")))
    return e.select(F.when(F.pmod("event_id", F.lit(11)) == 0, "{broken").otherwise(line).alias("value"))


_LOGS_SQL = "SELECT CAST(event_id AS VARCHAR) AS target, event_type AS message FROM events WHERE event_id % 11 <> 0"


@query(f"{_LOGS_SQL} AND event_id % 5 = 1")
def logs_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.by_level(logs.parse(_log_lines(spark, sf_dir)), "WARN").select("target", "message")


@query(f"{_LOGS_SQL} AND user_id % 10 = 3")
def logs_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.by_session(logs.parse(_log_lines(spark, sf_dir)), "s3").select("target", "message")


@query(f"{_LOGS_SQL} AND user_id = 7")
def logs_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.by_user(logs.parse(_log_lines(spark, sf_dir)), "u7").select("target", "message")


from tessera import queries_sql, queries_store  # noqa: E402, F401  (they register theirs here)
