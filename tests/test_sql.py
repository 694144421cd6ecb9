"""The SQL layer: what is rewritten, what is left alone, and what isn't run."""

import pytest

from tessera.operators import sqlapi
from tessera.sources.documents import DOCUMENT

ROWS = [("1", "a b", "x", [1.0], "{}"), ("2", "b c", "x", [1.0], "{}"), ("3", "c", "y", [], "{}")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENT)


def rows(spark, docs, text, **more):
    return [tuple(r) for r in sqlapi.sql(spark, text, docs, **more).collect()]


def test_literals_are_left_alone(spark, docs):
    text = "SELECT 'a similar to ''x''' AS s, 'array_has(1)' AS f, \"id\" FROM docs WHERE text SIMILAR TO '%b%' ORDER BY id -- qualify ;"
    assert rows(spark, docs, text) == [("a similar to 'x'", "array_has(1)", "1"), ("a similar to 'x'", "array_has(1)", "2")]


def test_distinct_on_with_calls_order_and_limit(spark, docs):
    assert rows(spark, docs, "SELECT DISTINCT ON (category) coalesce(id, 'x') AS a, category FROM docs ORDER BY category, id DESC") == [("2", "x"), ("3", "y")]
    assert rows(spark, docs, "SELECT DISTINCT ON (category) concat(id, ',', text) AS a FROM docs ORDER BY category DESC, id LIMIT 1") == [("3,c",)]


def test_qualify_keeps_order_and_limit(spark, docs):
    text = "SELECT id FROM docs QUALIFY row_number() OVER (PARTITION BY category ORDER BY id DESC) = 1 ORDER BY id DESC LIMIT 5"
    assert rows(spark, docs, text) == [("3",), ("2",)]


def test_names_of_other_engines(spark, docs):
    text = "SELECT array_slice(make_array(1, 2, 3, 4), 2, 3), array_positions(make_array(1, 2, 1), 1), array_pop_back(make_array(1, 2)), trunc(-2.7), arrow_cast('5', 'Int64'), regexp_match('abc', 'b.'), string_to_array('a.b', '.')"
    assert rows(spark, docs, text) == [([2, 3], [1, 3], [1], -2.0, 5, ["bc"], ["a", "b"])]
    assert rows(spark, docs, "SELECT var(x), covar(x, y), approx_median(x), approx_percentile_cont_with_weight(x, 1, 0.5) FROM (VALUES (1, 2), (2, 3), (4, 9)) t(x, y)")[0][2:] == (2.0, 2.0)


def test_queries_at_once_have_their_own_frames(spark, docs):
    other = spark.createDataFrame([("9", "z", "w", [], "{}")], DOCUMENT)
    first, second = sqlapi.sql(spark, "SELECT id FROM docs", docs), sqlapi.sql(spark, "WITH a AS (SELECT id FROM docs) SELECT * FROM a", other)
    assert first.count() == 3 and [r.id for r in second.collect()] == ["9"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]


@pytest.mark.parametrize("text", ["DROP TABLE x", "CREATE VIEW a AS SELECT 1", "SET a = b", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT 1; SELECT 2", "", "DELETE FROM docs"])
def test_only_queries_are_run(text):
    with pytest.raises(sqlapi.SqlError):
        sqlapi.rewrite(text)


def test_compat_gives_one_column_of_strings(spark, docs):
    assert rows(spark, docs, "SELECT category, id FROM docs WHERE id = '3'") == [("y", "3")]
    assert [tuple(r) for r in sqlapi.sql(spark, "SELECT category, id FROM docs WHERE id = '3'", docs, compat=True).collect()] == [("y",)]
    assert sqlapi.sql(spark, "SELECT count(*) FROM docs", docs, compat=True).count() == 0
    assert sqlapi.sql(spark, "SELECT id FROM docs", docs.limit(0), compat=True).count() == 1
