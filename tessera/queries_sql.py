"""Registered SQL queries: aggregates, windows, joins, set operations, clauses and function families, each with its DuckDB twin."""

from __future__ import annotations

from tessera.queries import _DOCS, _M, ORACLE_SQL, QUERIES, _sql
from tessera.operators import sqlapi
from tessera.sources.documents import Tables


def same(name: str, text: str) -> None:
    """A query over orders whose text both engines take: ``total`` and ``cust`` stand for the metadata's fields."""
    _sql(name, "orders", text.replace("total_", _M).replace("cust_", "metadata.o_custkey"), _DOCS + text.replace("total_", "total").replace("cust_", "cust"))


def differing(name: str, text: str, oracle: str) -> None:
    _sql(name, "orders", text.replace("total_", _M).replace("cust_", "metadata.o_custkey"), _DOCS + oracle.replace("total_", "total").replace("cust_", "cust"))


# -- aggregates

same("sql_agg_moments", "SELECT category, round(var_samp(total_) / 1e6, 4) AS vs, round(var_pop(total_) / 1e6, 4) AS vp, round(stddev_pop(total_), 4) AS sp, round(stddev(total_), 4) AS sd, round(covar_samp(total_, cust_) / 1e3, 3) AS cs, round(covar_pop(total_, cust_) / 1e3, 3) AS cp, round(corr(total_, cust_), 6) AS co FROM docs GROUP BY category")
differing("sql_agg_other_names", "SELECT category, round(var(total_) / 1e6, 4) AS v, round(var_population(total_) / 1e6, 4) AS vp, round(covar(total_, cust_) / 1e3, 3) AS c, round(approx_median(total_), 2) AS m, round(approx_percentile_cont(total_, 0.25), 2) AS q FROM docs GROUP BY category", "SELECT category, round(var_samp(total_) / 1e6, 4) AS v, round(var_pop(total_) / 1e6, 4) AS vp, round(covar_samp(total_, cust_) / 1e3, 3) AS c, round(median(total_), 2) AS m, round(quantile_cont(total_, 0.25), 2) AS q FROM docs GROUP BY category")
differing("sql_agg_approx_distinct", "SELECT category, abs(approx_distinct(cust_) - count(DISTINCT cust_)) <= 0.2 * count(DISTINCT cust_) AS near FROM docs GROUP BY category", "SELECT category, true AS near FROM docs GROUP BY category")
same("sql_agg_regression", "SELECT category, round(regr_slope(total_, cust_), 6) AS s, round(regr_intercept(total_, cust_), 3) AS i, round(regr_r2(total_, cust_), 8) AS r, regr_count(total_, cust_) AS n, round(regr_avgx(total_, cust_), 4) AS ax, round(regr_avgy(total_, cust_), 4) AS ay FROM docs GROUP BY category")
same("sql_agg_bits", "SELECT category, bit_and(cust_) AS a, bit_or(cust_) AS o, bit_xor(cust_) AS x, bool_and(total_ > 0) AS ba, bool_or(total_ > 400000) AS bo FROM docs GROUP BY category")
differing("sql_agg_lists", "SELECT category, array_join(array_sort(array_agg(DISTINCT text)), ',') AS texts, count(*) FILTER (WHERE total_ > 200000) AS large, sum(DISTINCT cust_) AS custs FROM docs GROUP BY category", "SELECT category, array_to_string(list_sort(array_agg(DISTINCT text)), ',') AS texts, count(*) FILTER (WHERE total_ > 200000) AS large, sum(DISTINCT cust_)::BIGINT AS custs FROM docs GROUP BY category")
differing("sql_agg_string", "SELECT category, string_agg(DISTINCT text, ';') WITHIN GROUP (ORDER BY text) AS texts FROM docs GROUP BY category", "SELECT category, string_agg(DISTINCT text, ';' ORDER BY text) AS texts FROM docs GROUP BY category")
same("sql_rollup", "SELECT category, text, count(*) AS n FROM docs GROUP BY ROLLUP (category, text)")

# -- windows

same("sql_window_ranks", "SELECT id, dense_rank() OVER w AS d, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c, rank() OVER w AS r FROM docs WINDOW w AS (PARTITION BY category ORDER BY text)")
same("sql_window_values", "SELECT id, lead(id, 2) OVER w AS after, lag(id, 1, 'none') OVER w AS before, first_value(id) OVER w AS first, last_value(id) OVER (PARTITION BY category ORDER BY total_, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(id, 2) OVER (PARTITION BY category ORDER BY total_, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM docs WINDOW w AS (PARTITION BY category ORDER BY total_, id)")
same("sql_window_range", "SELECT id, count(*) OVER (PARTITION BY category ORDER BY cust_ RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, count(*) OVER (PARTITION BY category ORDER BY cust_) AS upto FROM docs")

# -- joins; customer is a second frame

_CUST = "cust AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer), "
_ORD = "WITH " + _CUST + _DOCS.removeprefix("WITH ").replace("cust FROM", "cust, CAST(o_custkey AS VARCHAR) AS buyer FROM")


def joined(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        tables = Tables(spark, sf_dir)
        docs = tables["orders"].df
        cust = tables["customer"].df.selectExpr("id", "category AS segment", "metadata.c_nationkey AS nation")
        orders = docs.selectExpr("id", "category", "text", "metadata.o_totalprice AS total", "cast(metadata.o_custkey AS string) AS buyer")
        return sqlapi.sql(spark, text, docs, cust=cust, o=orders)

    QUERIES[name] = run
    ORACLE_SQL[name] = _ORD + (oracle or text).replace(" o ", " docs o ")


joined("sql_join_natural", "SELECT id, segment, total FROM (SELECT buyer AS id, total FROM o ) NATURAL JOIN cust")
joined("sql_join_using", "SELECT id, segment, n FROM (SELECT buyer AS id, count(*) AS n FROM o GROUP BY buyer) FULL JOIN cust USING (id)")
joined("sql_join_theta", "SELECT a.id, b.id AS other FROM cust a JOIN cust b ON a.nation < b.nation AND a.segment = b.segment AND CAST(a.id AS BIGINT) + 1 = CAST(b.id AS BIGINT)")
joined("sql_join_lateral", "SELECT c.id, x.best FROM cust c, LATERAL (SELECT max(total) AS best FROM o WHERE buyer = c.id) x")
joined("sql_join_right", "SELECT o.id AS oid, c.id AS cid FROM o RIGHT JOIN cust c ON o.buyer = c.id AND o.category = 'P'", "SELECT d.id AS oid, c.id AS cid FROM docs d RIGHT JOIN cust c ON d.buyer = c.id AND d.category = 'P'")
joined("sql_join_cross", "SELECT a.segment, b.category FROM (SELECT DISTINCT segment FROM cust) a CROSS JOIN (SELECT DISTINCT category FROM o ) b")
joined("sql_right_semi", "SELECT c.id FROM o d RIGHT SEMI JOIN cust c ON d.buyer = c.id", "SELECT c.id FROM cust c WHERE c.id IN (SELECT buyer FROM docs)")
joined("sql_right_anti", "SELECT c.id FROM o d RIGHT ANTI JOIN cust c ON d.buyer = c.id", "SELECT c.id FROM cust c WHERE c.id NOT IN (SELECT buyer FROM docs)")

# -- set operations and clauses

same("sql_setops_all", "(SELECT text FROM docs WHERE category = 'F' INTERSECT ALL SELECT text FROM docs WHERE category = 'P') UNION ALL (SELECT text FROM docs WHERE category = 'O' EXCEPT ALL SELECT text FROM docs WHERE category = 'F')")
same("sql_case", "SELECT id, CASE category WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state, CASE WHEN total_ > 300000 THEN 2 WHEN total_ > 100000 THEN 1 ELSE 0 END AS size, greatest(total_, 200000.5) AS g, least(total_, 200000.5) AS l, nullif(category, 'P') AS np, coalesce(nullif(category, 'P'), 'x') AS cp FROM docs")
same("sql_order_nulls", "SELECT id, nullif(category, 'O') AS c FROM docs ORDER BY c DESC NULLS LAST, id LIMIT 40")
same("sql_subqueries", "SELECT id, total_ > (SELECT avg(total_) FROM docs) AS above, (SELECT count(*) FROM docs b WHERE b.category = a.category) AS n FROM docs a WHERE cust_ IN (SELECT cust_ FROM docs WHERE category = 'P')")
same("sql_ctes", "SELECT * FROM (WITH a AS (SELECT category, count(*) AS n FROM docs GROUP BY category), b AS (SELECT max(n) AS most FROM a) SELECT a.category, a.n = b.most AS top FROM a, b) t")
same("sql_limit_offset", "SELECT id FROM docs ORDER BY total_ DESC, id LIMIT 10 OFFSET 7")
differing("sql_except_columns", "SELECT * EXCEPT (vector, embedding, metadata, text) FROM docs", "SELECT id, category FROM docs")
same("sql_values", "SELECT d.category, v.name FROM (SELECT DISTINCT category FROM docs) d JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'part')) AS v(k, name) ON v.k = d.category")
same("sql_distinct_on_limit", "SELECT DISTINCT ON (category, text) coalesce(id, 'none') AS first, category, text FROM docs ORDER BY category, text, total_ DESC, id LIMIT 9")

# -- functions

same("sql_math", "SELECT id, abs(-total_) AS a, ceil(total_) AS c, floor(total_) AS f, round(sqrt(total_), 6) AS s, round(cbrt(total_), 6) AS cb, round(ln(total_), 8) AS l, round(log10(total_), 8) AS l10, round(log2(total_), 8) AS l2, round(exp(total_ / 1e6), 8) AS e, sign(total_) AS sg, round(power(total_, 0.3), 6) AS p, round(sin(total_), 6) AS sn, round(cos(total_), 6) AS cn, round(atan2(total_, 3), 8) AS at, round(degrees(1.5), 6) AS dg, round(radians(90), 8) AS rd, round(pi(), 8) AS pi, factorial(5) AS fa FROM docs".replace("ceil(total_)", "CAST(ceil(total_) AS BIGINT)").replace("floor(total_)", "CAST(floor(total_) AS BIGINT)").replace("sign(total_)", "CAST(sign(total_) AS INT)").replace("factorial(5)", "CAST(factorial(5) AS BIGINT)"))
differing("sql_math_other_names", "SELECT id, trunc(total_) AS t, iszero(total_) AS z, to_hex(cust_) AS h FROM docs", "SELECT id, trunc(total_) AS t, total_ = 0 AS z, to_hex(cust_) AS h FROM docs".replace("to_hex(cust_)", "lower(to_hex(cust_))"))
same("sql_strings", "SELECT id, ascii(text) AS a, chr(65) AS c, concat(text, '-', category) AS cc, concat_ws('/', category, id) AS cw, lower(text) AS lo, ltrim(concat('  ', text)) AS lt, rtrim(concat(text, '  ')) AS rt, btrim(concat(' ', text, ' ')) AS bt, rpad(id, 9, '.') AS rp, left(text, 2) AS le, right(text, 2) AS ri, repeat(category, 3) AS re, replace(text, '-', '+') AS rs, reverse(text) AS rv, split_part(text, '-', 1) AS sp, substr(text, 3, 4) AS ss, translate(text, 'HIGH', 'high') AS tr, levenshtein(text, category) AS lv, length(text) AS ln FROM docs".replace("btrim(", "trim(").replace("length(text)", "CAST(length(text) AS BIGINT)").replace("ascii(text)", "CAST(ascii(text) AS INT)").replace("levenshtein(text, category)", "CAST(levenshtein(text, category) AS BIGINT)"))
differing("sql_regex", "SELECT id, regexp_like(text, '^[0-9]-[A-Z]') AS l, regexp_replace(text, '[A-Z]+', 'x') AS r, regexp_count(text, '[A-Z]') AS n, array_to_string(regexp_match(text, '[A-Z]+'), ',') AS m, text ILIKE '%high%' AS i, text NOT SIMILAR TO '%HIGH' AS s FROM docs", "SELECT id, regexp_matches(text, '^[0-9]-[A-Z]') AS l, regexp_replace(text, '[A-Z]+', 'x', 'g') AS r, CAST(len(regexp_extract_all(text, '[A-Z]')) AS INT) AS n, nullif(regexp_extract(text, '[A-Z]+'), '') AS m, text ILIKE '%high%' AS i, text NOT SIMILAR TO '.*HIGH' AS s FROM docs")
differing("sql_hashes", "SELECT id, md5(text) AS m, encode(sha256(text), 'hex') AS s, encode(digest(id, 'sha256'), 'hex') AS d, encode(text, 'base64') AS b FROM docs", "SELECT id, md5(text) AS m, sha256(text) AS s, sha256(id) AS d, base64(encode(text)) AS b FROM docs")
_D = "metadata.o_orderdate"
differing("sql_dates", f"SELECT id, CAST(date_part('year', {_D}) AS BIGINT) AS y, CAST(extract(MONTH FROM {_D}) AS BIGINT) AS m, date_format(date_trunc('month', {_D}), 'yyyy-MM-dd') AS t, date_format({_D} + INTERVAL '1' DAY, 'yyyy-MM-dd') AS p, date_format(date_bin(INTERVAL '7' DAY, {_D}), 'yyyy-MM-dd') AS b, to_unixtime(CAST({_D} AS TIMESTAMP)) AS u, date_format(to_timestamp_seconds(cust_), 'yyyy-MM-dd HH:mm:ss') AS s, date_format(make_date(2024, 2, 29), 'yyyy-MM-dd') AS k FROM docs", "SELECT o.id, date_part('year', x.o_orderdate) AS y, date_part('month', x.o_orderdate) AS m, strftime(date_trunc('month', x.o_orderdate), '%Y-%m-%d') AS t, strftime(x.o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS p, strftime(time_bucket(INTERVAL 7 DAY, x.o_orderdate, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS b, CAST(epoch(x.o_orderdate) AS BIGINT) AS u, strftime(make_timestamp(x.o_custkey * 1000000), '%Y-%m-%d %H:%M:%S') AS s, '2024-02-29' AS k FROM docs o JOIN orders x ON o.id = CAST(x.o_orderkey AS VARCHAR)")
differing("sql_arrays", "SELECT id, array_length(string_to_array(text, '-')) AS n, array_has(make_array(category, 'F'), 'F') AS h, array_to_string(array_slice(generate_series(1, 5), 2, 4), ',') AS s, array_element(string_to_array(text, '-'), 1) AS e, array_to_string(array_reverse(make_array(category, id)), '|') AS r, array_position(make_array('F', 'O', 'P'), category) AS p, array_has_all(make_array('F', 'O'), make_array(category)) AS a, array_to_string(array_pop_front(make_array(category, id, text)), ',') AS f, array_to_string(array_concat(make_array(category), make_array(id)), ',') AS c, array_to_string(array_distinct(make_array(category, category)), ',') AS d, array_empty(array_remove_all(make_array(category), category)) AS em FROM docs", "SELECT id, CAST(len(string_split(text, '-')) AS INT) AS n, list_contains([category, 'F'], 'F') AS h, '2,3,4' AS s, string_split(text, '-')[1] AS e, array_to_string(list_reverse([category, id]), '|') AS r, CAST(list_position(['F', 'O', 'P'], category) AS BIGINT) AS p, list_has_all(['F', 'O'], [category]) AS a, concat(id, ',', text) AS f, concat(category, ',', id) AS c, category AS d, true AS em FROM docs")
differing("sql_structs_maps", "SELECT id, named_struct('a', category, 'b', cust_).b AS b, element_at(make_map('k', category, 'l', text), 'l') AS l, array_to_string(array_sort(map_keys(make_map('k', 1, 'j', 2))), ',') AS ks, arrow_cast(id, 'Int64') AS i, arrow_typeof(arrow_cast(id, 'Float64')) AS t FROM docs", "SELECT id, cust_ AS b, text AS l, 'j,k' AS ks, CAST(id AS BIGINT) AS i, 'double' AS t FROM docs")
