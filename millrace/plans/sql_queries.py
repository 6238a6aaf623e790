"""SQL steps over one table named `input`: (name, table, query). The same text runs in Spark, through the step, and in DuckDB."""

STEPS: list[tuple[str, str, str]] = [
    ("sql_filter_derive", "events", "SELECT event_id, event_type, value, value * 1.21 AS value_gross, ts, props FROM input WHERE event_type <> 'error'"),
    ("sql_string_normalize", "documents", "SELECT doc_id, lower(trim(lang)) AS lang, upper(source) AS source, length(text) AS n FROM input WHERE text IS NOT NULL AND length(text) > 20"),
    ("sql_date_trunc_length", "events", "SELECT event_id, date_trunc('hour', ts) AS hour, length(event_type) AS n FROM input"),
    ("sql_cast_matrix", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_partkey AS DOUBLE) AS p, CAST(l_suppkey AS VARCHAR) AS s, CAST(l_linenumber AS DOUBLE) / 100.0 AS cents FROM input"),
    ("sql_case_coalesce", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0.0 THEN 'debt' WHEN c_acctbal < 5000.0 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_custkey, 10) AS g, least(c_custkey, 10) AS l FROM input"),
    ("sql_groupby_having", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM input GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"),
    ("sql_filter_aggregate", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) AS customers, bool_or(o_totalprice > 100000.0) AS large FROM input GROUP BY o_orderpriority"),
    ("sql_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS total FROM input GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ("sql_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM input GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("sql_grouping_sets", "customer", "SELECT coalesce(c_nationkey, -1) AS nation, c_mktsegment, count(*) AS n FROM input GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())"),
    ("sql_statistics", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cv, median(l_quantity) AS m FROM input GROUP BY l_returnflag"),
    ("sql_bit_aggregates", "part", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM input GROUP BY p_brand"),
    ("sql_distinct", "customer", "SELECT DISTINCT c_nationkey, c_mktsegment FROM input"),
    ("sql_window_rank", "orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter FROM input WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("sql_window_share", "orders", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM input WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)"),
    ("sql_window_frame", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS prev, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS next, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM input"),
    ("sql_window_range", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM input"),
    ("sql_self_join", "nation", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM input a JOIN input b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    ("sql_left_join", "orders", "SELECT a.o_orderkey, coalesce(b.o_orderkey, -1) AS later FROM input a LEFT JOIN input b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1"),
    ("sql_full_join", "supplier", "SELECT coalesce(a.s_suppkey, -1) AS a_key, coalesce(b.s_suppkey, -1) AS b_key FROM (SELECT * FROM input WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT * FROM input WHERE s_suppkey % 3 = 0) b ON a.s_suppkey = b.s_suppkey"),
    ("sql_semi_anti", "orders", "SELECT o_orderkey FROM input o WHERE EXISTS (SELECT 1 FROM input p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM input p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'P')"),
    ("sql_range_join", "region", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM input a JOIN input b ON b.r_regionkey BETWEEN a.r_regionkey AND a.r_regionkey + 1"),
    ("sql_using_join", "supplier", "SELECT s_suppkey, x.s_name AS name FROM input x JOIN (SELECT s_suppkey FROM input WHERE s_acctbal > 0.0) y USING (s_suppkey)"),
    ("sql_set_ops", "part", "(SELECT p_brand FROM input WHERE p_size > 10 UNION SELECT p_type FROM input WHERE p_size < 5) EXCEPT (SELECT p_brand FROM input WHERE p_size > 49 INTERSECT SELECT p_brand FROM input WHERE p_size < 2)"),
    ("sql_union_all", "region", "SELECT r_name FROM input UNION ALL SELECT r_name FROM input WHERE r_regionkey > 1"),
    ("sql_topk", "orders", "SELECT o_orderkey, o_totalprice FROM input ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5"),
    ("sql_cte_subquery", "lineitem", "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM input GROUP BY l_orderkey) SELECT l_orderkey, q FROM big WHERE q > (SELECT avg(q) FROM big)"),
    ("sql_in_subquery", "lineitem", "SELECT l_orderkey, l_linenumber FROM input WHERE l_partkey IN (SELECT l_partkey FROM input WHERE l_discount > 0.09) AND l_returnflag IN ('A', 'R')"),
    ("sql_values", "region", "SELECT r_name, v.label FROM input JOIN (VALUES (0, 'zero'), (1, 'one')) AS v(k, label) ON v.k = r_regionkey"),
    ("sql_predicates", "part", "SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_name ILIKE '%A%' AS any_a, p_size BETWEEN 5 AND 10 AS mid, p_brand IS NOT DISTINCT FROM p_type AS same FROM input"),
    ("sql_string_functions", "customer", "SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS c, replace(c_mktsegment, 'A', '_') AS r, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, reverse(c_name) AS v, substr(c_name, 2, 3) AS s, strpos(c_name, '0') AS i, md5(c_name) AS m, ltrim(rtrim(c_name)) AS t, repeat('x', 2) AS x, left(c_name, 3) AS l, right(c_name, 3) AS e, split_part(c_name, '#', 1) AS h FROM input"),
    ("sql_regex", "customer", "SELECT c_custkey, regexp_replace(c_mktsegment, '[AEIOU]', '_') AS first_vowel, regexp_replace(c_mktsegment, '[AEIOU]', '_', 'g') AS all_vowels, regexp_replace(c_mktsegment, '([A-Z])([A-Z])', '\\2\\1') AS turned, regexp_matches(c_mktsegment, '^[A-F]') AS early FROM input"),
    ("sql_math", "part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice / 10.0) AS BIGINT) AS c, CAST(floor(p_retailprice / 10.0) AS BIGINT) AS f, round(p_retailprice / 7.0, 2) AS r, power(p_size, 2) AS w, round(sqrt(p_size), 9) AS q, round(ln(p_size), 9) AS n, p_size % 7 AS m FROM input WHERE p_size > 0"),
    ("sql_dates", "orders", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, date_trunc('month', o_orderdate) AS month, o_orderdate + INTERVAL '1' DAY AS tomorrow FROM input"),
    ("sql_unnest_series", "region", "SELECT r_regionkey, i, r_regionkey * 10 + i AS n FROM input, generate_series(1, 4) AS t(i) WHERE i > r_regionkey"),
    ("sql_unnest_lists", "nation", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey, 7]) AS v FROM input"),
    ("sql_lists", "nation", "SELECT n_nationkey, [n_regionkey, 5, 9][2] AS second, list_contains([1, 2, 3], n_regionkey) AS has, array_to_string(list_sort(list_distinct([n_name, 'B', 'B'])), '|') AS joined FROM input"),
    ("sql_ordered_aggregates", "nation", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_to_string(array_agg(n_name ORDER BY n_nationkey), '|') AS listed, first(n_name ORDER BY n_nationkey) AS lowest, last(n_name ORDER BY n_nationkey) AS highest, arg_max(n_name, n_nationkey) AS top FROM input GROUP BY n_regionkey"),
    ("sql_approximate", "orders", "SELECT o_orderstatus, approx_count_distinct(o_custkey) BETWEEN count(DISTINCT o_custkey) * 0.8 AND count(DISTINCT o_custkey) * 1.2 AS near, count(DISTINCT o_custkey) AS exact FROM input GROUP BY o_orderstatus"),
    ("sql_quantiles", "lineitem", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9 FROM input GROUP BY l_returnflag"),
    ("sql_regressions", "lineitem", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS base, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, regr_count(l_tax, l_quantity) AS n FROM input GROUP BY l_returnflag"),
    ("sql_bool_aggregates", "orders", "SELECT o_orderpriority, bool_and(o_totalprice > 0.0) AS every_one, bool_or(o_orderstatus = 'P') AS some, min(o_orderstatus) AS least FROM input GROUP BY o_orderpriority"),
    ("sql_qualify", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM input WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    ("sql_qualify_alias", "orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM input QUALIFY r < 4"),
    ("sql_distinct_on", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM input ORDER BY o_custkey, o_orderkey DESC"),
    ("sql_natural_join", "supplier", "SELECT s_suppkey, s_name, big FROM input NATURAL JOIN (SELECT s_suppkey, s_acctbal > 5000.0 AS big FROM input) q"),
    ("sql_not_in", "part", "SELECT p_partkey FROM input WHERE p_size NOT IN (SELECT p_size FROM input WHERE p_retailprice > 1500.0)"),
    ("sql_cross_join", "region", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM input a CROSS JOIN input b"),
    ("sql_right_join", "supplier", "SELECT coalesce(a.s_suppkey, -1) AS a_key, b.s_suppkey AS b_key FROM (SELECT * FROM input WHERE s_acctbal > 0.0) a RIGHT JOIN input b ON a.s_suppkey = b.s_suppkey + 1"),
    ("sql_window_values", "events", "SELECT event_id, last_value(event_id) OVER w AS last_id, nth_value(event_id, 2) OVER w AS second_id FROM input WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("sql_json_props", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS none FROM input"),
    ("sql_more_strings", "customer", "SELECT c_custkey, ascii(c_name) AS a, chr(65) AS c, starts_with(c_mktsegment, 'B') AS b, levenshtein(c_mktsegment, 'BUILDING') AS d, translate(c_name, '0', 'o') AS t, position('0' IN c_name) AS p, bit_length(c_name) AS bits, concat_ws('-', c_mktsegment, c_name) AS j, rpad(c_mktsegment, 12, '.') AS r, trim(BOTH 'C' FROM c_name) AS m FROM input"),
    ("sql_trigonometry", "part", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(atan2(p_size, 3.0), 9) AS a, round(degrees(radians(p_size)), 6) AS d, CAST(sign(p_size - 25) AS INTEGER) AS g, round(exp(p_size / 50.0), 9) AS e, round(log10(p_size + 1), 9) AS l, round(cbrt(p_size), 9) AS b FROM input"),
    ("sql_make_dates", "orders", "SELECT o_orderkey, CAST(make_date(2020, 1 + CAST(o_orderkey % 12 AS INTEGER), 1) AS VARCHAR) AS d, date_part('quarter', o_orderdate) AS q, extract(dow FROM o_orderdate) >= 0 AS w, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS e FROM input"),
    ("sql_quoted_text", "region", "SELECT r_regionkey AS \"Key\", 'it''s a \\n' AS note, length('a\\nb') AS n FROM input"),
]
