"""One query an operator, in the compat dialect over the Parquet tables, and the SQL another engine says it in."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..engine import Engine
from ..operators import frames
from ..session import shared_dir
from ..sinks import csv_lines, json_frame, line_frame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """An engine with the tables that a query names; `t` is orders."""
    e = Engine(spark)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            e.parquet(f"{sf_dir}/{name}.parquet", name)
    if re.search(r"\bt\b", sql):
        e.parquet(f"{sf_dir}/orders.parquet", "t")
    return e


def _soundex_sql(x: str) -> str:
    """The code in the oracle's SQL: letters to digits, runs to one, the first and all zeros dropped."""
    out = f"translate(regexp_replace(upper({x}), '[^A-Z]', 'A', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for d in range(7):
        out = f"regexp_replace({out}, '{d}+', '{d}', 'g')"
    return f"upper(substr({x}, 1, 1)) || rpad(substr(replace(substr({out}, 2), '0', ''), 1, 3), 3, '0')"


# name: (compat SQL, the same for the oracle; None: the same text)
SQL: dict[str, tuple[str, str | None]] = {
    # scans and sources
    "scan_parquet": ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"),
    "values_source": ("SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL))", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b)"),
    "select_without_from": ("SELECT 1 + 2 AS a, 'x' AS b", "SELECT CAST(3 AS BIGINT) AS a, 'x' AS b"),
    "subquery_in_from": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 10", None),
    "catalog_table_info": ("SELECT cid, name, type FROM pragma_table_info('region') WHERE 'region' = 'region'", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'r_regionkey', 'INTEGER'), (CAST(1 AS BIGINT), 'r_name', 'TEXT')) v(cid, name, type)"),
    # projection, filter, expressions
    "project_alias": ("SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer", None),
    "derived_round": ("SELECT p_partkey, ROUND(p_retailprice * 0.9, 2) AS discounted FROM part", "SELECT p_partkey, ROUND(p_retailprice * 0.9::DOUBLE, 2) AS discounted FROM part"),
    "filter_numeric": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02"),
    "filter_text_affinity": ("SELECT p_partkey FROM part WHERE p_size = '5' OR CAST(p_size AS TEXT) > 45", "SELECT p_partkey FROM part WHERE p_size = 5 OR CAST(p_size AS VARCHAR) > '45'"),
    "filter_date_text_range": ("SELECT event_id, ts FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-20'", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-05' AND strftime(ts, '%Y-%m-%d %H:%M:%S') < '2024-01-20'"),
    "filter_missing": ("SELECT count(*) AS n FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE p = \"\" OR p IS NULL", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "between_in": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'P')", None),
    "like_ci": ("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'bUiLd%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'"),
    "like_escape": ("SELECT c_custkey FROM customer WHERE c_name || '_x' LIKE '%1!_x' ESCAPE '!'", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1'"),
    "glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]?'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].')"),
    "is_distinct": ("SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS DISTINCT FROM 1", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS DISTINCT FROM 1"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS code FROM orders"),
    "row_value_in": ("SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT 'R', 'F')", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"),
    "row_value_compare": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (100, 500)", None),
    "bitwise": ("SELECT o_orderkey & 7 AS a, o_orderkey | 8 AS b, ~o_custkey AS c, o_custkey << 2 AS d, o_orderkey >> 1 AS e FROM orders", "SELECT o_orderkey & 7 AS a, o_orderkey | 8 AS b, ~o_custkey AS c, o_custkey << 2 AS d, o_orderkey >> 1 AS e FROM orders"),
    "int_division": ("SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS r FROM orders", "SELECT o_orderkey, CAST(trunc(o_custkey / 7) AS BIGINT) AS q, CAST(trunc(-o_custkey / 7) AS BIGINT) AS r FROM orders"),
    "modulo": ("SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 7 AS n FROM orders", None),
    "div_by_zero_null": ("SELECT o_orderkey, o_custkey / (o_orderkey % 3) AS q, o_totalprice / (o_orderkey % 2) AS r FROM orders", "SELECT o_orderkey, CAST(trunc(o_custkey / nullif(o_orderkey % 3, 0)) AS BIGINT) AS q, o_totalprice / nullif(o_orderkey % 2, 0) AS r FROM orders"),
    "concat_null": ("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') || '/' || c_nationkey AS s FROM customer", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') || '/' || CAST(c_nationkey AS VARCHAR) AS s FROM customer"),
    "real_to_text": ("SELECT o_orderkey, '' || (o_orderkey / 8.0) AS s FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey // 8 AS VARCHAR) || '.0' ELSE CAST(o_orderkey / 8 AS VARCHAR) END AS s FROM orders"),
    "cast_prefix": ("SELECT CAST(substr(o_orderpriority, 1, 3) AS INTEGER) AS k, CAST('x' || o_orderpriority AS INTEGER) AS z, o_orderkey FROM orders", "SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS k, CAST(0 AS BIGINT) AS z, o_orderkey FROM orders"),
    "double_quoted_literal": ('SELECT count(*) AS n FROM orders WHERE o_orderstatus = "F"', "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "rowid_lookup": ("SELECT rowid AS id, r_name FROM region WHERE rowid <= 3", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name FROM region WHERE r_regionkey < 3"),
    "alias_in_where": ("SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders WHERE twice > 400000", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 400000"),
    "collate_compare": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "truthiness": ("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 AND NOT o_custkey % 2", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 2 = 0"),
    # joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o RIGHT JOIN customer ON o.o_custkey = c_custkey", None),
    "join_full": ("SELECT a.k AS a, b.k AS b FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT c_custkey * 2 AS k FROM customer) b ON a.k = b.k", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_natural": ("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT n_regionkey AS k, n_name AS b FROM nation)", "SELECT CAST(x.n_nationkey AS BIGINT) AS k, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey = y.n_regionkey"),
    "join_using": ("SELECT k, a, b FROM (SELECT c_custkey AS k, c_name AS a FROM customer) x LEFT JOIN (SELECT s_suppkey AS k, s_name AS b FROM supplier) y USING (k)", "SELECT c_custkey AS k, c_name AS a, s_name AS b FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"),
    "join_self_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_range": ("SELECT p_partkey, column1 AS lo FROM part JOIN (VALUES (1, 5), (10, 15), (40, 50)) ON p_size BETWEEN column1 AND column2", "SELECT p_partkey, CAST(a AS BIGINT) AS lo FROM part JOIN (VALUES (1, 5), (10, 15), (40, 50)) v(a, b) ON p_size BETWEEN a AND b"),
    "semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", None),
    "semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", None),
    "anti_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_acctbal > 1e9)", None),
    "anti_not_in_null": ("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)", None),
    "in_subquery_value": ("SELECT o_orderkey, o_custkey IN (SELECT nullif(c_custkey, 7) FROM customer WHERE c_custkey < 60) AS a, nullif(o_custkey, 10) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 60) AS b, NULL IN (SELECT c_custkey FROM customer WHERE c_custkey < 0) AS c FROM orders", "SELECT o_orderkey, CAST(o_custkey IN (SELECT nullif(c_custkey, 7) FROM customer WHERE c_custkey < 60) AS BIGINT) AS a, CAST(nullif(o_custkey, 10) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 60) AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM orders"),
    "join_multiway_tpch": (
        "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
        None,
    ),
    # aggregation
    "agg_global": ("SELECT count(*) AS n, sum(o_custkey) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS hi FROM orders"),
    "group_sum_order": ("SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS revenue FROM t GROUP BY o_orderpriority ORDER BY 2 DESC", "SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY o_orderpriority"),
    "group_expr": ("SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10", None),
    "group_alias": ("SELECT substr(o_orderdate, 1, 7) AS month, count(*) AS n FROM orders GROUP BY month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1"),
    "group_ordinal_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "having_without_group": ("SELECT count(*) AS n FROM orders HAVING count(*) > 1", None),
    "count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "sum_distinct": ("SELECT sum(DISTINCT p_size) AS s FROM part", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part"),
    "agg_total_empty": ("SELECT total(o_totalprice) AS t, sum(o_totalprice) AS s, count(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS DOUBLE) AS t, sum(o_totalprice) AS s, count(*) AS n FROM orders WHERE o_orderkey < 0"),
    "agg_filter": ("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS s FROM lineitem GROUP BY l_returnflag", None),
    "pivot_conditional": ("SELECT l_returnflag, ROUND(SUM(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS open_sum, ROUND(SUM(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END), 2) AS done_sum FROM lineitem GROUP BY l_returnflag", None),
    "group_concat_ordered": ("SELECT n_regionkey, group_concat(n_name, '/' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, '/' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "group_concat_scan_order": ("SELECT group_concat(r_name) AS names FROM region", "SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region"),
    "bare_column_max": ("SELECT o_custkey, o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "json_group_array": ("SELECT json_group_array(r_name) AS j FROM region", "SELECT '[' || string_agg('\"' || r_name || '\"', ',' ORDER BY r_regionkey) || ']' AS j FROM region"),
    "json_group_object": ("SELECT json_group_object(r_name, r_regionkey) AS j FROM region", "SELECT '{' || string_agg('\"' || r_name || '\":' || r_regionkey, ',' ORDER BY r_regionkey) || '}' AS j FROM region"),
    # windows
    "win_row_number": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", None),
    "win_rank_dense": ("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", None),
    "win_percent_cume": ("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM part", None),
    "win_ntile": ("SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part", None),
    "win_lag_lead": ("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_totalprice, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders", None),
    "win_first_last_nth": ("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "win_running_sum": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s FROM orders", None),
    "win_rows_frame": ("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders", None),
    "win_range_frame": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part", None),
    "win_groups_frame": ("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM part", "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part"),
    "win_exclude_current": ("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS s FROM part", "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM part"),
    "win_exclude_ties": ("SELECT p_partkey, max(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS m, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n FROM part", None),
    "win_filter": ("SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", None),
    "win_named": ("SELECT o_orderkey, sum(o_orderkey) OVER w AS s, count(*) OVER (w ROWS 1 PRECEDING) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 1 PRECEDING) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "win_top1_per_group": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", None),
    "win_over_aggregate": ("SELECT o_orderstatus, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_orderstatus", None),
    # order, limit, sets, recursion
    "top_n": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "order_nulls": ("SELECT k, i, row_number() OVER (ORDER BY k DESC NULLS FIRST, i) AS at FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS i FROM nation) ORDER BY k DESC NULLS FIRST, i", "SELECT CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS i, row_number() OVER (ORDER BY k DESC NULLS FIRST, i) AS at FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS i FROM nation)"),
    "order_nocase": ("SELECT x, row_number() OVER (ORDER BY x COLLATE NOCASE) AS at FROM (SELECT CASE WHEN n_nationkey % 2 THEN lower(n_name) ELSE n_name END AS x FROM nation) ORDER BY x COLLATE NOCASE", "SELECT x, row_number() OVER (ORDER BY lower(x)) AS at FROM (SELECT CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS x FROM nation)"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "distinct_order_outside": ("SELECT DISTINCT o_orderstatus AS s FROM orders ORDER BY o_orderkey", "SELECT DISTINCT o_orderstatus AS s FROM orders"),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "intersect": ("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", None),
    "except": ("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", None),
    "setop_left_assoc": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2", "(SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey + 3 FROM region) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2"),
    "setop_coercion": ("SELECT n_nationkey AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier", "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier"),
    "cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE s > 500000) SELECT count(*) AS n FROM top", None),
    "cte_recursive_all": ("WITH RECURSIVE c(x, y) AS (SELECT 1, 1 UNION ALL SELECT x + 1, y + x FROM c WHERE x < 150) SELECT x, y FROM c", "WITH RECURSIVE c(x, y) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT x + 1, y + x FROM c WHERE x < 150) SELECT x, y FROM c"),
    "cte_recursive_dedupe": ("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3 + n_nationkey) % 101 FROM r JOIN nation ON n_regionkey = k % 5) SELECT k FROM r", "WITH RECURSIVE r(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT CAST((k * 3 + n_nationkey) % 101 AS BIGINT) FROM r JOIN nation ON n_regionkey = k % 5) SELECT k FROM r"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
    "correlated_subquery": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", None),
    "join_asof_idiom": ("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last FROM customer", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') <= '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last FROM customer"),
    "exists_scalar": ("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS p, NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'Z') AS z", "SELECT CAST(1 AS BIGINT) AS p, CAST(1 AS BIGINT) AS z"),
    # scalar functions
    "fn_substr_edges": ("SELECT c_custkey, substr(c_name, 0, 3) AS a, substr(c_name, -3) AS b, substr(c_name, 4, -2) AS c, substr(c_name, 2, 4) AS d FROM customer", "SELECT c_custkey, c_name[1:2] AS a, c_name[-3:] AS b, c_name[2:3] AS c, c_name[2:5] AS d FROM customer"),
    "fn_trim_replace_instr": ("SELECT p_partkey, trim('xx' || p_name || 'x', 'x') AS t, replace(p_name, 'a', '-') AS r, instr(p_name, 'e') AS i FROM part", "SELECT p_partkey, trim('xx' || p_name || 'x', 'x') AS t, replace(p_name, 'a', '-') AS r, instr(p_name, 'e') AS i FROM part"),
    "fn_upper_lower_ascii": ("SELECT doc_id, upper(text) AS u, lower(text) AS l FROM documents", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM documents"),
    "fn_hex_unicode_char": ("SELECT n_nationkey, hex(n_name) AS h, unicode(n_name) AS u, char(65 + n_nationkey, 8364) AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, hex(n_name) AS h, CAST(unicode(n_name) AS BIGINT) AS u, chr(CAST(65 + n_nationkey AS INTEGER)) || '€' AS c FROM nation"),
    "fn_scalar_minmax_null": ("SELECT n_nationkey, max(n_nationkey, n_regionkey, 3) AS a, min(nullif(n_regionkey, 2), 3) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(greatest(n_nationkey, n_regionkey, 3) AS BIGINT) AS a, CAST(CASE WHEN n_regionkey <> 2 THEN least(n_regionkey, 3) END AS BIGINT) AS b FROM nation"),
    "fn_coalesce_iif_nullif": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, iif(o_totalprice > 100000, 'hi', 'lo') AS b, ifnull(NULL, o_custkey) AS c FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, CASE WHEN o_totalprice > 100000 THEN 'hi' ELSE 'lo' END AS b, o_custkey AS c FROM orders"),
    "fn_abs_sign_round": ("SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal) AS s, round(c_acctbal) AS r, round(c_acctbal, 1) AS q FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS s, round(c_acctbal) AS r, round(c_acctbal, 1) AS q FROM customer"),
    "fn_math": ("SELECT p_partkey, round(sqrt(p_size), 6) AS a, round(ln(p_size), 6) AS b, round(log(p_size), 6) AS c, round(pow(p_size, 2), 2) AS d, round(exp(p_size / 50.0), 6) AS e, floor(p_retailprice) AS f, ceil(p_retailprice) AS g, sqrt(-p_size) AS h FROM part", "SELECT p_partkey, round(sqrt(p_size), 6) AS a, round(ln(p_size), 6) AS b, round(log10(p_size), 6) AS c, round(pow(p_size, 2), 2) AS d, round(exp(p_size / 50.0::DOUBLE), 6) AS e, floor(p_retailprice) AS f, ceil(p_retailprice) AS g, CAST(NULL AS DOUBLE) AS h FROM part"),
    "fn_date_strftime": ("SELECT o_orderkey, date(o_orderdate) AS d, strftime('%Y/%m/%d %H:%M:%S %j %w', o_orderdate) AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %j %w') AS f FROM orders"),
    "fn_date_modifiers": ("SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS a, date(o_orderdate, '+10 days') AS b, date(o_orderdate, 'start of year') AS c, datetime(o_orderdate, '+90 minutes') AS d FROM orders", "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS b, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS c, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d FROM orders"),
    "fn_julianday_unixepoch": ("SELECT o_orderkey, round(julianday(o_orderdate), 6) AS j, unixepoch(o_orderdate) AS u FROM orders", "SELECT o_orderkey, round(CAST(epoch(o_orderdate) AS DOUBLE) / 86400 + 2440587.5::DOUBLE, 6) AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders"),
    "fn_json_extract": ("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') > 50", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "fn_json_type_length": ("SELECT event_id, json_type(props) AS a, json_type(props, '$.k') AS b, json_array_length('[1,2,' || event_id || ']') AS n FROM events", "SELECT event_id, 'object' AS a, 'integer' AS b, CAST(3 AS BIGINT) AS n FROM events"),
    "fn_json_each": ("SELECT event_id, key, json_each.value AS v FROM events, json_each(props)", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS v FROM events"),
    "fn_json_edit": ("SELECT event_id, json_set(props, '$.z', 1) AS s, json_remove(props, '$.k') AS r FROM events", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS s, '{}' AS r FROM events"),
    "fn_printf": ("SELECT o_orderkey, printf('%05d|%.2f|%s', o_custkey, o_totalprice, o_orderstatus) AS s FROM orders", "SELECT o_orderkey, printf('%05d|%.2f|%s', o_custkey, o_totalprice, o_orderstatus) AS s FROM orders"),
    "fn_typeof": ("SELECT typeof(o_orderkey) AS a, typeof(o_totalprice) AS b, typeof(o_orderstatus) AS c, typeof(nullif(o_orderstatus, 'F')) AS d, o_orderkey FROM orders", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE 'text' END AS d, o_orderkey FROM orders"),
    # rules of names, literals and comparisons
    "compare_no_affinity": ("SELECT o_orderkey, o_custkey + 0 < '' || o_custkey AS a, '' || o_custkey = o_custkey + 0 AS b FROM orders", "SELECT o_orderkey, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM orders"),
    "identifiers_quoted": ('SELECT [o_orderkey] AS "the key", `o_custkey` AS [c k] FROM "orders"', 'SELECT o_orderkey AS "the key", o_custkey AS "c k" FROM orders'),
    "output_names_verbatim": ("SELECT o_orderkey  +  1, upper(o_orderstatus) FROM orders", 'SELECT o_orderkey + 1 AS "o_orderkey  +  1", upper(o_orderstatus) AS "upper(o_orderstatus)" FROM orders'),
    "regexp": ("SELECT c_custkey FROM customer WHERE c_name REGEXP '1[0-4]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '1[0-4]$')"),
    "unary_hex_blob": ("SELECT -o_orderkey AS a, +o_custkey AS b, - -o_custkey AS c, 0x1F AS d, hex(x'0aFF') AS e FROM orders", "SELECT -o_orderkey AS a, o_custkey AS b, o_custkey AS c, CAST(31 AS BIGINT) AS d, '0AFF' AS e FROM orders"),
    "group_concat_distinct": ("SELECT group_concat(DISTINCT o_orderpriority) AS p, group_concat(DISTINCT nullif(o_orderstatus, 'F')) AS s FROM orders", "SELECT (SELECT string_agg(p, ',' ORDER BY k) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1)) AS p, (SELECT string_agg(s, ',' ORDER BY k) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)) AS s"),
    "win_exclude_real": ("SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), 4) AS s, avg(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS a FROM part", None),
    "cte_recursive_limit": ("WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 2 FROM c LIMIT 40) SELECT x FROM c", "SELECT CAST(2 * range + 1 AS BIGINT) AS x FROM range(40)"),
    "cte_recursive_ordered": ("WITH RECURSIVE r(k, d) AS (SELECT r_regionkey, 0 FROM region UNION ALL SELECT k * 2 + 1, d + 1 FROM r WHERE d < 4 ORDER BY 2 DESC) SELECT k, d FROM r", "WITH RECURSIVE r(k, d) AS (SELECT CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT) FROM region UNION ALL SELECT k * 2 + 1, d + 1 FROM r WHERE d < 4) SELECT k, d FROM r"),
    # more functions
    "fn_length_octets": ("SELECT doc_id, length(text) AS n, octet_length(text) AS b FROM documents", "SELECT doc_id, length(text) AS n, CAST(octet_length(encode(text)) AS BIGINT) AS b FROM documents"),
    "fn_concat": ("SELECT n_nationkey, concat(n_name, NULL, n_regionkey) AS a, concat_ws('-', n_name, NULL, n_regionkey) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || n_regionkey AS a, n_name || '-' || n_regionkey AS b FROM nation"),
    "fn_quote_unhex_blobs": ("SELECT n_nationkey, quote(n_name || char(39) || 's') AS a, quote(nullif(n_regionkey, 1)) AS b, CAST(unhex(hex(n_name)) AS TEXT) AS c, hex(zeroblob(n_regionkey)) AS d, length(randomblob(4)) AS e FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, chr(39) || n_name || chr(39) || chr(39) || 's' || chr(39) AS a, CASE WHEN n_regionkey = 1 THEN 'NULL' ELSE CAST(n_regionkey AS VARCHAR) END AS b, n_name AS c, repeat('00', n_regionkey) AS d, CAST(4 AS BIGINT) AS e FROM nation"),
    "fn_soundex": ("SELECT n_nationkey, soundex(n_name) AS a, soundex(n_nationkey) AS b FROM nation", f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {_soundex_sql('n_name')} AS a, '?000' AS b FROM nation"),
    "fn_like_glob_calls": ("SELECT n_nationkey, like('%A%', n_name) AS a, glob('*A*', n_name) AS b, like('%!%%', n_name || '%', '!') AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_name ILIKE '%a%' AS BIGINT) AS a, CAST(contains(n_name, 'A') AS BIGINT) AS b, CAST(1 AS BIGINT) AS c FROM nation"),
    "fn_hints_random": ("SELECT n_nationkey, likely(n_regionkey) AS a, unlikely(n_regionkey) AS b, likelihood(n_regionkey, 0.5) AS c, typeof(random()) AS d FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST(n_regionkey AS BIGINT) AS c, 'integer' AS d FROM nation"),
    "fn_status_constants": ("SELECT n_nationkey, changes() + total_changes() + last_insert_rowid() AS a, sqlite_version() > '3.3' AS b, typeof(sqlite_source_id()) AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, 'text' AS c FROM nation"),
    "fn_weekday": ("SELECT o_orderkey, date(o_orderdate, 'weekday 0') AS a, date(o_orderdate, 'weekday 3') AS b FROM orders", "SELECT o_orderkey, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS a, strftime(o_orderdate + to_days(CAST((10 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS b FROM orders"),
    "fn_unixepoch_modifiers": ("SELECT o_orderkey, datetime(o_orderkey * 86399, 'unixepoch') AS a, date(o_custkey, 'unixepoch', '+1 day') AS b, datetime(2460000.5 + o_custkey) AS c FROM orders", "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86399000000), '%Y-%m-%d %H:%M:%S') AS a, strftime(make_timestamp(o_custkey * 1000000) + INTERVAL 1 DAY, '%Y-%m-%d') AS b, strftime(TIMESTAMP '2023-02-25' + to_days(CAST(o_custkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS c FROM orders"),
    "fn_day_overflow": ("SELECT o_orderkey, date(strftime('%Y-%m-31', o_orderdate)) AS a, datetime(strftime('%Y-%m', o_orderdate) || '-30 12:00', '+1 day') AS b, date(strftime('%Y-%m-32', o_orderdate)) AS c FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 30 DAY, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate) + INTERVAL 30 DAY + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS b, CAST(NULL AS VARCHAR) AS c FROM orders"),
    "fn_timediff": ("SELECT o_orderkey, timediff(date(o_orderdate, '+3 days'), date(o_orderdate)) AS a, timediff(date(o_orderdate), datetime(date(o_orderdate), '+90 minutes')) AS b FROM orders", "SELECT o_orderkey, '+0000-00-03 00:00:00.000' AS a, '-0000-00-00 01:30:00.000' AS b FROM orders"),
    "fn_current": ("SELECT r_regionkey, current_date = date('now') AS a, length(current_time) AS b, length(current_timestamp) AS c FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(1 AS BIGINT) AS a, CAST(8 AS BIGINT) AS b, CAST(19 AS BIGINT) AS c FROM region"),
    "fn_json_arrows": ("SELECT event_id, props -> '$.k' AS a, props ->> 'k' AS b, json_array(event_id, 7) -> 1 AS c, props ->> '$.none' AS d FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b, '7' AS c, CAST(NULL AS VARCHAR) AS d FROM events"),
    "fn_json_text": ("SELECT event_id, json(' ' || props || ' ') AS a, json_valid(props) AS b, json_valid(event_type) AS c, json_quote(event_type) AS d, json_error_position(props) AS e FROM events", "SELECT event_id, replace(props, ' ', '') AS a, CAST(1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, '\"' || event_type || '\"' AS d, CAST(0 AS BIGINT) AS e FROM events"),
    "fn_json_array_object": ("SELECT event_id, json_array(event_id, event_type, NULL, value > 1e9) AS a, json_object('id', event_id, 't', event_type) AS b FROM events", "SELECT event_id, '[' || event_id || ',\"' || event_type || '\",null,0]' AS a, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS b FROM events"),
    "fn_jsonb": ("SELECT event_id, json(jsonb(props)) AS a, jsonb_extract(props, '$.k') ->> '$' AS b, json(jsonb_set(props, '$.k', 5)) AS c FROM events", "SELECT event_id, replace(props, ' ', '') AS a, json_extract_string(props, '$.k') AS b, '{\"k\":5}' AS c FROM events"),
    "fn_json_tree": ("SELECT event_id, fullkey, CAST(atom AS INTEGER) AS atom, json_tree.type AS kind FROM events, json_tree('[' || event_id || ',' || props || ']') WHERE atom IS NOT NULL", "SELECT event_id, '$[0]' AS fullkey, event_id AS atom, 'integer' AS kind FROM events UNION ALL SELECT event_id, '$[1].k', CAST(json_extract_string(props, '$.k') AS BIGINT), 'integer' FROM events"),
    "fn_json_each_array": ("SELECT event_id, CAST(key AS INTEGER) AS key, CAST(json_each.value AS INTEGER) AS v FROM events, json_each(json_array(event_id, 7, 8))", "SELECT event_id, CAST(k AS BIGINT) AS key, CASE k WHEN 0 THEN event_id WHEN 1 THEN 7 ELSE 8 END AS v FROM events, range(3) r(k)"),
    "pragma_table_info": ("PRAGMA table_info(nation)", "SELECT CAST(cid AS BIGINT) AS cid, name, type, CAST(0 AS BIGINT) AS \"notnull\", CAST(NULL AS VARCHAR) AS dflt_value, CAST(0 AS BIGINT) AS pk FROM (VALUES (0, 'n_nationkey', 'INTEGER'), (1, 'n_name', 'TEXT'), (2, 'n_regionkey', 'INTEGER')) v(cid, name, type)"),
    # statements that change data return rows and change nothing
    "delete_returning": ("DELETE FROM region WHERE r_regionkey > 2 RETURNING r_regionkey AS k, r_name", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name FROM region WHERE r_regionkey > 2"),
    "update_returning": ("UPDATE nation SET n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5 RETURNING n_nationkey AS k, n_regionkey AS r", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey + 10 AS BIGINT) AS r FROM nation WHERE n_nationkey < 5"),
    "insert_returning": ("INSERT INTO region (r_regionkey, r_name) VALUES (7, 'X'), ('8', 'Y') RETURNING r_regionkey AS k, r_name", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'X'), (CAST(8 AS BIGINT), 'Y')) v(k, r_name)"),
}


def _compat(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).sql(sql)


# -- text sources: the tables are written as delimited text by Spark and read back by the engine's own reader


def _written(spark: SparkSession, frame: DataFrame, delimiter: str) -> str:
    """A folder of delimited text in the shared place, each file with the header."""
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    frame.write.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)
    return path


def _roundtrip(table: str, columns: list[str], query: str, delimiter: str = ",", infer: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        frame = e.parquet(f"{sf_dir}/{table}.parquet").frames["t"].select(*columns)
        return Engine(spark).load(_written(spark, frame, delimiter), delimiter=delimiter, infer=infer).sql(query)

    return run


_ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_READ = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM t"
_READ_ORACLE = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws(",", "n_nationkey", "n_name", "n_name").alias("value"))
    return _text(spark, f, "k,n,n").sql("SELECT k, n, n_2 FROM t")


def _blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(F.array(F.concat_ws(",", "n_nationkey", "n_name"), F.lit(""))).alias("value"))
    return _text(spark, f, "k,n").sql("SELECT count(*) AS rows, count(k) AS keys FROM t")


def _text(spark: SparkSession, lines: DataFrame, header: str) -> Engine:
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    spark.createDataFrame([(header,)], "value string").union(lines).coalesce(1).write.text(path)
    return Engine(spark).load(path)


def _lines_of(columns, header: str, query: str, table: str = "nation"):
    """A query over lines of text made of a table's columns."""
    return lambda spark, sf_dir: _text(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet").select(columns().alias("value")), header).sql(query)


def _ragged():
    return F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(",", "n_nationkey", "n_name", F.lit("beyond"), F.lit("it"))).otherwise(F.col("n_nationkey").cast("string"))


def _number_forms():
    forms = F.array(*[F.lit(x) for x in ("+5", "1e2", "0x10", ".5", "1_000", "-7.", "12")])
    return F.concat_ws(",", "n_nationkey", F.get(forms, F.col("n_nationkey") % 7))


def _command(table: str, columns: list[str], *runs: list[str]):
    """What the command prints for a table's rows as text on its input: (run, exit code, line number, line) for each run's options."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns).orderBy(columns[0])
        rows = frame.collect()  # tables of a few rows: the command's input is one stream
        out = []
        for k, options in enumerate(runs):
            sep = "|" if "|" in options else "\t" if "--tsv" in options else ","
            text = "\n".join(sep.join("" if v is None else str(v) for v in r) for r in [tuple(columns), *rows])  # the last line has no end
            printed, errors = io.StringIO(), io.StringIO()
            code = cli.main(options, io.BytesIO(text.encode()), printed, errors, spark)
            said = printed.getvalue().splitlines() or [errors.getvalue().split("\n")[0].split(":")[0].split(" ")[0]]
            out += [(k, code, n, x) for n, x in enumerate(said)]
        return spark.createDataFrame(out, "run long, code long, at long, line string")

    return run


def _no_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).parquet(f"{sf_dir}/nation.parquet", "nation")
    statements = ["", "-- a comment", "CREATE TABLE x AS SELECT 1", "DELETE FROM nation", "UPDATE nation SET n_name = NULL", "INSERT INTO nation (n_nationkey) VALUES (99)", "BEGIN", "ATTACH 'other.db' AS other"]
    done = [(s, e.sql(s) is None) for s in statements]
    left = e.sql("SELECT count(*) FROM nation").first()[0]
    return spark.createDataFrame([(s, ok, left) for s, ok in done], "statement string, silent boolean, rows_left long")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark).parquet(f"{sf_dir}/orders.parquet").sql("EXPLAIN SELECT o_orderkey FROM t WHERE o_custkey = 5")
    return df.agg((F.count("*") > 0).alias("has_plan"), F.max(F.col("detail").contains("PushedFilters")).alias("pushes_filters"))


def _sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_frame(Engine(spark).parquet(f"{sf_dir}/nation.parquet").sql("SELECT n_nationkey AS k, n_name || '/\"' AS q, n_regionkey / 2.0 AS h, nullif(n_regionkey, 1) AS r FROM t"))


def _sink_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark).parquet(f"{sf_dir}/region.parquet").sql('SELECT r_regionkey AS "k,1", r_name FROM t ORDER BY 1')
    return spark.createDataFrame([(n, x.rstrip("\n")) for n, x in enumerate(csv_lines(df.columns, df.toLocalIterator(), header=True))], "at long, line string")


def _two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).parquet(f"{sf_dir}/events.parquet").pipe(["SELECT user_id, count(*) AS n FROM t GROUP BY user_id", "SELECT n, count(*) AS users FROM t GROUP BY n"])


def _sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frame(Engine(spark).parquet(f"{sf_dir}/nation.parquet").sql("SELECT n_nationkey, n_name || ', \"x\"' AS q, n_regionkey / 2.0 AS h, nullif(n_regionkey, 1) AS r FROM t"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("day"))
    probes = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("probe"), F.col("o_orderdate").alias("day"))
    out = frames.asof(probes, orders, by=["o_custkey"], on="day", take=["o_orderkey"], tie="o_orderkey", strict=True)
    return out.select("probe", "o_orderkey")


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "csv_roundtrip_infer": (_roundtrip("orders", _ORDERS, _READ), _READ_ORACLE),
    "csv_no_inference_text_compare": (_roundtrip("part", ["p_partkey", "p_size"], "SELECT p_partkey FROM t WHERE p_size > 2", infer=False), "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey FROM part WHERE CAST(p_size AS VARCHAR) > '2'"),
    "csv_quoted_text": (_roundtrip("conversations", ["conv_id", "turn", "role", "text"], "SELECT conv_id, turn, role, text FROM t"), "SELECT conv_id, turn, role, replace(text, chr(13), '') AS text FROM conversations"),
    "tsv_roundtrip": (_roundtrip("orders", _ORDERS, _READ, "\t"), _READ_ORACLE),
    "psv_roundtrip": (_roundtrip("orders", _ORDERS, _READ, "|"), _READ_ORACLE),
    "header_dedupe": (_header_dedupe, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, n_name AS n_2 FROM nation"),
    "blank_lines_null_rows": (_blank_lines, "SELECT 2 * count(*) AS rows, count(*) AS keys FROM nation"),
    "two_pass_pipeline": (_two_pass, "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY n"),
    "sink_csv_lines": (_sink_csv, "SELECT n_nationkey || ',\"' || n_name || ', \"\"x\"\"\",' || CASE WHEN n_regionkey % 2 = 0 THEN (n_regionkey // 2) || '.0' ELSE (n_regionkey // 2) || '.5' END || ',' || CASE WHEN n_regionkey = 1 THEN 'NULL' ELSE CAST(n_regionkey AS VARCHAR) END AS line FROM nation"),
    "csv_text_after_quote": (_lines_of(lambda: F.concat(F.lit('"'), "n_name", F.lit('"x"y,'), "n_nationkey"), "n,k", "SELECT n, k FROM t"), "SELECT n_name || 'x\"y' AS n, CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "csv_quote_inside_plain_field": (_lines_of(lambda: F.concat("n_name", F.lit('"q",'), "n_nationkey", F.lit('"')), "n,k", "SELECT n, k FROM t"), "SELECT n_name || '\"q\"' AS n, n_nationkey || '\"' AS k FROM nation"),
    "csv_ragged_rows": (_lines_of(_ragged, "k,n", "SELECT k, n FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS n FROM nation"),
    "csv_empty_fields": (_lines_of(lambda: F.concat(F.lit(","), "n_name", F.lit(',"",'), "n_nationkey"), "a,n,b,k", "SELECT a, n, b, k FROM t"), "SELECT CAST(NULL AS VARCHAR) AS a, n_name AS n, CAST(NULL AS VARCHAR) AS b, CAST(n_nationkey AS BIGINT) AS k FROM nation"),
    "csv_number_forms": (_lines_of(_number_forms, "k,v", "SELECT k, v, typeof(v) AS kind FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST([5.0, 100.0, 16.0, 0.5, 1000.0, -7.0, 12.0][n_nationkey % 7 + 1] AS DOUBLE) AS v, 'real' AS kind FROM nation"),
    "csv_header_only": (lambda spark, sf_dir: _text(spark, spark.createDataFrame([], "value string"), "k,n").sql("SELECT count(*) AS rows, count(k) AS keys FROM t"), "SELECT CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS keys"),
    "csv_bom_and_cr": (_lines_of(lambda: F.concat("n_nationkey", F.lit(","), "n_name", F.lit("\r")), "﻿k, n \r", "SELECT k, n FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation"),
    "command_csv": (
        _command("nation", ["n_nationkey", "n_name", "n_regionkey"], ["SELECT n_name FROM t WHERE n_regionkey > 2"], ["-H", "-d", "|", "SELECT n_nationkey, n_regionkey / 2.0 AS h FROM t"], ["--tsv", "SELECT DISTINCT n_regionkey FROM t ORDER BY n_nationkey"], ["--no-type-inference", "SELECT n_name FROM t WHERE n_regionkey > 2 AND n_nationkey < '3'"]),
        "SELECT run, CAST(0 AS BIGINT) AS code, row_number() OVER (PARTITION BY run ORDER BY o) - 1 AS at, line FROM (SELECT CAST(0 AS BIGINT) AS run, n_nationkey AS o, n_name AS line FROM nation WHERE n_regionkey > 2 UNION ALL SELECT 1, -1, 'n_nationkey,h' UNION ALL SELECT 1, n_nationkey, n_nationkey || ',' || CASE WHEN n_regionkey % 2 = 0 THEN (n_regionkey // 2) || '.0' ELSE (n_regionkey // 2) || '.5' END FROM nation UNION ALL SELECT 2, min(n_nationkey), CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY n_regionkey UNION ALL SELECT 3, n_nationkey, n_name FROM nation WHERE CAST(n_regionkey AS VARCHAR) > '2' AND CAST(n_nationkey AS VARCHAR) < '3')",
    ),
    "command_json": (
        _command("region", ["r_regionkey", "r_name"], ["--json", "SELECT r_name AS n, r_regionkey / 4.0 AS q, nullif(r_regionkey, 2) AS k FROM t ORDER BY r_regionkey"], ["--json", "SELECT r_name FROM t WHERE 0"], ["--json", "--header", "SELECT 1"]),
        "SELECT * FROM (SELECT CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS code, CAST(0 AS BIGINT) AS at, '[' || string_agg('{\"n\":\"' || r_name || '\",\"q\":' || CASE WHEN r_regionkey % 4 = 0 THEN CAST(r_regionkey // 4 AS VARCHAR) ELSE CAST(r_regionkey / 4 AS VARCHAR) END || ',\"k\":' || CASE WHEN r_regionkey = 2 THEN 'null' ELSE CAST(r_regionkey AS VARCHAR) END || '}', ',' ORDER BY r_regionkey) || ']' AS line FROM region UNION ALL SELECT 1, 0, 0, '[]' UNION ALL SELECT 2, 1, 0, 'error')",
    ),
    "command_exit_codes": (
        _command("region", ["r_regionkey", "r_name"], ["--help"], ["--version"], [], ["--nope", "SELECT 1"], ["-d", "ab", "SELECT 1"], ["SELECT * FROM missing"], ["SELEC 1"], ["SELECT count(*) FROM t"], ["CREATE TABLE z (k)"]),
        "SELECT CAST(run AS BIGINT) AS run, CAST(code AS BIGINT) AS code, CAST(0 AS BIGINT) AS at, line FROM (VALUES (0, 0, 'Usage'), (1, 0, 'tabq'), (2, 1, 'error'), (3, 1, 'error'), (4, 1, 'error'), (5, 3, 'error'), (6, 3, 'error'), (8, 0, '')) v(run, code, line) UNION ALL SELECT 7, 0, 0, CAST(count(*) AS VARCHAR) FROM region",
    ),
    "statements_without_rows": (_no_rows, "SELECT s AS statement, true AS silent, n AS rows_left FROM (VALUES (''), ('-- a comment'), ('CREATE TABLE x AS SELECT 1'), ('DELETE FROM nation'), ('UPDATE nation SET n_name = NULL'), ('INSERT INTO nation (n_nationkey) VALUES (99)'), ('BEGIN'), ('ATTACH ''other.db'' AS other')) v(s), (SELECT count(*) AS n FROM nation)"),
    "explain": (_explained, "SELECT true AS has_plan, true AS pushes_filters"),
    "sink_json_lines": (_sink_json, "SELECT '{\"k\":' || n_nationkey || ',\"q\":\"' || n_name || '\\/\\\"\",\"h\":' || CASE WHEN n_regionkey % 2 = 0 THEN CAST(n_regionkey // 2 AS VARCHAR) ELSE (n_regionkey // 2) || '.5' END || ',\"r\":' || CASE WHEN n_regionkey = 1 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS line FROM nation"),
    "sink_header_row": (_sink_header, "SELECT CAST(0 AS BIGINT) AS at, '\"k,1\",r_name' AS line UNION ALL SELECT r_regionkey + 1, r_regionkey || ',' || r_name FROM region"),
    "join_asof": (_asof, "SELECT p.o_orderkey AS probe, (SELECT arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) FROM orders o WHERE o.o_custkey = p.o_custkey AND o.o_orderdate < p.o_orderdate) AS o_orderkey FROM orders p WHERE p.o_orderstatus = 'P'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _compat(v[0]) for k, v in SQL.items()} | {k: v[0] for k, v in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: v[1] or v[0] for k, v in SQL.items()}
    return out | {k: v[1] for k, v in OTHER.items() if v[1] is not None}


def entry(spark: SparkSession) -> DataFrame:
    """The headline query: revenue by group, largest first."""
    return queries()["group_sum_order"](spark, "/root/testdata/sf0.001")
