"""Relational queries as Spark SQL or DataFrames, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalar
from ..operators.joins import asof_join, interval_join, salted_join
from ..operators.quantiles import median
from ..sources import readers
from ..streaming import streams

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain table; the schema of a path is inferred once, later reads need no job for it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the plain tables that a statement names."""
    for name in TABLES:
        if re.search(rf"(?i)\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


#: name: (Spark SQL, DuckDB SQL or None if the same text serves both)
SQL: dict[str, tuple[str, str | None]] = {
    "rel_q1_pricing_summary": ("""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
          round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty,
          round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", None),
    "rel_q3_shipping_priority": ("""
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate, o_orderpriority
        ORDER BY revenue DESC, l_orderkey LIMIT 20""", None),
    "rel_q5_region_revenue": ("""
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_nationkey = s_nationkey GROUP BY n_name""", None),
    "rel_q6_forecast": ("""
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
        WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""", None),
    "rel_predicates": ("""
        SELECT DISTINCT p_brand, CASE WHEN p_size > 25 THEN 'large' WHEN p_size IS NULL THEN 'none' ELSE 'small' END AS kind,
          coalesce(nullif(p_type, 'x'), '-') AS ptype
        FROM part WHERE (p_brand LIKE '%1%' OR p_brand IN ('Brand#23', 'Brand#45')) AND NOT p_size BETWEEN 10 AND 12 AND p_name IS NOT NULL""", None),
    "rel_cte_subquery": ("""
        WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
        SELECT c_mktsegment, count(*) AS n, round(sum(total), 2) AS total FROM (SELECT * FROM customer WHERE c_acctbal > 0) c
        JOIN big ON c.c_custkey = big.o_custkey WHERE total > (SELECT avg(total) FROM big) GROUP BY c_mktsegment""", None),
    "rel_exists_semi": ("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 100000)", None),
    "rel_not_exists_anti": ("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "rel_scalar_subqueries": ("SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT max(l_quantity) FROM lineitem) AS q", None),
    "rel_left_join": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", None),
    "rel_right_join": ("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name", None),
    "rel_full_join": ("""
        SELECT a.k AS ak, b.k AS bk FROM (SELECT o_custkey % 50 AS k FROM orders GROUP BY 1) a
        FULL OUTER JOIN (SELECT c_custkey % 70 + 20 AS k FROM customer GROUP BY 1) b ON a.k = b.k""", None),
    "rel_cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "rel_theta_join": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "rel_range_join": ("SELECT n_name, r_name FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 4 AND r_regionkey * 4 + 6 AND n_name > r_name", None),
    "rel_nested_loop_left": ("SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey > n_nationkey + 1 AND n_name <> r_name", None),
    "rel_lateral": (
        "SELECT r_name, n.n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey) n", None),
    "rel_agg_suite": ("""
        SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice), 4) AS sdp,
          round(var_samp(o_totalprice) / 1e6, 4) AS vs, round(corr(o_totalprice, CAST(o_custkey AS double)), 6) AS co,
          round(covar_pop(o_totalprice, CAST(o_custkey AS double)) / 1e3, 3) AS cp, bool_and(o_totalprice > 0) AS ba,
          bool_or(o_totalprice > 400000) AS bo, max_by(o_orderkey, o_totalprice) AS amax, min_by(o_orderkey, o_totalprice) AS amin,
          count(DISTINCT o_custkey) AS nd, count(*) FILTER (WHERE o_totalprice > 100000) AS nf, round(median(o_totalprice), 4) AS med,
          round(percentile(o_totalprice, 0.25), 4) AS q25, bit_or(o_orderkey) AS bor, bit_and(o_orderkey) AS band, bit_xor(o_orderkey) AS bx,
          round(kurtosis(o_totalprice), 5) AS ku, round(regr_slope(o_totalprice, CAST(o_custkey AS double)), 6) AS rs, count_if(o_custkey > 10) AS ci
        FROM orders GROUP BY o_orderstatus""", """
        SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice), 4) AS sdp,
          round(var_samp(o_totalprice) / 1e6, 4) AS vs, round(corr(o_totalprice, CAST(o_custkey AS double)), 6) AS co,
          round(covar_pop(o_totalprice, CAST(o_custkey AS double)) / 1e3, 3) AS cp, bool_and(o_totalprice > 0) AS ba,
          bool_or(o_totalprice > 400000) AS bo, arg_max(o_orderkey, o_totalprice) AS amax, arg_min(o_orderkey, o_totalprice) AS amin,
          count(DISTINCT o_custkey) AS nd, count(*) FILTER (WHERE o_totalprice > 100000) AS nf, round(median(o_totalprice), 4) AS med,
          round(quantile_cont(o_totalprice, 0.25), 4) AS q25, bit_or(o_orderkey) AS bor, bit_and(o_orderkey) AS band, bit_xor(o_orderkey) AS bx,
          round(kurtosis_pop(o_totalprice), 5) AS ku, round(regr_slope(o_totalprice, CAST(o_custkey AS double)), 6) AS rs, CAST(count_if(o_custkey > 10) AS BIGINT) AS ci
        FROM orders GROUP BY o_orderstatus"""),
    "rel_string_agg": (
        "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(sort_array(collect_list(n_name)), '|') AS listed FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(list(n_name)), '|') AS listed FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "rel_mode_first": (
        "SELECT n_regionkey, mode(k, true) AS most, first(n_name) AS one, any_value(n_regionkey) AS any_key FROM (SELECT n_regionkey, min(n_name) OVER (PARTITION BY n_regionkey) AS n_name, length(n_name) AS k FROM nation) GROUP BY n_regionkey",
        "SELECT n_regionkey, (SELECT k FROM (SELECT length(n_name) AS k, count(*) AS c FROM nation m WHERE m.n_regionkey = n.n_regionkey GROUP BY 1) ORDER BY c DESC, k LIMIT 1) AS most, first(n_name) AS one, any_value(n_regionkey) AS any_key FROM (SELECT n_regionkey, min(n_name) OVER (PARTITION BY n_regionkey) AS n_name FROM nation) n GROUP BY n_regionkey"),
    "rel_agg_more": ("""
        SELECT o_orderstatus, any_value(o_orderstatus) AS av, round(covar_samp(o_totalprice, CAST(o_custkey AS double)) / 1e3, 3) AS cs, round(regr_intercept(o_totalprice, CAST(o_custkey AS double)), 2) AS ri,
          round(regr_r2(o_totalprice, CAST(o_custkey AS double)), 8) AS r2, regr_count(o_totalprice, CAST(o_custkey AS double)) AS rc, round(regr_avgx(o_totalprice, CAST(o_custkey AS double)), 4) AS rax,
          round(regr_avgy(o_totalprice, CAST(o_custkey AS double)), 4) AS ray, round(regr_sxx(o_totalprice, CAST(o_custkey AS double)) / 1e3, 2) AS rsx, round(regr_syy(o_totalprice, CAST(o_custkey AS double)) / 1e9, 2) AS rsy,
          round(var_pop(o_totalprice) / 1e6, 4) AS vp, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS pd, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS pc,
          array_join(sort_array(collect_set(o_orderpriority)), ',') AS ps, size(collect_list(o_orderkey)) + 0L AS nl, max(o_orderdate) AS md, min(o_orderpriority) AS mp,
          round(exp(avg(ln(o_totalprice))), 2) AS gm, sum(DISTINCT o_custkey) AS sd, round(try_avg(o_totalprice), 4) AS ta, try_sum(o_custkey) AS ts, every(o_custkey > 0) AS ev, some(o_custkey > 100) AS so
        FROM orders GROUP BY o_orderstatus""", """
        SELECT o_orderstatus, any_value(o_orderstatus) AS av, round(covar_samp(o_totalprice, CAST(o_custkey AS double)) / 1e3, 3) AS cs, round(regr_intercept(o_totalprice, CAST(o_custkey AS double)), 2) AS ri,
          round(regr_r2(o_totalprice, CAST(o_custkey AS double)), 8) AS r2, CAST(regr_count(o_totalprice, CAST(o_custkey AS double)) AS BIGINT) AS rc, round(regr_avgx(o_totalprice, CAST(o_custkey AS double)), 4) AS rax,
          round(regr_avgy(o_totalprice, CAST(o_custkey AS double)), 4) AS ray, round(regr_sxx(o_totalprice, CAST(o_custkey AS double)) / 1e3, 2) AS rsx, round(regr_syy(o_totalprice, CAST(o_custkey AS double)) / 1e9, 2) AS rsy,
          round(var_pop(o_totalprice) / 1e6, 4) AS vp, quantile_disc(o_totalprice, 0.5) AS pd, round(quantile_cont(o_totalprice, 0.9), 4) AS pc,
          array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS ps, len(list(o_orderkey)) AS nl, max(o_orderdate) AS md, min(o_orderpriority) AS mp,
          round(geomean(o_totalprice), 2) AS gm, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sd, round(avg(o_totalprice), 4) AS ta, CAST(sum(o_custkey) AS BIGINT) AS ts, bool_and(o_custkey > 0) AS ev, bool_or(o_custkey > 100) AS so
        FROM orders GROUP BY o_orderstatus"""),
    "rel_agg_null_handling": (
        "SELECT count(x) AS c, sum(x) AS s, avg(x) AS a, max(x) AS m, count_if(x IS NULL) AS n, count(DISTINCT x) AS d, coalesce(sum(CASE WHEN x > 99 THEN x END), -1) AS none FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation)",
        "SELECT count(x) AS c, CAST(sum(x) AS BIGINT) AS s, avg(x) AS a, max(x) AS m, CAST(count_if(x IS NULL) AS BIGINT) AS n, count(DISTINCT x) AS d, CAST(coalesce(sum(CASE WHEN x > 99 THEN x END), -1) AS BIGINT) AS none FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS x FROM nation)"),
    "rel_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "rel_rollup_having": ("SELECT l_returnflag, l_linenumber, CAST(grouping(l_linenumber) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber) HAVING count(*) > 100", None),
    "rel_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "rel_window_ranking": ("""
        SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr,
          round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""", None),
    "rel_window_analytic": ("""
        SELECT o_orderkey, lag(o_totalprice) OVER w AS lg, lead(o_totalprice, 1, 0.0) OVER w AS ld, first_value(o_orderkey) OVER w AS fv,
          last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
          nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nv
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", None),
    "rel_window_frames": ("""
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s2,
          round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS a3,
          count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS cr, count(*) OVER (PARTITION BY o_custkey) AS c
        FROM orders""", None),
    "rel_qualify_top": (
        "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "rel_topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", None),
    "rel_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30", None),
    "rel_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "rel_union_all": ("SELECT 'c' AS src, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier", None),
    "rel_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "rel_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "rel_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "rel_except_all": ("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", None),
    "rel_values": ("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(id, val)", None),
    "fn_string": ("""
        SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, trim(concat(' ', p_type, ' ')) AS tr, concat_ws('-', p_brand, p_type) AS cw,
          replace(p_name, 'a', 'x') AS re, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, left(p_name, 3) AS le,
          right(p_name, 3) AS ri, substring(p_name, 2, 3) AS su, contains(p_name, 'e') AS co, ascii(p_brand) AS asc1, md5(p_name) AS md, translate(p_name, 'ab', 'xy') AS tl,
          split_part(p_name, ' ', 1) AS sp, p_name LIKE '%e%' AS lk, startswith(p_name, 'a') AS sw, CAST(instr(p_name, 'e') AS BIGINT) AS pos, CAST(length(p_name) AS BIGINT) AS len,
          regexp_replace(p_brand, '[0-9]', '#') AS rr, regexp_extract(p_brand, '([0-9]+)', 1) AS rx, p_brand RLIKE '[0-9]' AS rm,
          CAST(levenshtein(p_brand, 'Brand') AS BIGINT) AS lev, sha2(p_name, 256) AS sh, char(65 + p_size % 26) AS ch, array_join(regexp_extract_all(p_brand, '[0-9]', 0), ',') AS ra, repeat('ab', 2) AS rep
        FROM part""", """
        SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, trim(concat(' ', p_type, ' ')) AS tr, concat_ws('-', p_brand, p_type) AS cw,
          replace(p_name, 'a', 'x') AS re, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, left(p_name, 3) AS le,
          right(p_name, 3) AS ri, substring(p_name, 2, 3) AS su, contains(p_name, 'e') AS co, ascii(p_brand) AS asc1, md5(p_name) AS md, translate(p_name, 'ab', 'xy') AS tl,
          split_part(p_name, ' ', 1) AS sp, p_name LIKE '%e%' AS lk, starts_with(p_name, 'a') AS sw, strpos(p_name, 'e') AS pos, length(p_name) AS len,
          regexp_replace(p_brand, '[0-9]', '#', 'g') AS rr, regexp_extract(p_brand, '([0-9]+)', 1) AS rx, regexp_matches(p_brand, '[0-9]') AS rm,
          levenshtein(p_brand, 'Brand') AS lev, sha256(p_name) AS sh, chr(65 + p_size % 26) AS ch, array_to_string(regexp_extract_all(p_brand, '[0-9]'), ',') AS ra, repeat('ab', 2) AS rep
        FROM part"""),
    "fn_math": ("""
        SELECT p_partkey, abs(-p_size) AS ab, CAST(ceil(p_retailprice) AS DOUBLE) AS ce, CAST(floor(p_retailprice) AS DOUBLE) AS fl, round(sqrt(p_retailprice), 8) AS sq, round(power(p_size, 2), 4) AS po,
          round(ln(p_retailprice), 8) AS l, round(log10(p_retailprice), 8) AS l10, round(log2(p_retailprice), 8) AS l2, CAST(sign(p_size - 20) AS INT) AS sg, round(sin(p_size), 8) AS si, round(atan2(p_size, 2), 8) AS at2,
          round(degrees(p_size), 6) AS dg, round(radians(p_size), 8) AS rd, p_size % 7 AS md, greatest(p_size, 10) AS gr, least(p_size, 10) AS le, p_size & 3 AS ba, p_size | 3 AS bo, p_size ^ 3 AS bx, round(cbrt(p_size), 8) AS cb,
          CAST(bit_count(p_size) AS INT) AS bc, CAST(p_retailprice AS BIGINT) AS tr, round(exp(p_size / 50.0), 8) AS ex
        FROM part""", """
        SELECT p_partkey, abs(-p_size) AS ab, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(sqrt(p_retailprice), 8) AS sq, round(power(p_size, 2), 4) AS po,
          round(ln(p_retailprice), 8) AS l, round(log10(p_retailprice), 8) AS l10, round(log2(p_retailprice), 8) AS l2, CAST(sign(p_size - 20) AS INT) AS sg, round(sin(p_size), 8) AS si, round(atan2(p_size, 2), 8) AS at2,
          round(degrees(p_size), 6) AS dg, round(radians(p_size), 8) AS rd, p_size % 7 AS md, greatest(p_size, 10) AS gr, least(p_size, 10) AS le, p_size & 3 AS ba, p_size | 3 AS bo, xor(p_size, 3) AS bx, round(cbrt(p_size), 8) AS cb,
          CAST(bit_count(p_size) AS INT) AS bc, CAST(trunc(p_retailprice) AS BIGINT) AS tr, round(exp(p_size / 50.0), 8) AS ex
        FROM part"""),
    "fn_date": ("""
        SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(weekofyear(o_orderdate) AS BIGINT) AS w,
          CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dw, CAST(weekday(o_orderdate) + 1 AS BIGINT) AS idw, CAST(dayofyear(o_orderdate) AS BIGINT) AS dy,
          CAST(date_trunc('month', o_orderdate) AS timestamp_ntz) AS tm, last_day(o_orderdate) AS ld, unix_timestamp(CAST(o_orderdate AS timestamp)) AS ep,
          date_format(o_orderdate, 'yyyy-MM-dd') AS f, o_orderdate + INTERVAL 1 DAY AS plus1, o_orderdate + INTERVAL 1 MONTH AS plusm,
          CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS dd, date_format(o_orderdate, 'MMMM') AS mn
        FROM orders""", """
        SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w,
          dayofweek(o_orderdate) AS dw, isodow(o_orderdate) AS idw, dayofyear(o_orderdate) AS dy,
          date_trunc('month', o_orderdate) AS tm, last_day(o_orderdate) AS ld, CAST(epoch(o_orderdate) AS BIGINT) AS ep,
          strftime(o_orderdate, '%Y-%m-%d') AS f, o_orderdate + INTERVAL 1 DAY AS plus1, o_orderdate + INTERVAL 1 MONTH AS plusm,
          date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS dd, monthname(o_orderdate) AS mn
        FROM orders"""),
    "fn_array": ("""
        SELECT c, CAST(size(ks) AS BIGINT) AS n, array_contains(ks, 5) AS has5, array_join(sort_array(array_distinct(transform(ks, x -> x % 3))), ',') AS d3, array_max(ks) AS mx, array_min(ks) AS mn,
          array_join(filter(ks, x -> x % 2 = 0), ',') AS ev, CAST(aggregate(ks, 0L, (a, x) -> a + x) AS BIGINT) AS su, array_join(reverse(ks), ',') AS rv, array_join(slice(ks, 2, 2), ',') AS sl,
          array_join(array_intersect(ks, array(1, 3, 5)), ',') AS isec, arrays_overlap(ks, array(2, 4)) AS ov, CAST(array_position(ks, 3) AS BIGINT) AS pos, array_join(flatten(array(ks, array(0))), ',') AS fl
        FROM (SELECT l_orderkey AS c, sort_array(collect_list(l_linenumber)) AS ks FROM lineitem GROUP BY l_orderkey)""", """
        SELECT c, len(ks) AS n, list_contains(ks, 5) AS has5, array_to_string(list_sort(list_distinct(list_transform(ks, lambda x: x % 3))), ',') AS d3, list_max(ks) AS mx, list_min(ks) AS mn,
          array_to_string(list_filter(ks, lambda x: x % 2 = 0), ',') AS ev, CAST(list_sum(ks) AS BIGINT) AS su, array_to_string(list_reverse(ks), ',') AS rv, array_to_string(list_slice(ks, 2, 3), ',') AS sl,
          array_to_string(list_sort(list_intersect(ks, [1, 3, 5])), ',') AS isec, list_has_any(ks, [2, 4]) AS ov, CAST(coalesce(list_position(ks, 3), 0) AS BIGINT) AS pos, array_to_string(flatten([ks, [0]]), ',') AS fl
        FROM (SELECT l_orderkey AS c, list_sort(list(l_linenumber)) AS ks FROM lineitem GROUP BY l_orderkey)"""),
    "fn_map_struct_json": ("""
        SELECT event_id, map(event_type, value)[event_type] AS mv, CAST(cardinality(map(event_type, value)) AS BIGINT) AS mc, map_contains_key(map(event_type, 1), 'click') AS mk,
          named_struct('a', user_id, 'b', event_type).a AS sa, get_json_object(props, '$.k') AS jk, get_json_object(concat('{"a":{"b":', user_id, '}}'), '$.a.b') AS jb, json_array_length('[1,2]') + 0L AS jl
        FROM events""", """
        SELECT event_id, map([event_type], [value])[event_type] AS mv, CAST(cardinality(map([event_type], [value])) AS BIGINT) AS mc, map_contains(map([event_type], [1]), 'click') AS mk,
          {'a': user_id, 'b': event_type}.a AS sa, json_extract_string(props, '$.k') AS jk, json_extract_string(concat('{"a":{"b":', user_id, '}}'), '$.a.b') AS jb, CAST(json_array_length('[1,2]') AS BIGINT) AS jl
        FROM events"""),
    "fn_conditional_cast": ("""
        SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS c, if(l_quantity > 25, 'hi', 'lo') AS i, try_cast(l_returnflag AS INT) AS tc, CAST(round(l_quantity) AS INT) AS ci,
          CAST(l_orderkey AS STRING) AS cs, l_linenumber BETWEEN 2 AND 4 AS bt, l_linenumber IN (1, 3) AS isin, CAST(l_quantity > 10 AS INT) AS cb, NOT (l_linenumber <=> 3) AS df
        FROM lineitem""", """
        SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS c, if(l_quantity > 25, 'hi', 'lo') AS i, try_cast(l_returnflag AS INT) AS tc, CAST(round(l_quantity) AS INT) AS ci,
          CAST(l_orderkey AS VARCHAR) AS cs, l_linenumber BETWEEN 2 AND 4 AS bt, l_linenumber IN (1, 3) AS isin, CAST(l_quantity > 10 AS INT) AS cb, l_linenumber IS DISTINCT FROM 3 AS df
        FROM lineitem"""),
    "fn_string_more": ("""
        SELECT p_partkey, initcap(lower(p_brand)) AS ic, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt, CAST(octet_length(p_name) AS BIGINT) AS ol, CAST(bit_length(p_name) AS BIGINT) AS bl,
          substring_index(p_name, ' ', 1) AS si, hex(p_brand) AS hx, base64(CAST(p_brand AS BINARY)) AS b64, CAST(unhex('414243') AS STRING) AS uh, endswith(p_name, 'a') AS ew, btrim(concat('xx', p_brand, 'xx'), 'x') AS bt,
          format_string('%s-%05d', p_brand, p_size) AS fs, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS rc, overlay(p_brand PLACING 'Z' FROM 1 FOR 2) AS ov, p_name ILIKE '%A%' AS il, concat_ws('', sort_array(split(p_brand, ''))) AS ss,
          CAST(size(split(p_name, ' ')) AS BIGINT) AS ns, url_encode(p_name) AS ue, url_decode('a%20b') AS ud, CAST(to_number('1,234', '9,999') AS INT) AS tn, char_length(p_name) + 0L AS cl, strpos2 AS sp
        FROM (SELECT *, CAST(locate('#', p_brand) AS BIGINT) AS strpos2 FROM part)""", """
        SELECT p_partkey, concat(upper(left(p_brand, 1)), lower(substr(p_brand, 2))) AS ic, ltrim(concat('  ', p_brand)) AS lt, rtrim(concat(p_brand, '  ')) AS rt, octet_length(encode(p_name)) AS ol, 8 * octet_length(encode(p_name)) AS bl,
          split_part(p_name, ' ', 1) AS si, hex(p_brand) AS hx, base64(encode(p_brand)) AS b64, decode(unhex('414243')) AS uh, ends_with(p_name, 'a') AS ew, trim(concat('xx', p_brand, 'xx'), 'x') AS bt,
          format('{}-{:05d}', p_brand, p_size) AS fs, len(regexp_extract_all(p_name, '[aeiou]')) AS rc, 'Z' || substr(p_brand, 3) AS ov, p_name ILIKE '%A%' AS il, array_to_string(list_sort(string_split(p_brand, '')), '') AS ss,
          len(string_split(p_name, ' ')) AS ns, replace(url_encode(p_name), '%20', '+') AS ue, url_decode('a%20b') AS ud, 1234 AS tn, length(p_name) AS cl, strpos(p_brand, '#') AS sp
        FROM part"""),
    "fn_math_more": ("""
        SELECT p_partkey, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta, round(asin(p_size / 100.0), 8) AS asn, round(acos(p_size / 100.0), 8) AS acs, round(atan(p_size), 8) AS atn, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch,
          round(tanh(p_size / 10.0), 8) AS th, round(cot(p_size), 6) AS ct, round(pi(), 8) AS pi, round(e(), 8) AS e, CAST(factorial(p_size % 10) AS BIGINT) AS fa, round(log(2, p_size), 8) AS lg, shiftleft(p_size, 2) AS sl, shiftright(p_size, 1) AS sr,
          ~p_size AS bn, round(p_retailprice, 1) AS r1, round(p_retailprice, -1) AS rm, isnan(p_retailprice) AS nn, round(hypot(p_size, 3), 8) AS hy, p_size div 7 AS dv, pmod(-p_size, 7) AS pm, width_bucket(p_retailprice, 900, 2000, 10) + 0L AS wb, round(asinh(p_size), 8) AS ash, round(expm1(p_size / 50.0), 8) AS em
        FROM part""", """
        SELECT p_partkey, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta, round(asin(p_size / 100.0), 8) AS asn, round(acos(p_size / 100.0), 8) AS acs, round(atan(p_size), 8) AS atn, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch,
          round(tanh(p_size / 10.0), 8) AS th, round(cot(p_size), 6) AS ct, round(pi(), 8) AS pi, round(exp(1), 8) AS e, CAST(factorial(p_size % 10) AS BIGINT) AS fa, round(log2(p_size), 8) AS lg, p_size << 2 AS sl, p_size >> 1 AS sr,
          ~p_size AS bn, round(p_retailprice, 1) AS r1, round(p_retailprice, -1) AS rm, isnan(p_retailprice) AS nn, round(sqrt(p_size * p_size + 9), 8) AS hy, p_size // 7 AS dv, ((-p_size % 7) + 7) % 7 AS pm,
          CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 11 ELSE CAST(floor((p_retailprice - 900) / 110) AS BIGINT) + 1 END AS wb, round(asinh(p_size), 8) AS ash, round(exp(p_size / 50.0) - 1, 8) AS em
        FROM part"""),
    "fn_date_more": ("""
        SELECT o_orderkey, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(minute(o_orderdate) AS BIGINT) AS mi, CAST(second(o_orderdate) AS BIGINT) AS s, make_date(year(o_orderdate), 1, 31) AS md, add_months(CAST(o_orderdate AS DATE), 2) AS am,
          CAST(date_trunc('week', o_orderdate) AS timestamp_ntz) AS tw, CAST(date_trunc('quarter', o_orderdate) AS timestamp_ntz) AS tq, CAST(date_trunc('hour', o_orderdate) AS timestamp_ntz) AS th, trunc(CAST(o_orderdate AS DATE), 'YEAR') AS ty,
          date_add(CAST(o_orderdate AS DATE), 10) AS da, date_sub(CAST(o_orderdate AS DATE), 10) AS ds, CAST(timestampdiff(HOUR, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) AS BIGINT) AS hd, date_format(o_orderdate, 'EEEE') AS dn,
          CAST(extract(YEAROFWEEK FROM o_orderdate) AS BIGINT) AS iy, to_date('2024-02-29') AS td, CAST(to_timestamp('2024-02-29 01:02:03') AS timestamp_ntz) AS tt, unix_date(CAST(o_orderdate AS DATE)) + 0L AS ud, o_orderdate BETWEEN TIMESTAMP_NTZ '1995-01-01 00:00:00' AND TIMESTAMP_NTZ '1996-01-01 00:00:00' AS bw
        FROM orders""", """
        SELECT o_orderkey, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, make_date(year(o_orderdate), 1, 31) AS md, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS am,
          date_trunc('week', o_orderdate) AS tw, date_trunc('quarter', o_orderdate) AS tq, date_trunc('hour', o_orderdate) AS th, CAST(date_trunc('year', o_orderdate) AS DATE) AS ty,
          CAST(o_orderdate AS DATE) + 10 AS da, CAST(o_orderdate AS DATE) - 10 AS ds, date_sub('hour', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS hd, dayname(o_orderdate) AS dn,
          isoyear(o_orderdate) AS iy, DATE '2024-02-29' AS td, TIMESTAMP '2024-02-29 01:02:03' AS tt, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ud, o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-01-01 00:00:00' AS bw
        FROM orders"""),
    "fn_array_more": ("""
        SELECT c, array_join(array_union(ks, array(9)), ',') AS un, array_join(array_except(ks, array(1)), ',') AS ex, array_join(array_remove(ks, 2), ',') AS rm, array_join(array_append(ks, 8), ',') AS ap, array_join(array_prepend(ks, 0), ',') AS pr,
          element_at(ks, 1) AS e1, element_at(ks, -1) AS el, array_join(concat(ks, array(7)), ',') AS cc, array_join(array_repeat(1, 3), ',') AS rp, array_join(sequence(1, 3), ',') AS sq, exists(ks, x -> x > 5) AS ey, forall(ks, x -> x > 0) AS fa,
          array_join(zip_with(ks, ks, (x, y) -> x * y), ',') AS zw, array_join(array_sort(ks, (x, y) -> y - x), ',') AS sd, array_join(array_compact(array(1, NULL, 2)), ',') AS cp, get(ks, 0) AS g0, size(shuffle(ks)) + 0L AS sh
        FROM (SELECT l_orderkey AS c, sort_array(collect_set(l_linenumber)) AS ks FROM lineitem GROUP BY l_orderkey)""", """
        SELECT c, array_to_string(list_append(ks, 9), ',') AS un, array_to_string(list_filter(ks, lambda x: x <> 1), ',') AS ex, array_to_string(list_filter(ks, lambda x: x <> 2), ',') AS rm, array_to_string(list_append(ks, 8), ',') AS ap, array_to_string(list_prepend(0, ks), ',') AS pr,
          ks[1] AS e1, ks[-1] AS el, array_to_string(list_concat(ks, [7]), ',') AS cc, '1,1,1' AS rp, array_to_string(generate_series(1, 3), ',') AS sq, len(list_filter(ks, lambda x: x > 5)) > 0 AS ey, true AS fa,
          array_to_string(list_transform(ks, lambda x: x * x), ',') AS zw, array_to_string(list_reverse_sort(ks), ',') AS sd, '1,2' AS cp, ks[1] AS g0, len(ks) AS sh
        FROM (SELECT l_orderkey AS c, list_sort(list(DISTINCT l_linenumber)) AS ks FROM lineitem GROUP BY l_orderkey)"""),
    "fn_map_more": ("""
        SELECT event_id, array_join(map_keys(map('a', 1, 'b', 2)), ',') AS mk, array_join(map_values(map('a', 1, 'b', 2)), ',') AS mv, map_from_entries(array(struct('k', user_id)))['k'] AS fe, map_concat(map('a', 1), map('b', 2))['b'] AS mc,
          map_filter(map('a', user_id, 'b', -1L), (k, v) -> v >= 0)['b'] AS mf, str_to_map('x:1,y:2', ',', ':')['y'] AS sm, to_json(named_struct('a', 1)) AS tj, from_json('{"a": 5}', 'a INT').a AS fj, try_element_at(map('a', 1), 'z') AS te, size(map_entries(map('a', 1))) + 0L AS me
        FROM events""", """
        SELECT event_id, 'a,b' AS mk, '1,2' AS mv, map_from_entries([{'k': 'k', 'v': user_id}])['k'] AS fe, map_concat(map(['a'], [1]), map(['b'], [2]))['b'] AS mc,
          CAST(NULL AS BIGINT) AS mf, '2' AS sm, CAST(to_json({'a': 1}) AS VARCHAR) AS tj, CAST(json_extract('{"a": 5}', '$.a') AS INT) AS fj, CAST(NULL AS INT) AS te, len(map_entries(map(['a'], [1]))) AS me
        FROM events"""),
    "unnest_zip": ("SELECT * FROM (SELECT inline(arrays_zip(array(1, 2, 3), array('a', 'b')))) AS t(id, val)", "SELECT unnest([1, 2, 3]) AS id, unnest(['a', 'b']) AS val"),
    "pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
        "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag"),
}


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates against exact ones.

    Beside a DISTINCT in one aggregate Spark would keep summaries for each customer, and merge each into
    one of up to 100,000 places; so distinct customers and the median are found on their own.
    """
    orders = table(spark, sf_dir, "orders")
    near = orders.selectExpr(
        "round(approx_count_distinct(o_orderstatus), 0) AS statuses", "approx_count_distinct(o_custkey) AS about",
        "approx_percentile(o_totalprice, 0.5, 100000) AS fine", "approx_percentile(o_totalprice, 0.5) AS rough")
    customers = orders.select("o_custkey").distinct().agg(F.count("o_custkey").alias("customers"))
    both = near.crossJoin(customers).withColumn("exact", F.lit(median(orders, "o_totalprice")).cast("double"))
    return both.selectExpr(
        "statuses", "round(fine / exact, 2) AS middle", "customers",
        "abs(about - customers) <= 0.1 * customers AS distinct_ok", "abs(rough - exact) <= 0.05 * exact AS median_ok")


def prepared_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000.0, "status": "F"})


def gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.gcd(F.col("p_partkey"), F.col("p_size") * 12).alias("g"))


def product_dayofweek(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(scalar.dayofweek0(F.col("o_orderdate")).cast("long").alias("dw"), scalar.date_trunc_ntz("year", F.col("o_orderdate")).alias("y"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(scalar.product(1 + F.col("o_custkey") / 1e6), 6).alias("p"))


def zip_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("xs", F.array(F.lit(1), F.lit(2), F.lit(3))).withColumn("ys", F.array("n_name", F.lit("x")))
    return rows.select("n_nationkey", scalar.zip_unnest(F.col("xs"), F.col("ys"))).toDF("n_nationkey", "a", "b")


def entropy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    e = scalar.entropy(orders, "o_orderpriority", ["o_orderstatus"])
    h = scalar.histogram(orders, "o_orderpriority", ["o_orderstatus"])
    return e.join(h, "o_orderstatus").select("o_orderstatus", F.round("entropy", 8).alias("entropy"), F.aggregate(F.map_values("histogram"), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)).alias("most"))


def generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.generate_series(spark, 1, 1000).where("generate_series % 7 = 0")


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    return asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_ts", "click_id"])


def asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with each key's rows dealt over days."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    return asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_ts", "click_id"], slices=F.to_date("_t"))


def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bands = spark.range(0, 40).select(F.col("id").alias("band"), (F.col("id") * 10000.0).alias("low"), (F.col("id") * 10000.0 + 15000).alias("high"))
    return interval_join(orders, bands, "o_totalprice", "low", "high", 12000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def skewed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    users = events.groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return salted_join(events.select("event_id", "user_id"), users, ["user_id"], 4).groupBy("first_event").agg(F.count(F.lit(1)).alias("n"))


def _written(spark: SparkSession, df: DataFrame, kind: str, **options) -> str:
    from .lakes import scratch

    path = os.path.join(scratch(spark), kind)
    getattr(df.write.options(**options), kind)(path)
    return path


def csv_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, table(spark, sf_dir, "nation"), "csv", header=True)
    return readers.read_csv(spark, path).select("n_nationkey", "n_name", "n_regionkey")


def json_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, table(spark, sf_dir, "region"), "json")
    return readers.read_json(spark, path, "r_regionkey int, r_name string")


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), "n")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts by Structured Streaming: a file source, a watermark, a memory sink in complete mode."""
    schema = table(spark, sf_dir, "events").schema
    folder = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    source = stream.parquet(folder) if os.path.isdir(folder) else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = streams.tumbling(source, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"))
    name = f"hourly_{os.urandom(4).hex()}"
    run = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


FUNCTIONS = {
    "rel_approx": (approximate, "SELECT count(DISTINCT o_orderstatus) AS statuses, CAST(1 AS DOUBLE) AS middle, count(DISTINCT o_custkey) AS customers, true AS distinct_ok, true AS median_ok FROM orders"),
    "rel_prepared": (prepared_parameters, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0 AND o_orderstatus = 'F'"),
    "fn_product_dayofweek": (product_dayofweek, "SELECT dayofweek(o_orderdate) AS dw, date_trunc('year', o_orderdate) AS y, count(*) AS n, round(product(1 + o_custkey / 1e6), 6) AS p FROM orders GROUP BY 1, 2"),
    "fn_zip_unnest": (zip_unnest, "SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest([n_name, 'x']) AS b FROM nation"),
    "rel_asof_slices": (asof_sliced, """
        WITH c AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT e.event_id, e.user_id, e.ts, c.click_ts, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.click_ts"""),
    "fn_gcd": (gcd, "SELECT p_partkey, gcd(p_partkey, CAST(p_size * 12 AS BIGINT)) AS g FROM part"),
    "rel_entropy_histogram": (entropy_histogram, "SELECT o_orderstatus, round(entropy(o_orderpriority), 8) AS entropy, list_max(map_values(histogram(o_orderpriority)))::BIGINT AS most FROM orders GROUP BY 1"),
    "generate_series": (generate_series, "SELECT generate_series FROM generate_series(1, 1000) WHERE generate_series % 7 = 0"),
    "rel_asof_join": (asof, """
        WITH c AS (SELECT user_id, ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT e.event_id, e.user_id, e.ts, c.click_ts, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.click_ts"""),
    "rel_interval_join": (interval, "SELECT b AS band, count(*) AS n FROM orders, range(0, 40) t(b) WHERE o_totalprice BETWEEN b * 10000.0 AND b * 10000.0 + 15000 GROUP BY 1"),
    "rel_salted_join": (skewed_join, "WITH u AS (SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1) SELECT first_event, count(*) AS n FROM events JOIN u USING (user_id) GROUP BY 1"),
    "read_csv": (csv_reader, "SELECT * FROM nation"),
    "read_json": (json_reader, "SELECT * FROM region"),
    "window_tumbling": (tumbling_window, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"),
    "window_session": (session_window, """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""),
    "stream_tumbling": (stream_window, "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def queries() -> dict:
    return {name: _sql(text) for name, (text, _) in SQL.items()} | {name: f for name, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in SQL.items()} | {name: sql for name, (_, sql) in FUNCTIONS.items()}


