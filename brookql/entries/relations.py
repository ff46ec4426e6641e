"""Projections, filters, joins, aggregation, windows, sorting and sets."""

RELATIONS = {
    # --- projections ----------------------------------------------------------------------------------------------
    "p1_select": ("from nation select n_name as name, k = n_nationkey * 10, n_regionkey,", "SELECT n_name AS name, n_nationkey * 10 AS k, n_regionkey FROM nation"),
    "p2_distinct": ("from customer select distinct c_mktsegment, c_nationkey where c_nationkey < 3", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_nationkey < 3"),
    "p3_global_aggregate": ("from orders select n = _.count, top = o_totalprice.max, total = (o_totalprice.sum / 7).round(2)", "SELECT count(*) AS n, max(o_totalprice) AS top, round(sum(o_totalprice) / 7, 2) AS total FROM orders"),
    "p4_add": ("from region add r_regionkey + 1 as next, up = r_name.upper", "SELECT *, r_regionkey + 1 AS next, upper(r_name) AS up FROM region"),
    "p5_prepend": ("from region prepend r_regionkey * 2 as twice", "SELECT r_regionkey * 2 AS twice, * FROM region"),
    "p6_exclude": ("from customer exclude c_name, c_acctbal, nothing where c_custkey < 20", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey < 20"),
    "p7_rename": ("from region rename r_name as name, r_regionkey as k", "SELECT r_regionkey AS k, r_name AS name FROM region"),
    "p8_shift": ("from nation shift to right n_nationkey shift n_regionkey", "SELECT n_regionkey, n_name, n_nationkey FROM nation"),
    "p9_transform": ("from region transform r_name = r_name.lower", "SELECT r_regionkey, lower(r_name) AS r_name FROM region"),
    "p10_where_chain": ("from orders where o_orderkey > 50 where o_orderkey <= 90 group by o_orderstatus agg _.count as n where n > 1", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 90 GROUP BY 1 HAVING count(*) > 1"),
    "p11_select_as": ("from nation where n_regionkey = 0 select as africa\nfrom africa select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 0"),
    "p12_partial_query": ("def only(k: int, least: int = 0) = where n_regionkey = k and n_nationkey >= least\nfrom nation | only(1) | only(1, least = 6) | select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 6"),
    "p13_pipes": ("from nation\n| where n_regionkey = 2\n| select n_name,\n| count", "SELECT count(*) AS count FROM nation WHERE n_regionkey = 2"),
    "p14_star_of": ("from nation as n join region as r on n.n_regionkey = r.r_regionkey select r.*, n.n_name", "SELECT region.*, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    # --- predicates -----------------------------------------------------------------------------------------------
    "b1_logic": ("from nation where n_regionkey = 1 or n_regionkey = 2 and not n_nationkey < 10 or !(n_nationkey > 1) select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 AND NOT n_nationkey < 10 OR NOT (n_nationkey > 1)"),
    "b2_comparisons": ("from part where p_size == 3 or p_size >= 49 and p_size != 50 or p_size <> p_size or p_size < 2 select p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size = 3 OR p_size >= 49 AND p_size != 50 OR p_size < 2"),
    "b3_is": ("from orders where o_orderstatus is 'P' and o_orderkey is not 3 and o_orderdate != null select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey <> 3 AND o_orderdate IS NOT NULL"),
    "b4_nulls": ("from [[1, 1], [null, 2], [null, null]] as t(a, b) where a is null or a is not distinct from b select a, b, d = a is distinct from b", "SELECT a, b, a IS DISTINCT FROM b AS d FROM (VALUES (1, 1), (NULL, 2), (NULL, NULL)) t(a, b) WHERE a IS NULL OR a IS NOT DISTINCT FROM b"),
    "b5_in_list": ("from nation where n_nationkey in (1, 3, 5) or n_name not in ('NATION_2', 'NATION_4') and n_regionkey in (2) select n_name", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_name NOT IN ('NATION_2', 'NATION_4') AND n_regionkey IN (2)"),
    "b5_tuple_in": ("from nation where (n_nationkey, n_regionkey) in ((1, 1), (7, 2), (8, 2)) or (n_regionkey, n_nationkey) not in ((0, 0)) and n_nationkey < 3 select n_name", "SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN ((1, 1), (7, 2), (8, 2)) OR (n_regionkey, n_nationkey) NOT IN ((0, 0)) AND n_nationkey < 3"),
    "b5_not_in_query": ("from customer where c_custkey not in (from orders where o_totalprice > 300000 select o_custkey) select c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "b5_tuple_in_query": ("from nation where (n_nationkey, n_regionkey) in {from supplier join nation as n on s_nationkey = n.n_nationkey select n.n_nationkey, n.n_regionkey} select n_name", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "b6_between": ("from part where p_size between 10 and 12 and p_partkey not between 100 and 1000 select p_partkey", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_partkey NOT BETWEEN 100 AND 1000"),
    "b7_like": ("from part where p_name like '%red%' and p_type not like 'E%' or p_name like 'small!_%' escape '!' select p_partkey", "SELECT p_partkey FROM part WHERE p_name LIKE '%red%' AND p_type NOT LIKE 'E%' OR p_name LIKE 'small!_%' ESCAPE '!'"),
    "b8_rlike": ("from part where p_name rlike '^(red|blue) ' and p_brand not rlike '1$' select p_partkey", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) ') AND NOT regexp_matches(p_brand, '1$')"),
    "b9_exists": ("from customer as c where exists { from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > 495000 } select c_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 495000)"),
    "b9_not_exists": ("from customer as c where not exists { from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000 } select c_custkey", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "b9_scalar": ("from part as p where p.p_retailprice > { from part as q where q.p_brand = p.p_brand select q.p_retailprice.avg } * 1.02 select p_partkey", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) * 1.02"),
    "b10_contains": ("from part where p_name.contains('red') select p_partkey", "SELECT p_partkey FROM part WHERE contains(p_name, 'red')"),
    # --- joins ----------------------------------------------------------------------------------------------------
    "j1_theta": ("from region as a join region as b on a.r_regionkey < b.r_regionkey select x = a.r_name, y = b.r_name", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "j2_left": ("from customer as c left join orders as o on c.c_custkey = o.o_custkey and o.o_totalprice > 480000 select c.c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000"),
    "j3_right": ("from supplier as s right join nation as n on s.s_nationkey = n.n_nationkey and s.s_acctbal > 8000 select n.n_name, s.s_name", "SELECT n_name, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000"),
    "j4_full": ("from [[1, 'a'], [2, 'b'], [null, 'n']] as x(k, v) full join [[2, 'B'], [3, 'C'], [null, 'N']] as y(j, w) on x.k = y.j select k, v, j, w", "SELECT k, v, j, w FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'n')) x(k, v) FULL JOIN (VALUES (2, 'B'), (3, 'C'), (NULL, 'N')) y(j, w) ON k = j"),
    "j5_cross": ("from region cross join [[1], [2]] as t(i) select r_name, i", "SELECT r_name, i FROM region CROSS JOIN (VALUES (1), (2)) t(i)"),
    "j6_implicit": ("from nation as n, supplier as s, customer as c where n.n_nationkey = s.s_nationkey and c.c_nationkey = n.n_nationkey and c.c_acctbal > 9900 select n.n_name, s.s_name, c.c_name", "SELECT n_name, s_name, c_name FROM nation, supplier, customer WHERE n_nationkey = s_nationkey AND c_nationkey = n_nationkey AND c_acctbal > 9900"),
    "j7_using": ("from nation select k = n_nationkey, n_name join {from supplier select k = s_nationkey, s_name} on k select k, n_name, s_name", "SELECT n_nationkey AS k, n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey"),
    "j7_full_using": ("from [[1, 'a'], [2, 'b']] as x(k, v) full join [[2, 'B'], [3, 'C']] as y(k, w) on k select k, v, w", "SELECT k, v, w FROM (VALUES (1, 'a'), (2, 'b')) x(k, v) FULL JOIN (VALUES (2, 'B'), (3, 'C')) y(k, w) USING (k)"),
    "j8_no_condition": ("from region join [[1], [2]] as t(i) select r_name, i", "SELECT r_name, i FROM region, (VALUES (1), (2)) t(i)"),
    "j9_natural": ("from nation select n_nationkey, n_name natural join { from nation where n_regionkey = 1 select n_nationkey, z = n_regionkey }", "SELECT n_nationkey, n_name, n_regionkey AS z FROM nation WHERE n_regionkey = 1"),
    "j10_asof": ("from events where event_type = 'purchase' select event_id, user_id, ts asof join {from events where event_type = 'click' select cid = event_id, cuser = user_id, cts = ts} as c on user_id = c.cuser and c.cts <= ts select event_id, cid", "SELECT a.event_id, b.event_id AS cid FROM (FROM events WHERE event_type = 'purchase') a ASOF JOIN (FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts"),
    "j10_asof_left_after": ("from events as a where event_type = 'error' left asof join {from events where event_type = 'view'} as b on a.user_id = b.user_id and b.ts > a.ts select a.event_id, next = b.event_id", "SELECT a.event_id, b.event_id AS next FROM (FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts < b.ts"),
    "j10_asof_no_keys": ("from events as a where event_type = 'error' left asof join {from events where event_type = 'purchase'} as b on b.ts < a.ts select a.event_id, before = b.event_id", "SELECT a.event_id, b.event_id AS before FROM (FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (FROM events WHERE event_type = 'purchase') b ON a.ts > b.ts"),
    "j11_semi_anti": ("from supplier where s_nationkey in (from nation where n_regionkey = 1 select n_nationkey) and s_nationkey not in (from customer where c_acctbal > 9990 select c_nationkey) select s_suppkey", "SELECT s_suppkey FROM supplier SEMI JOIN (FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey ANTI JOIN (FROM customer WHERE c_acctbal > 9990) ON s_nationkey = c_nationkey"),
    "j12_join_unnest": ("from [[1, [10, 20]], [2, []], [3, null], [4, [30]]] as t(id, xs) cross join unnest(xs) as u(x) select id, x", "SELECT * FROM (VALUES (1, 10), (1, 20), (4, 30)) t(id, x)"),
    "j13_self_join": ("from nation as a join nation as b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey select x = a.n_name, y = b.n_name", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    # --- aggregation ----------------------------------------------------------------------------------------------
    "a1_group_keys": ("from orders group by year(o_orderdate) as y, status = o_orderstatus agg _.count as n", "SELECT year(o_orderdate)::INT AS y, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2"),
    "a2_bare_group": ("from [[1, 'a'], [1, 'a'], [2, 'b']] as t(k, v) group by k", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)"),
    "a3_agg_no_keys": ("from lineitem agg l_quantity.sum as q, n = _.count, c = l_returnflag.count_distinct", "SELECT sum(l_quantity) AS q, count(*) AS n, count(DISTINCT l_returnflag) AS c FROM lineitem"),
    "a4_group_select": ("from lineitem group by l_returnflag, l_linestatus select l_linestatus, n = count(*), q = sum(l_quantity), l_returnflag", "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS q, l_returnflag FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "a5_having": ("from customer group by c_nationkey where c_acctbal.avg > 4700 where _.count > 50 agg n = _.count", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4700 AND count(*) > 50"),
    "a6_count": ("from orders where o_orderstatus = 'F' group by o_custkey count", "SELECT count(DISTINCT o_custkey) AS count FROM orders WHERE o_orderstatus = 'F'"),
    "a7_key_refs": ("from orders group by o_orderstatus, o_orderpriority select s = _1, p = _2, n = _.count", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2"),
    "a8_grouping_sets": ("sql: select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) as g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::TINYINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"),
    "a8_cube": ("sql: select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "a8_rollup": ("sql: select c_mktsegment, c_nationkey, count(*) as n from customer group by rollup (c_mktsegment, c_nationkey)", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"),
    "a9_distinct_args": ("from orders group by o_orderstatus agg c = count(distinct o_custkey), p = count(distinct o_orderpriority)", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1"),
    "a10_filter": ("from orders group by o_orderpriority agg n = count(*) filter (where o_orderstatus = 'F'), t = round(sum(o_totalprice) filter (where o_totalprice > 400000), 2)", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n, round(sum(o_totalprice) FILTER (o_totalprice > 400000), 2) AS t FROM orders GROUP BY 1"),
    "a11_ordered_array": ("from nation group by n_regionkey agg names = array_agg(n_name order by n_nationkey % 3 desc, n_name).join(','), back = array_agg(n_nationkey order by n_nationkey desc).get(1)", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey % 3 DESC, n_name), ',') AS names, max(n_nationkey) AS back FROM nation GROUP BY 1"),
    "a11_array_keeps_nulls": ("from [[1, 3], [1, null], [1, 2]] as t(k, v) group by k agg n = array_agg(v order by v).length, x = array_agg(v order by v nulls first).get(2)", "SELECT 1 AS k, 3 AS n, 2 AS x"),
    "a12_dedup": ("from customer select c_mktsegment dedup", "SELECT DISTINCT c_mktsegment FROM customer"),
    "a13_pivot_agg": ("from orders pivot on o_orderstatus in ('F', 'O') group by o_orderpriority agg o_totalprice.max as top, _.count as n", "SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F_top, count(*) FILTER (o_orderstatus = 'F') AS F_n, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O_top, count(*) FILTER (o_orderstatus = 'O') AS O_n FROM orders GROUP BY 1"),
    "a13_pivot_dynamic": ("from customer where c_nationkey < 3 select c_mktsegment, k = s\"n${c_nationkey}\" pivot on k", "SELECT c_mktsegment, count(*) FILTER (c_nationkey = 0) AS n0, count(*) FILTER (c_nationkey = 1) AS n1, count(*) FILTER (c_nationkey = 2) AS n2 FROM customer WHERE c_nationkey < 3 GROUP BY 1"),
    "a13_pivot_two_keys": ("from lineitem pivot on l_returnflag in ('A', 'N'), l_linestatus in ('F', 'O') group by l_linenumber", "SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS A_F, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS A_O, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS N_F, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS N_O FROM lineitem GROUP BY 1"),
    "a14_unpivot": ("from supplier where s_suppkey < 10 select s_suppkey, k = s_nationkey::double, bal = s_acctbal unpivot amount for what in (k, bal)", "SELECT s_suppkey, unnest(['k', 'bal']) AS what, unnest([s_nationkey::DOUBLE, s_acctbal]) AS amount FROM supplier WHERE s_suppkey < 10"),
    "a14_unpivot_nulls": ("from [[1, 5, null], [2, null, 6]] as t(id, a, b) unpivot for name in (a, b)", "SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', 6)) t(id, name, value)"),
    "a15_sample_rows": ("from orders sample 25 count", "SELECT 25::BIGINT AS count"),
    "a15_sample_kinds": ("from lineitem sample bernoulli(40%) agg n = _.count select kind = 'bernoulli', ok = n > 0 concat { from orders sample reservoir(10%) agg n = _.count select kind = 'reservoir', ok = n > 0 } concat { from orders sample 30% agg n = _.count select kind = 'percent', ok = n > 0 }", "SELECT * FROM (VALUES ('bernoulli', true), ('reservoir', true), ('percent', true)) t(kind, ok)"),
    "a15_tablesample": ("sql: select count(*) as n from (select * from orders tablesample system (100))", "SELECT count(*) AS n FROM orders"),
    "a16_two_phase": ("from lineitem group by l_suppkey agg s = l_quantity.sum, n = _.count", "SELECT l_suppkey, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1"),
    # --- windows --------------------------------------------------------------------------------------------------
    "n1_window_method": ("from nation select n_name, t = n_nationkey.sum over (partition by n_regionkey order by n_nationkey)", "SELECT n_name, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS t FROM nation"),
    "n2_frames": ("from nation select n_nationkey, a = n_nationkey.sum over (order by n_nationkey rows[-1,0]), b = n_nationkey.sum over (order by n_nationkey rows[,0]), c = n_nationkey.sum over (order by n_nationkey rows[0,]), d = n_nationkey.sum over (order by n_nationkey rows[-1,1])", "SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS a, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS b, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS c, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS d FROM nation"),
    "n3_range": ("from part where p_partkey < 200 select p_partkey, n = count(*) over (order by p_size range between 2 preceding and 2 following)", "SELECT p_partkey, count(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part WHERE p_partkey < 200"),
    "n4_default_frame": ("from part where p_partkey < 200 select p_partkey, n = count(*) over (order by p_size)", "SELECT p_partkey, count(*) OVER (ORDER BY p_size) AS n FROM part WHERE p_partkey < 200"),
    "n5_ranking": ("from part where p_partkey < 300 select p_partkey, r = rank() over (order by p_size), d = dense_rank() over (order by p_size), q = ntile(4) over (order by p_size, p_partkey), c = round(cume_dist() over (order by p_size), 6), p = round(percent_rank() over (order by p_size), 6)", "SELECT p_partkey, (rank() OVER (ORDER BY p_size))::INT AS r, (dense_rank() OVER (ORDER BY p_size))::INT AS d, (ntile(4) OVER (ORDER BY p_size, p_partkey))::INT AS q, round(cume_dist() OVER (ORDER BY p_size), 6) AS c, round(percent_rank() OVER (ORDER BY p_size), 6) AS p FROM part WHERE p_partkey < 300"),
    "n6_analytic": ("from events where user_id < 3 select event_id, p = lag(event_id) over (partition by user_id order by ts), n = lead(event_id, 2) over (partition by user_id order by ts), f = first_value(event_id) over (partition by user_id order by ts), s = nth_value(event_id, 2) over (partition by user_id order by ts rows between unbounded preceding and unbounded following)", "SELECT event_id, lag(event_id) OVER w AS p, lead(event_id, 2) OVER w AS n, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM events WHERE user_id < 3 WINDOW w AS (PARTITION BY user_id ORDER BY ts)"),
    "n7_ignore_nulls": ("from [[1, 'a'], [2, null], [3, null], [4, 'd']] as t(i, v) select i, p = lag(v) ignore nulls over (order by i), l = last_value(v) ignore nulls over (order by i), r = lag(v) respect nulls over (order by i)", "SELECT * FROM (VALUES (1, NULL, 'a', NULL), (2, 'a', 'a', 'a'), (3, 'a', 'a', NULL), (4, 'a', 'd', NULL)) t(i, p, l, r)"),
    "n8_aggregate_window": ("from supplier select s_suppkey, m = s_acctbal.max over (partition by s_nationkey), a = round(avg(s_acctbal) over (partition by s_nationkey), 4)", "SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS m, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS a FROM supplier"),
    "n9_window_after_agg": ("from orders group by o_orderstatus agg n = _.count select o_orderstatus, n, total = n.sum over (), r = rank() over (order by n desc)", "SELECT o_orderstatus, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total, (rank() OVER (ORDER BY count(*) DESC))::INT AS r FROM orders GROUP BY 1"),
    # --- order, limit, sets ---------------------------------------------------------------------------------------
    "o1_order_nulls": ("from [[1, null], [2, 5], [3, 4], [4, null]] as t(i, v) order by v, i limit 3", "SELECT * FROM (VALUES (1, NULL), (2, 5), (3, 4)) t(i, v)"),
    "o1_nulls_first": ("from [[1, null], [2, 5], [3, 4], [4, null]] as t(i, v) order by v desc nulls first, i limit 3", "SELECT * FROM (VALUES (1, NULL), (2, 5), (4, NULL)) t(i, v)"),
    "o2_ordinal": ("from customer select c_nationkey, c_custkey order by 1 desc, 2 limit 7", "SELECT c_nationkey, c_custkey FROM customer ORDER BY 1 DESC, 2 LIMIT 7"),
    "o3_limit_then_where": ("from nation order by n_nationkey limit 10 where n_regionkey = 1 select n_name", "SELECT n_name FROM (FROM nation ORDER BY n_nationkey LIMIT 10) WHERE n_regionkey = 1"),
    "o4_offset": ("sql: select n_name from nation order by n_nationkey limit 4 offset 3", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 3"),
    "o4_offset_flow": ("from nation order by n_nationkey offset 20 select n_name", "SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20"),
    "o5_top_k": ("from orders order by o_totalprice desc, o_orderkey limit 10 select o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "o6_concat": ("from nation select n_name concat { from region select r_name } concat { from region select r_name }", "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region"),
    "o7_union": ("sql: select c_nationkey from customer union select s_nationkey from supplier union all select 99", "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT 99"),
    "o8_intersect": ("from [[1], [1], [2], [null], [null]] as t(x) intersect all { from [[1], [1], [1], [null]] as u(x) }", "SELECT x FROM (VALUES (1), (1), (NULL)) t(x)"),
    "o8_intersect_distinct": ("from customer select k = c_nationkey intersect { from supplier select s_nationkey }", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "o9_except": ("from customer select k = c_custkey except { from orders where o_orderkey % 3 = 0 select o_custkey }", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0"),
    "o9_except_all": ("from [[1], [1], [1], [2], [null]] as t(x) except all { from [[1], [2]] as u(x) }", "SELECT x FROM (VALUES (1), (1), (NULL)) t(x)"),
}
