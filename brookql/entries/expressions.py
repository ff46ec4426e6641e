"""Expressions, functions, definitions, commands and the larger report queries."""

EXPRESSIONS = {
    "e1_arithmetic": ("from part where p_partkey < 50 select p_partkey, a = 2 * 3 + p_size, b = p_size - 2 - 1, c = -p_size % 7, d = p_size // 4, e = (p_size / 4).round(4), f = +p_size", "SELECT p_partkey, 6 + p_size AS a, p_size - 3 AS b, -p_size % 7 AS c, (p_size // 4)::BIGINT AS d, round(p_size / 4, 4) AS e, p_size AS f FROM part WHERE p_partkey < 50"),
    "e2_string_plus": ("from [['a', 'b'], ['c', null]] as t(x, y) select v = x + y, w = 'n' + 1", "SELECT * FROM (VALUES ('ab', 'n1'), ('c', 'n1')) t(v, w)"),
    "e3_bars": ("from region select v = r_name || '/' || r_regionkey.to_string, n = r_name || null", "SELECT r_name || '/' || r_regionkey AS v, (r_name || NULL)::VARCHAR AS n FROM region"),
    "e4_interpolation": ("val unit = 'km'\nfrom region select v = s\"${r_name}: ${r_regionkey + 1} ${unit}\", w = s\"\"\"quoted \"x\" ${r_regionkey}\"\"\", z = sql\"r_regionkey * 3\"", "SELECT concat(r_name, ': ', r_regionkey + 1, ' km') AS v, concat('quoted \"x\" ', r_regionkey) AS w, r_regionkey * 3 AS z FROM region"),
    "e5_if": ("from part where p_partkey < 60 select p_partkey, a = if p_size > 25 then 'big' else 'small', b = if(p_size > 25, 1, 0), c = if(p_size > 25, 1)", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS b, CASE WHEN p_size > 25 THEN 1 END AS c FROM part WHERE p_partkey < 60"),
    "e6_case": ("from region select a = case r_regionkey when 1 then 'one' when 2 then 'two' else 'more', b = case when r_regionkey > 3 then 'x' when r_name like 'A%' then 'a' end", "SELECT CASE r_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS a, CASE WHEN r_regionkey > 3 THEN 'x' WHEN r_name LIKE 'A%' THEN 'a' END AS b FROM region"),
    "e7_casts": ("from supplier select s_suppkey, a = s_acctbal::int, b = cast(s_acctbal as decimal(12, 1))::double, c = try_cast(s_name as int), d = s_nationkey::string, e = 2.5::int, f = 3.5::double.to_long", "SELECT s_suppkey, s_acctbal::BIGINT AS a, s_acctbal::DECIMAL(12, 1)::DOUBLE AS b, try_cast(s_name AS BIGINT) AS c, s_nationkey::VARCHAR AS d, 3::BIGINT AS e, 4::BIGINT AS f FROM supplier"),
    "e8_typed_literals": ("from orders where o_orderdate between '1996-01-01':date and date '1996-01-31' + '7 days':interval and o_orderdate < timestamp '1996-02-05 00:00:00' + interval '1' day select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' + INTERVAL 7 DAY AND o_orderdate < TIMESTAMP '1996-02-06 00:00:00'"),
    "e9_arrays": ("from region select a = [10, 20, 30][r_regionkey], n = [1, 2, r_regionkey].length, h = [[1, 2], [3]][2][1]", "SELECT CASE r_regionkey WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 END AS a, 3 AS n, 3 AS h FROM region"),
    "e9_sql_arrays": ("sql: select array[1, 2, 3][2] as a, array['x', 'y'][5] as b, cardinality(array[1, 2]) as c", "SELECT 2 AS a, NULL::VARCHAR AS b, 2 AS c"),
    "e10_maps": ("select a = map {x: 1, 'y': 2}['y'], b = map {1: 'one'}[2], c = map(array['k'], array[5])['k']", "SELECT 2 AS a, NULL::VARCHAR AS b, 5 AS c"),
    "e11_structs": ("from region select s = {id: r_regionkey, 'name': r_name} select a = s.id, b = s['name'], c = s.name.lower", "SELECT r_regionkey AS a, r_name AS b, lower(r_name) AS c FROM region"),
    "e12_rows": ("from nation where (n_nationkey, n_name) = (3, 'NATION_3') select n_name", "SELECT n_name FROM nation WHERE n_nationkey = 3"),
    "e13_lambdas": ("from region select a = list_transform([1, 2, 3], x -> x * r_regionkey + 1).join('-'), b = list_transform([5, 6], (v, i) -> v + i).join('-')", "SELECT concat_ws('-', r_regionkey + 1, 2 * r_regionkey + 1, 3 * r_regionkey + 1) AS a, '5-7' AS b FROM region"),
    "e14_higher_order": ("select r = list_reduce([4, 5, 6], (a, b) -> a + b), f = [1, 2, 3, 4].filter(x -> x % 2 = 0).join(','), t = transform(['a', 'b'], x -> x + '!').join(''), g = array_filter([1, null, 3], x -> x is not null).length, n = list_transform([1, 2], x -> list_reduce([4, 5, 6], (a, b) -> a + b) + x).join(',')", "SELECT 15 AS r, '2,4' AS f, 'a!b!' AS t, 2 AS g, '16,17' AS n"),
    "e14_sql_lambda": ("sql: select array_join(transform(array[1, 2, 3], x -> x + 1), ',') as a, reduce(array[1, 2, 3], 0, (s, x) -> s + x, s -> s * 10) as b", "SELECT '2,3,4' AS a, 60 AS b"),
    "e15_extract": ("from orders where o_orderkey < 200 select o_orderkey, y = extract(year from o_orderdate), q = o_orderdate.extract('quarter'), m = month(o_orderdate), d = o_orderdate.day, w = day_of_week(o_orderdate)", "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayofweek(o_orderdate)::INT AS w FROM orders WHERE o_orderkey < 200"),
    "e16_at_time_zone": ("select a = strftime('2024-07-01 12:00:00':timestamp_ntz at time zone 'America/New_York', '%Y-%m-%d %H:%M')", "SELECT '2024-07-01 16:00' AS a"),
    "e16_sql_zone": ("sql: select date_format(timestamp '2024-01-01 00:00:00' at time zone 'Asia/Tokyo', 'yyyy-MM-dd HH:mm') as a", "SELECT '2024-01-01 09:00' AS a"),
    "e17_current": ("select a = current_date <= current_date, b = current_timestamp >= '2020-01-01':timestamp, c = year(now()) > 2020", "SELECT true AS a, true AS b, true AS c"),
    "e18_trim_forms": ("select a = trim(leading 'x' from 'xxaxx'), b = trim(trailing 'x' from 'xxaxx'), c = trim(both from '  a '), d = ' q '.trim, e = ltrim(' z') + rtrim('y ')", "SELECT 'axx' AS a, 'xxa' AS b, 'a' AS c, 'q' AS d, 'zy' AS e"),
    "e19_json_object": ("from region select a = json_object('k': r_regionkey, 'n': nullif(r_name, 'ASIA')), b = json_object('k' value r_regionkey, 'n' value nullif(r_name, 'ASIA') absent on null)", "SELECT '{\"k\":' || r_regionkey || ',\"n\":' || CASE WHEN r_name = 'ASIA' THEN 'null' ELSE '\"' || r_name || '\"' END || '}' AS a, '{\"k\":' || r_regionkey || CASE WHEN r_name = 'ASIA' THEN '' ELSE ',\"n\":\"' || r_name || '\"' END || '}' AS b FROM region"),
    "e20_json_literals": ("select a = variant_get(json '{\"x\": [1, 2]}', '$.x[1]', 'int'), b = to_json(json '[1, 2]')", "SELECT 2 AS a, '[1,2]' AS b"),
    "e20_event_props": ("from events where event_id < 100 select event_id, k = get_json_object(props, '$.k')::int", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id < 100"),
    "e21_parameters": ("sql: prepare top as select n_name, $who as who from nation where n_nationkey = $k; execute top (k => 4, who => 'me')", "SELECT n_name, 'me' AS who FROM nation WHERE n_nationkey = 4"),
    "e22_unnest_select": ("from [[1, [5, 6]], [2, []], [3, null]] as t(id, xs) select id, x = unnest(xs)", "SELECT * FROM (VALUES (1, 5), (1, 6)) t(id, x)"),
    # --- aggregate functions --------------------------------------------------------------------------------------
    "f_aggregates_1": ("from orders group by o_orderstatus agg a = o_totalprice.min, b = o_totalprice.max, c = o_totalprice.median, d = o_totalprice.variance.round(2), e = o_totalprice.stddev.round(4), f = o_orderkey.min_by(o_totalprice), g = o_orderkey.max_by(o_totalprice)", "SELECT o_orderstatus, min(o_totalprice) AS a, max(o_totalprice) AS b, median(o_totalprice) AS c, round(var_samp(o_totalprice), 2) AS d, round(stddev_samp(o_totalprice), 4) AS e, min_by(o_orderkey, o_totalprice) AS f, max_by(o_orderkey, o_totalprice) AS g FROM orders GROUP BY 1"),
    "f_aggregates_2": ("from customer group by c_nationkey agg a = (c_acctbal > 0).count_if, b = c_mktsegment.count_distinct, c = c_acctbal.count, d = round(stddev_pop(c_acctbal), 4), e = stddev_samp(c_acctbal).round(4), f = count_if(c_acctbal > 5000)", "SELECT c_nationkey, count_if(c_acctbal > 0)::BIGINT AS a, count(DISTINCT c_mktsegment) AS b, count(*) AS c, round(stddev_pop(c_acctbal), 4) AS d, round(stddev_samp(c_acctbal), 4) AS e, count_if(c_acctbal > 5000)::BIGINT AS f FROM customer GROUP BY 1"),
    "f_any_value": ("from nation group by n_regionkey agg a = n_regionkey.arbitrary, b = n_regionkey.any, c = any_value(n_regionkey), d = first_value(n_regionkey), e = last_value(n_regionkey)", "SELECT n_regionkey, n_regionkey AS a, n_regionkey AS b, n_regionkey AS c, n_regionkey AS d, n_regionkey AS e FROM nation GROUP BY 1"),
    "f_approximate": ("from orders agg n = o_custkey.count_approx_distinct, x = o_custkey.count_distinct, q = o_totalprice.approx_quantile(0.5), m = o_totalprice.median select near = abs(n - x) < x * 0.1, mid = abs(q - m) < m * 0.05", "SELECT true AS near, true AS mid"),
    "f_arrays": ("from nation group by n_regionkey agg a = n_nationkey.to_array.length, b = sort_array(n_nationkey.array_agg).join(','), c = sort_array(collect_set(n_regionkey)).join(',')", "SELECT n_regionkey, count(*)::INT AS a, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS b, n_regionkey::VARCHAR AS c FROM nation GROUP BY 1"),
    "f_string_agg": ("from nation group by n_regionkey agg names = string_agg(n_name, '; ' order by n_nationkey desc)", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1"),
    "f_collect_hive": ("sql: select n_regionkey, array_join(array_sort(collect_set(n_regionkey)), ',') as s, size(collect_list(n_name)) as n, size(array_distinct(collect_list(n_regionkey))) as d from nation group by n_regionkey", "SELECT n_regionkey, n_regionkey::VARCHAR AS s, count(*)::INT AS n, 1 AS d FROM nation GROUP BY 1"),
    # --- scalar functions -----------------------------------------------------------------------------------------
    "f_conversions": ("from [['1', '2.5', 'true', '2024-02-29']] as t(a, b, c, d) select a = a.to_int, b = b.to_float, e = b.to_double, c = c.to_boolean, d = d.to_date.to_string, l = a.to_long", "SELECT 1::BIGINT AS a, 2.5::DOUBLE AS b, 2.5::DOUBLE AS e, true AS c, '2024-02-29' AS d, 1::BIGINT AS l"),
    "f_or_else": ("from [[1, null], [null, 'x']] as t(a, b) select a = a.or_else(0), b = b.or_else('none'), c = coalesce(a, 9)", "SELECT * FROM (VALUES (1, 'none', 1), (0, 'x', 9)) t(a, b, c)"),
    "f_rounding": ("from supplier select s_suppkey, a = s_acctbal.round(1), b = s_acctbal.round, c = s_acctbal.floor, d = ceiling(s_acctbal), e = abs(s_acctbal), f = sqrt(abs(s_acctbal)).round(6)", "SELECT s_suppkey, round(s_acctbal, 1) AS a, round(s_acctbal, 0) AS b, floor(s_acctbal)::BIGINT AS c, ceil(s_acctbal)::BIGINT AS d, abs(s_acctbal) AS e, round(sqrt(abs(s_acctbal)), 6) AS f FROM supplier"),
    "f_membership": ("from nation select n_nationkey, a = n_nationkey.in(1, 2), b = n_nationkey.not_in(1, 2), c = n_nationkey.between(3, 5)", "SELECT n_nationkey, n_nationkey IN (1, 2) AS a, n_nationkey NOT IN (1, 2) AS b, n_nationkey BETWEEN 3 AND 5 AS c FROM nation"),
    "f_strings_1": ("from part where p_partkey < 80 select p_partkey, a = p_name.length, b = p_name.substring(2, 3), c = p_name.upper, d = lower(p_type), e = p_name.like('%a%'), f = p_name.regexp_like('^b'), g = replace(p_name, 'e', 'E'), h = reverse(p_type)", "SELECT p_partkey, length(p_name)::INT AS a, substring(p_name, 2, 3) AS b, upper(p_name) AS c, lower(p_type) AS d, p_name LIKE '%a%' AS e, regexp_matches(p_name, '^b') AS f, replace(p_name, 'e', 'E') AS g, reverse(p_type) AS h FROM part WHERE p_partkey < 80"),
    "f_strings_2": ("from part where p_partkey < 80 select p_partkey, a = lpad(p_type, 12, '*'), b = rpad(p_type, 12, '-'), c = concat(p_name, '/', p_size), d = concat_ws('+', p_name, p_type), e = instr(p_name, 'e'), f = starts_with(p_name, 's'), g = p_name.starts_with('b'), h = strlen(p_type), i = substr(p_type, 2)", "SELECT p_partkey, lpad(p_type, 12, '*') AS a, rpad(p_type, 12, '-') AS b, concat(p_name, '/', p_size) AS c, concat_ws('+', p_name, p_type) AS d, instr(p_name, 'e')::INT AS e, starts_with(p_name, 's') AS f, starts_with(p_name, 'b') AS g, strlen(p_type)::INT AS h, substr(p_type, 2) AS i FROM part WHERE p_partkey < 80"),
    "f_regexp": ("from part where p_partkey < 80 select p_partkey, a = regexp_replace(p_name, '[aeiou]', '*'), b = regexp_replace(p_name, '[aeiou]', '*', 'g'), c = regexp_extract(p_brand, '[0-9]+'), d = regexp_extract(p_brand, '(B)rand#([0-9]+)', 2), e = regexp_matches(p_name, 'r.d'), f = regexp_replace(p_name, '(.)(l+)', '<\\2\\1>')", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS a, regexp_replace(p_name, '[aeiou]', '*', 'g') AS b, regexp_extract(p_brand, '[0-9]+') AS c, regexp_extract(p_brand, '(B)rand#([0-9]+)', 2) AS d, regexp_matches(p_name, 'r.d') AS e, regexp_replace(p_name, '(.)(l+)', '<\\2\\1>') AS f FROM part WHERE p_partkey < 80"),
    "f_numbers": ("select a = greatest(1, 5, 3), b = least(4, 2), c = hex(255), d = conv('ff', 16, 10), e = levenshtein('kitten', 'sitting'), f = sha1('x'), g = hash(1) = hash(1), h = rand() between 0 and 1", "SELECT 5 AS a, 2 AS b, 'FF' AS c, '255' AS d, 3 AS e, '11f6ad8ec52a2984abaafd7c3b516503785c2072' AS f, true AS g, true AS h"),
    "f_array_methods": ("select a = [1, 2, 3, 2].exclude([2]).join(','), b = [1, 2].size, c = [5, 6].get(2), d = array_concat([1], [2, 3]).join('|'), e = array_distinct([1, 1, 2]).length, f = array_contains([1, 2], 2)", "SELECT '1,3' AS a, 2 AS b, 6 AS c, '1|2|3' AS d, 2 AS e, true AS f"),
    "f_dates": ("from orders where o_orderkey < 100 select o_orderkey, a = strftime(o_orderdate, '%Y-%m-%d'), b = strftime(o_orderdate, 'on %d.%m.%y at %H:%M'), c = date_trunc('month', o_orderdate)::string", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, 'on %d.%m.%y at %H:%M') AS b, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d 00:00:00') AS c FROM orders WHERE o_orderkey < 100"),
    "f_hive": ("sql: select parse_url('http://a.org/p?q=1', 'HOST') as h, named_struct('x', 1).x as x, array_join(array_union(array(1), array(2)), ',') as u, 7 div 2 as d, pos, v from (select 1) lateral view posexplode(array('a', 'b')) t as pos, v", "SELECT 'a.org' AS h, 1 AS x, '1,2' AS u, 3::BIGINT AS d, unnest([0, 1]) AS pos, unnest(['a', 'b']) AS v"),
    "f_inline": ("sql: select a, b from (select 1) lateral view inline(array(struct(1, 'x'), struct(2, 'y'))) t as a, b", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)"),
    "f_ulid": ("val id = ulid_string()\nselect n = length(id), same = id = id, ok = id rlike '^[0-9A-HJKMNP-TV-Z]{26}$'", "SELECT 26 AS n, true AS same, true AS ok"),
    # --- definitions ----------------------------------------------------------------------------------------------
    "u1_function": ("def discounted(price: double, share: double = 0.1) = price * (1 - share)\ndef twice(x: double) = discounted(x, share = 0.5) * 4\nfrom part where p_partkey < 40 select p_partkey, a = discounted(p_retailprice).round(4), b = twice(p_retailprice).round(4)", "SELECT p_partkey, round(p_retailprice * (1 - 0.1), 4) AS a, round(p_retailprice * 2, 4) AS b FROM part WHERE p_partkey < 40"),
    "u2_methods": ("type string = { def shout(n: int = 1): string = this.upper() + repeat('!', n) }\ntype int in trino = { def kind(): string = 'other engine' }\ntype int = { def kind(): string = 'whole' }\ntype double = { def kind(): string = 'real' }\nfrom part where p_partkey < 30 select p_partkey, a = p_name.shout(2), b = p_size.kind, c = p_retailprice.kind", "SELECT p_partkey, upper(p_name) || '!!' AS a, 'whole' AS b, 'real' AS c FROM part WHERE p_partkey < 30"),
    "u2_extends": ("type base = { r_regionkey: int; def even(): boolean = r_regionkey % 2 = 0 }\ntype area extends base = { r_name: string; def tag(): string = r_name + '#' }\nfrom region where _.even select x = _.tag", "SELECT r_name || '#' AS x FROM region WHERE r_regionkey % 2 = 0"),
    "u3_row_methods": ("type account = { c_acctbal: double; c_mktsegment: string; def is_rich = c_acctbal > 9000; def label = c_mktsegment.lower + '!' }\nfrom customer where _.is_rich select c_custkey, l = _.label", "SELECT c_custkey, lower(c_mktsegment) || '!' AS l FROM customer WHERE c_acctbal > 9000"),
    "u4_native": ("def soundex(s: string): string = native\nfrom region select s = soundex(r_name)", "SELECT unnest(['A162', 'A562', 'A200', 'E610', 'M342']) AS s"),
    "u5_operator_defs": ("type string = { def +(other: string): string = concat(this, '&', other) }\nselect a = concat('x', '') + 'y'", "SELECT 'xy' AS a"),
    "u6_udtf_columns": ("sql: select stack(2, 1, 'a', 2, 'b') as (n, s)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(n, s)"),
    "u8_import": ("from [['model asia = { from nation where n_regionkey = 2 }']] as t(value) save to '{tmp}/lib.flow' with single: true, format: text; import lib.asia as far from '{tmp}/lib.flow'; from far select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    # --- commands -------------------------------------------------------------------------------------------------
    "c1_show_tables": ("show tables like 'na%'", "SELECT 'nation' AS name"),
    "c1_show_columns": ("show columns in region | select name, type", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(name, type)"),
    "c1_show_schemas": ("show schemas like 'default' where name = 'default' count", "SELECT 1::BIGINT AS count"),
    "c1_show_catalogs": ("show catalogs | where name = 'spark_catalog' | count", "SELECT 1::BIGINT AS count"),
    "c2_show_models": ("--- nations of one region ---\nmodel local(k: int, n: int = 3) = { from nation where n_regionkey = k limit n }\nshow models", "SELECT 'local' AS name, 'k, n' AS args, 'nations of one region' AS description, '' AS package_name"),
    "c3_show_functions": ("show functions like 'upper' count", "SELECT 1::BIGINT AS count"),
    "c3_show_create": ("sql: create table {t}a (k int); show create table {t}a", None),
    "c4_describe": ("from orders describe where column_name like 'o_o%'", "SELECT * FROM (VALUES ('o_orderkey', 'long'), ('o_orderstatus', 'string'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'string')) t(column_name, column_type)"),
    "c4_describe_table": ("describe region", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(column_name, column_type)"),
    "c5_explain": ("explain from nation where n_regionkey = 1 select n_name", None),
    "c6_show_query": ("model two = { from region limit 2 }\nshow query two", "SELECT 'model two = { from region limit 2 }' AS query"),
    "c7_execute": ("execute sql\"select count(*) as n from nation\"", "SELECT count(*) AS n FROM nation"),
    "c8_use": ("use schema default\nfrom region count", "SELECT count(*) AS count FROM region"),
    "c9_tests": ("from region order by r_regionkey test _.size should be 5 test _.columns should contain 'r_name' test _.rows should not be [] test _.json should contain 'ASIA' test _.output should contain '5 rows' test _.size > 4 test _.size is not 3 select r_name", "SELECT r_name FROM region"),
    "c10_debug": ("from region debug { where r_regionkey < 2 test _.size should be 2 } select r_name", "SELECT r_name FROM region"),
    "c16_comments": ("-- a comment\n--- a longer\ncomment ---\nfrom region -- more\nselect r_name", "SELECT r_name FROM region"),
    # --- reports --------------------------------------------------------------------------------------------------
    "t3_windows": ("from events.subscribe(watermark_column = 'ts', window_size = '1h') where user_id < 20 group by window_start, event_type agg n = _.count", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE user_id < 20 GROUP BY 1, 2"),
    "t3_sliding": ("from events.subscribe(watermark_column = 'ts', window_size = '2h', slide = '1h') group by window_end agg n = _.count", "SELECT window_end, count(*) AS n FROM (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end FROM events UNION ALL SELECT date_trunc('hour', ts) + INTERVAL 2 HOUR FROM events) GROUP BY 1"),
    "q3_shipping": ("from customer where c_mktsegment = 'BUILDING' join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where o_orderdate < '1998-03-15':date and l_shipdate > '1998-03-15':date group by l_orderkey, o_orderdate agg revenue = (l_extendedprice * (1 - l_discount)).sum.round(2) order by revenue desc, l_orderkey limit 10", "SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    "q4_priority": ("from orders as o where o.o_orderdate >= '1997-01-01':date and o.o_orderdate < '1998-01-01':date where exists { from lineitem as l where l.l_orderkey = o.o_orderkey and l.l_discount > 0.05 } group by o_orderpriority agg n = _.count", "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND EXISTS (FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05) GROUP BY 1"),
    "q5_local_suppliers": ("from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name agg revenue = (l_extendedprice * (1 - l_discount)).sum.round(2)", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "q6_forecast": ("from lineitem where l_shipdate >= '1997-01-01':date and l_shipdate < '1998-01-01':date and l_discount between 0.05 and 0.07 and l_quantity < 24 agg revenue = (l_extendedprice * l_discount).sum.round(2)", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"),
    "q13_orders_each": ("from customer left join orders on c_custkey = o_custkey and o_orderpriority not like '1%' group by c_custkey agg c = count(o_orderkey) group by c agg n = _.count", "SELECT c, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY 1) GROUP BY 1"),
    "q14_promotion": ("from lineitem join part on l_partkey = p_partkey where l_shipdate >= '1997-09-01':date and l_shipdate < '1997-10-01':date select share = (100.0::double * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount))).round(6)", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'"),
    "q17_small_quantity": ("from lineitem as l join part as p on l.l_partkey = p.p_partkey where p.p_brand = 'Brand#3' and l.l_quantity < { from lineitem as i where i.l_partkey = p.p_partkey select i.l_quantity.avg * 0.3 } select yearly = (l_extendedprice.sum / 7).round(4)", "SELECT round(sum(l_extendedprice) / 7, 4) AS yearly FROM lineitem l JOIN part p ON l_partkey = p_partkey WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT avg(i.l_quantity) * 0.3 FROM lineitem i WHERE i.l_partkey = p.p_partkey)"),
    "q18_large_orders": ("from orders where o_orderkey in (from lineitem group by l_orderkey where l_quantity.sum > 200 select l_orderkey) join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey group by c_name, o_orderkey, o_totalprice agg q = l_quantity.sum", "SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) GROUP BY 1, 2, 3"),
}
#: Flows: the summary relation of a run.
FLOWS = {
    "l1_flow": ("flow sales(least: double = 400000, status: string) = { stage big = from orders where o_totalprice > least and o_orderstatus = status\n stage per = from big group by o_custkey agg n = _.count\n stage out = from per where n > 0 }\nrun flow sales(status = 'F')", "SELECT unnest(['big', 'per', 'out']) AS stage, 'success' AS state, 1::BIGINT AS attempts, NULL::VARCHAR AS error"),
    "l3_triggers": ("flow f = { stage bad = from no_such_table_here\n stage fix if bad.failed = from region\n stage next = from bad\n stage last if bad.done and (fix.done or next.failed) = from nation }\nrun flow f | select stage, state, attempts", "SELECT * FROM (VALUES ('bad', 'failed', 1::BIGINT), ('fix', 'success', 1), ('next', 'skipped', 0), ('last', 'success', 1)) t(stage, state, attempts)"),
    "l4_route": ("flow f = { stage src = from [[1, 25], [2, null], [3, 40], [4, 3]] as t(id, age)\n stage gate = from src | route { case _.age > 30 -> old case _.age >= 18 -> adult else -> rest }\n stage old = from gate | save to {t}old\n stage adult = from gate | save to {t}adult\n stage rest = from gate | save to {t}rest }\nrun flow f; from {t}old add kind = 'old' concat { from {t}adult add kind = 'adult' } concat { from {t}rest add kind = 'rest' }", "SELECT * FROM (VALUES (1, 25, 'adult'), (2, NULL, 'rest'), (3, 40, 'old'), (4, 3, 'rest')) t(id, age, kind)"),
    "l5_route_by": ("flow f = { stage src = from customer\n stage gate = from src | route by c_custkey { case 30 -> a case 20 -> b else -> c }\n stage a = from gate agg n = _.count | save to {t}a\n stage b = from gate agg n = _.count | save to {t}b\n stage c = from gate agg n = _.count | save to {t}c }\nrun flow f; from {t}a concat { from {t}b } concat { from {t}c }", "SELECT count(*) AS n FROM customer GROUP BY CASE WHEN c_custkey % 100 < 30 THEN 1 WHEN c_custkey % 100 < 50 THEN 2 ELSE 3 END"),
    "l6_fork": ("flow f = { stage entry = from region\n stage both = from entry | fork { stage x = from entry | activate('nowhere')\n stage y = from entry | end() } }\nrun flow f | select stage, state", "SELECT unnest(['entry', 'both', 'x', 'y']) AS stage, 'success' AS state"),
    "l7_merge": ("flow f = { stage a = from nation where n_regionkey = 1\n stage b = from nation where n_regionkey = 2\n stage m = merge a, b | save to {t}m }\nrun flow f; from {t}m select n_name", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)"),
    "l8_wait": ("flow f = { stage a = from nation\n stage w = from a | wait('20 ms')\n stage s with { poll_interval: 5ms, timeout: 30s } = from w | wait until _.n_nationkey = 3 | select n_name }\nrun flow f | select stage, state", "SELECT unnest(['a', 'w', 's']) AS stage, 'success' AS state"),
    "l9_activate": ("flow f = { stage a = from nation where n_regionkey = 3 | activate('file', path: '{tmp}/out.csv') }\nrun flow f; from '{tmp}/out.csv' select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 3"),
    "l10_jump": ("flow g = { stage z = from region | save to {t}z }\nflow f = { stage a = from region | -> g }\nrun flow f; from {t}z select r_name", "SELECT r_name FROM region"),
    "l11_summary": ("flow f = { stage a = from region\n stage b = from a }\nrun flow f | where state = 'success' | count", "SELECT 2::BIGINT AS count"),
    "l12_retries": ("flow f = { stage a with { retries: 2, retry_delay: 1ms, backoff: 'linear' } = from no_such_table_here }\nrun flow f | select stage, state, attempts", "SELECT 'a' AS stage, 'failed' AS state, 3::BIGINT AS attempts"),
    "l14_run_time": ("flow f(k: int = 3) = { stage a = from nation where n_nationkey < k select n_name, d = length(run_date), ok = run_time > '2020-01-01':timestamp | save to {t}a }\nrun flow f(k = 2); from {t}a", "SELECT n_name, 10 AS d, true AS ok FROM nation WHERE n_nationkey < 2"),
    "l17_stage_tables": ("flow f = { stage first = from nation where n_regionkey = 4\n stage second = from first as s where s.n_nationkey > 5 select first_name = s.n_name | save to {t}x }\nrun flow f; from {t}x", "SELECT n_name AS first_name FROM nation WHERE n_regionkey = 4 AND n_nationkey > 5"),
}
