"""Scans, sources and writes."""

SOURCES = {
    "s1_table": ("from region select r_regionkey, r_name", "SELECT r_regionkey, r_name FROM region"),
    "s2_parquet_file": ("from '{sf}/orders.parquet' where o_orderkey < 100 select o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 100"),
    "s3_json_file": ("from nation save to '{tmp}/n.json'; from '{tmp}/n.json' where n_regionkey = 1", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey = 1"),
    "s4_csv_file": ("from customer where c_custkey < 40 save to '{tmp}/c.csv' with single: true; from '{tmp}/c.csv' select c_custkey, c_name, c_acctbal", "SELECT c_custkey::INT AS c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 40"),
    "s5_glob": ("from '{sf}/natio*.parquet' select n_name", "SELECT n_name FROM nation"),
    "s6_remote": ("from 'file://{sf}/region.parquet' select r_name", "SELECT r_name FROM region"),
    "s7_query_file": ("from [['from nation where n_regionkey = 2 select n_name']] as t(value) save to '{tmp}/q.flow' with single: true, format: text; from '{tmp}/q.flow'", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "s8_inline_values": ("from [[1, 'a', 1.5], [2, 'b', null], [3, null, 2.5],] as t(id, name, x) where id > 1 select id, name, x = x::double", "SELECT id, name, x::DOUBLE AS x FROM (VALUES (1, 'a', 1.5), (2, 'b', NULL), (3, NULL, 2.5)) t(id, name, x) WHERE id > 1"),
    "s9_table_constant": ("val t(id: int, name) = [[1, 'x'], [2, 'y'],]\nfrom t join nation on t.id = nation.n_nationkey select t.name, nation.n_name", "SELECT name, n_name FROM (VALUES (1, 'x'), (2, 'y')) t(id, name) JOIN nation ON id = n_nationkey"),
    "s9_empty_constant": ("val t(id: int, name) = []\nfrom t count", "SELECT 0::BIGINT AS count"),
    "s10_values": ("sql: values (1, 'a'), (2, null) as v(n, s)", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(n, s)"),
    "s11_raw_sql": ("val least = 20\nfrom sql\"select n_regionkey, count(*) as n from nation where n_nationkey < ${least} group by n_regionkey\" where n > 1", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY 1 HAVING count(*) > 1"),
    "s12_raw_json": ('from json"""[{"id": 1, "name": "a"}, {"id": 2, "name": null}]"""', "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, NULL)) t(id, name)"),
    "s13_table_function": ("from range(3, 7) as r select n = id * 2", "SELECT range * 2 AS n FROM range(3, 7)"),
    "s14_model": ("model big(least: int, status: string = 'F') = { from orders where o_totalprice > least and o_orderstatus = status }\nfrom big(300000) select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'"),
    "s14_model_by_name": ("model near(k: int, width: int = 1) = { from nation where n_nationkey between k - width and k + width }\nfrom near(width = 2, k = 10) select n_name", "SELECT n_name FROM nation WHERE n_nationkey BETWEEN 8 AND 12"),
    "s15_unnest": ("from unnest([10, 20, null]) as t(x) select x", "SELECT unnest([10, 20, NULL]) AS x"),
    "s16_ordinality": ("sql: select x, y, n from unnest(array['a', 'b', 'c'], array[10, 20]) with ordinality as t(x, y, n)", "SELECT * FROM (VALUES ('a', 10, 1::BIGINT), ('b', 20, 2), ('c', NULL, 3)) t(x, y, n)"),
    "s16_unnest_column": ("sql: select doc_id, word, n from documents cross join unnest(split(text, ' ')) with ordinality as t(word, n) where doc_id < 5 and n <= 3", "SELECT doc_id, w[i] AS word, i AS n FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(1, 4)) AS i FROM documents WHERE doc_id < 5) WHERE i <= len(w)"),
    "s17_lateral": ("sql: select n_name, c.top from nation, lateral (select max(c_acctbal) as top from customer where c_nationkey = n_nationkey) c", "SELECT n_name, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation"),
    "s18_lateral_view": ("sql: select r_name, x from region lateral view explode(sequence(1, r_regionkey + 1)) t as x", "SELECT r_name, unnest(range(1, r_regionkey + 2))::INT AS x FROM region"),
    "s18_lateral_view_outer": ("sql: select r_name, x from region lateral view outer explode(if(r_regionkey = 0, array(), array(r_regionkey))) t as x", "SELECT r_name, CASE WHEN r_regionkey > 0 THEN r_regionkey END AS x FROM region"),
    "s19_braces": ("{ from nation where n_regionkey = 1 } where n_nationkey > 5 select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5"),
    "s20_comma": ("from nation as n, region as r where n.n_regionkey = r.r_regionkey and r.r_name = 'EUROPE' select n.n_name", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'EUROPE'"),
    "s21_cte": ("with big(k, total) as { from orders group by o_custkey agg o_totalprice.sum.round(2) as total } with few as { from big where total > 3000000 } from few select k, total", "SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING round(sum(o_totalprice), 2) > 3000000"),
    "s21_cte_values": ("with t(a, b) as [[1, 'x'], [2, 'y']] from t select a, b", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)"),
    "s22_recursive_cte": ("sql: with recursive r(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from r where n < 10) select n, f from r", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r"),
    "s23_no_from": ("select a = 1 + 1, b = 'x'", "SELECT 2 AS a, 'x' AS b"),
    "s24_alias_columns": ("from region as r(k, name) where r.k > 2 select r.name, k", "SELECT r_name AS name, r_regionkey AS k FROM region WHERE r_regionkey > 2"),
    "s25_interpolated_name": ("val what = 'ion'\nfrom s`reg${what}` select r_name", "SELECT r_name FROM region"),
    "w1_save": ("from nation where n_regionkey = 3 save to {t}a; from {t}a where n_nationkey > 5 save to {t}a; from {t}a", "SELECT * FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5"),
    "w2_save_file": ("from nation save to '{tmp}/n.parquet' with compression: 'zstd'; from '{tmp}/n.parquet' where n_regionkey = 4", "SELECT * FROM nation WHERE n_regionkey = 4"),
    "w3_append": ("from nation where n_regionkey = 1 append to {t}a; from nation where n_regionkey = 2 append to {t}a; from {t}a append to {t}a; from {t}a", "SELECT * FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT * FROM nation WHERE n_regionkey IN (1, 2)"),
    "w3_append_columns": ("from nation where n_regionkey = 1 save to {t}a; from [['new', 99]] as x(a, b) append to {t}a(n_name, n_nationkey); from {t}a", "SELECT * FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 99, 'new', NULL"),
    "w4_append_file": ("from nation where n_regionkey = 1 save to '{tmp}/n.csv' with single: true; from nation where n_regionkey = 2 append to '{tmp}/n.csv'; from '{tmp}/n.csv' select n_name", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)"),
    "w5_delete": ("from nation save to {t}a; from {t}a where n_regionkey = 1 where n_nationkey > 3 | delete; from {t}a", "SELECT * FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey > 3)"),
    "w5_delete_sql": ("sql: create table {t}a as select n_nationkey, nullif(n_regionkey, 2) as r from nation; delete from {t}a where r < 3; select * from {t}a", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation WHERE n_regionkey >= 2"),
    "w6_ctas": ("sql: create table {t}a as select 1 as x; create table if not exists {t}a as select 2 as x; create or replace table {t}b as select x + 10 as x from {t}a; select * from {t}b union all select * from {t}a", "SELECT unnest([11, 1]) AS x"),
    "w7_insert": ("sql: create table {t}a (k int, v string default 'none'); insert into {t}a values (1, 'a'); insert into {t}a (k) select n_nationkey from nation where n_nationkey > 22; select * from {t}a", "SELECT * FROM (VALUES (1, 'a'), (23, 'none'), (24, 'none')) t(k, v)"),
    "w8_insert_overwrite": ("sql: create table {t}a as select 1 as x; insert overwrite table {t}a select n_nationkey from nation where n_nationkey < 3; select * from {t}a", "SELECT unnest([0, 1, 2]) AS x"),
    "w9_update": ("sql: create table {t}a as select n_nationkey, n_name, n_regionkey from nation; update {t}a as a set n_name = concat(n_name, '!'), n_regionkey = a.n_regionkey + 10 where n_regionkey = 1; select * from {t}a", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "w10_merge": ("sql: create table {t}a as select n_nationkey as k, n_name as v from nation where n_nationkey < 10; merge into {t}a as t using (select n_nationkey as k, concat('new ', n_name) as v from nation where n_nationkey between 5 and 12) as s on t.k = s.k when matched and s.k = 5 then delete when matched then update set v = s.v when not matched and s.k > 10 then insert (k, v) values (s.k, s.v); select * from {t}a", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 5 THEN 'new ' || n_name ELSE n_name END AS v FROM nation WHERE n_nationkey < 13 AND n_nationkey NOT IN (5, 10)"),
    "w11_upsert": ("sql: create table {t}a (k int, v string); insert into {t}a values (1, 'a'), (2, 'b'); upsert into {t}a values (2, 'B'), (3, 'C'); select * from {t}a", "SELECT * FROM (VALUES (1, 'a'), (2, 'B'), (3, 'C')) t(k, v)"),
    "w12_truncate": ("sql: create table {t}a as select 1 as x; truncate table {t}a; insert into {t}a values (7); select * from {t}a", "SELECT 7 AS x"),
    "w13_distribute": ("sql: select n_name, n_regionkey from nation distribute by n_regionkey sort by n_name", "SELECT n_name, n_regionkey FROM nation"),
    "w13_cluster": ("sql: select n_name from nation cluster by n_name", "SELECT n_name FROM nation"),
    "w14_ddl": ("sql: create schema if not exists {t}s; create table {t}s.a (k int not null comment 'key', v varchar(5), d double precision); insert into {t}s.a values (1, 'x', 0.5); create table {t}s.b like {t}s.a; create view {t}s.v as select k, d from {t}s.a; create table {t}r as select * from {t}s.v; drop view {t}s.v; drop table {t}s.b; drop table {t}s.a; drop schema {t}s; select * from {t}r", "SELECT 1 AS k, 0.5::DOUBLE AS d"),
    "w15_alter": ("sql: create table {t}a (a int, b int, c string); insert into {t}a values (1, 2, 'x'); alter table {t}a rename column a to k; alter table {t}a drop column b; alter table {t}a add column d bigint; alter table {t}a alter column k set data type bigint; alter table {t}a rename to {t}z; select * from {t}z", "SELECT 1::BIGINT AS k, 'x' AS c, NULL::BIGINT AS d"),
    "w16_settings": ("sql: set session spark.sql.session.timeZone = 'Asia/Tokyo'; set session spark.sql.session.timeZone = 'UTC'; select current_timezone() as z", "SELECT 'UTC' AS z"),
    "w17_prepared": ("sql: prepare q from select n_name from nation where n_nationkey between ? and ? and n_regionkey <> $1; execute q using 3, 8", "SELECT n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 8 AND n_regionkey <> 3"),
    "s3_json_lines": ('from json"""{"b": 1, "a": "x"}\n{"b": 2, "a": null}""" select b, a', "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, NULL)) t(b, a)"),
}
