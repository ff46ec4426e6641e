"""Registered queries of the flow language and of SQL input over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .entries.expressions import EXPRESSIONS, FLOWS
from .entries.relations import RELATIONS
from .entries.sources import SOURCES
from .session import Session
from .sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: name -> (text, SQL or None)
PAIRS = {
    "q1_pricing": (
        "from lineitem where l_shipdate <= '1998-09-02':date group by l_returnflag, l_linestatus "
        "agg l_quantity.sum.round(2) as sum_qty, l_extendedprice.avg.round(2) as avg_price, _.count as n order by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n "
        "FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
    ),
    "p_where_select": (
        "from orders where o_totalprice > 200000 and o_orderstatus = 'F' select o_orderkey as k, cents = (o_totalprice * 100).to_int",
        "SELECT o_orderkey AS k, CAST(o_totalprice * 100 AS BIGINT) AS cents FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'",
    ),
    "p_columns": (
        "from nation add n_nationkey + 1 as next exclude n_regionkey rename n_name as name shift to left name",
        "SELECT n_name AS name, n_nationkey, n_nationkey + 1 AS next FROM nation",
    ),
    "a_having": (
        "from orders group by o_custkey where _.count > 15 agg _.count as n",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    ),
    "j_inner": (
        "from nation as n join region as r on n.n_regionkey = r.r_regionkey select n.n_name as nation, r.r_name as region",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "a_pivot": (
        "from orders pivot on o_orderstatus in ('F', 'O', 'P') group by o_orderpriority",
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    ),
    "o_set_except": (
        "from customer select c_custkey except { from orders where o_totalprice > 300000 select o_custkey }",
        "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    ),
    "n_window": (
        "from events select event_id, user_id, rn = row_number() over (partition by user_id order by ts, event_id)",
        "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
    ),
    "b_in_query": (
        "from nation where n_regionkey in (from region where r_name = 'ASIA' select r_regionkey) select n_name",
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
    ),
    **SOURCES,
    **RELATIONS,
    **EXPRESSIONS,
    **FLOWS,
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session whose tables are opened when they are first read."""
    s = Session(spark)
    for t in TABLES:
        s.register(t, lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return s


def _run(s: Session, text: str) -> DataFrame:
    return s.sql(text.removeprefix("sql:")) if text.startswith("sql:") else s.run(text)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, own = session(spark, sf_dir), text.replace("{sf}", sf_dir)
        if "{t}" not in own and "{tmp}" not in own and "flow " not in own:
            return _run(s, own)
        mark = f"brook_{uuid.uuid4().hex[:8]}_"
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/{mark}files"
        try:
            df = _run(s, own.replace("{t}", mark).replace("{tmp}", folder))
            return spark.createDataFrame(df.collect(), df.schema)  # small, and its tables go now
        finally:
            for r in s.store.runs() if s.store else ():
                for stage in r["stages"]:
                    if stage["table"]:
                        spark.sql(f"drop table if exists {stage['table']}")
            for name in [t.name for t in spark.catalog.listTables() if t.name.startswith(mark)]:
                spark.sql(f"drop table if exists {name}")
            fs, path = files._path(spark, folder)
            fs.delete(path, True)

    return run


QUERIES = {name: _query(text) for name, (text, _) in PAIRS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in PAIRS.items() if sql is not None}
