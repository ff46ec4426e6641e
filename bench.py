"""

``queries`` has text to last row; ``compile`` is the part from text to frame.  ``duckdb`` has the same queries' SQL in DuckDB on the same
files, with as many threads, where the package is there.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from brookql import catalog_queries as cq

NAMES = (
    "q1_pricing", "p_where_select", "p_columns", "a_having", "j_inner", "a_pivot", "o_set_except", "n_window", "b_in_query",
    "q3_shipping", "q4_priority", "q5_local_suppliers", "q6_forecast", "q13_orders_each", "q14_promotion", "q17_small_quantity", "q18_large_orders",
    "j10_asof", "j10_asof_no_keys", "a8_cube", "n8_aggregate_window", "t3_windows",
)
RUNS = 5


def timed(run) -> list[float]:
    out = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return out[1:]


def against(sf: str, cpus: str) -> dict[str, float]:
    try:
        import duckdb
    except ImportError:
        return {}
    con = duckdb.connect(config={"threads": int(cpus)})
    for t in cq.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return {n: round(statistics.median(timed(lambda: con.sql(cq.ORACLE_SQL[n]).fetchall())), 4) for n in NAMES}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, compiling = {}, {}
    for name in NAMES:
        parts = []

        def run() -> None:
            began = time.perf_counter()
            df = cq.QUERIES[name](spark, sf)
            parts.append(time.perf_counter() - began)
            df.write.format("noop").mode("overwrite").save()

        times[name] = round(statistics.median(timed(run)), 3)
        compiling[name] = round(statistics.median(parts[1:]), 3)
    print(json.dumps({"metric": "total of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "compile": compiling, "duckdb": against(sf, cpus)}))


if __name__ == "__main__":
    main()
