"""Relational operators as functions of DataFrames that expressions, already Spark SQL text, are put into."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shift(df: DataFrame, side: str, names: list[str]) -> DataFrame:
    """Move columns to the left or right end, in the order given."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*([*names, *rest] if side == "left" else [*rest, *names]))


def rename(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumnsRenamed(dict(pairs))


def first_of_group(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Grouping without aggregates: the keys and any value of each other column."""
    names = {n for n, _ in keys}
    rest = [F.any_value(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in names]
    grouped = df.groupBy(*[F.expr(e).alias(n) for n, e in keys])
    return grouped.agg(*rest) if rest else grouped.agg(F.lit(1).alias("_")).drop("_")


MOST_COLUMNS = 10_000


def pivot(df: DataFrame, on: list[tuple[str, list | None]], by: list[tuple[str, str]], aggregates: list[tuple[str, str]]) -> DataFrame:
    """Values of the ``on`` columns become columns; counts of absent cells are 0, null values make none.

    Several columns make one for each combination, named by the values joined with ``_``; two combinations of one name are an error.
    """
    single = len(aggregates) <= 1
    aggregates = aggregates or [("count", "count(1)")]
    keys = [F.expr(e).alias(n) for n, e in by] if by else [F.col(f"`{c}`") for c in df.columns if c not in {k for k, _ in on}]
    texts = [F.col(f"`{k}`").cast("string") for k, _ in on]
    if all(v is not None for _, v in on):
        combos = [[str(x) for x in c] for c in itertools.product(*[v for _, v in on])]
    else:
        given = [F.col(f"`{k}`").cast("string").isin([str(x) for x in v]) for k, v in on if v is not None]
        some = df.where(functools.reduce(lambda a, b: a & b, given)) if given else df
        combos = sorted(list(r) for r in some.select(*texts).dropna().distinct().limit(MOST_COLUMNS + 1).collect())
        if len(combos) > MOST_COLUMNS:
            raise ValueError(f"a pivot makes at most {MOST_COLUMNS} columns")
    names = ["_".join(c) for c in combos]
    if len(set(names)) < len(names):
        raise ValueError(f"two columns of the pivot would have one name: {sorted(n for n in set(names) if names.count(n) > 1)[0]}")
    key = "_pivot_key"
    places = [str(i) for i in range(len(combos))]
    at = F.create_map(*[x for i, c in enumerate(combos) for x in (F.to_json(F.array(*[F.lit(v) for v in c])), F.lit(str(i)))]) if combos else None
    df = df.withColumn(key, F.try_element_at(at, F.to_json(F.array(*texts))) if combos else F.lit(None).cast("string"))
    grouped = df.groupBy(*keys).pivot(key, places or ["none"])
    out = grouped.agg(*[F.expr(e).alias(n) for n, e in aggregates])
    held = out.columns[: len(keys)]
    cols = [F.col(f"`{c}`") for c in held]
    for i, name in enumerate(names):
        for n, e in aggregates:
            c = F.col(f"`{i}`" if len(aggregates) == 1 else f"`{i}_{n}`")
            cols.append((F.coalesce(c, F.lit(0)) if e.startswith(("count(", "count_if(")) else c).alias(name if single else f"{name}_{n}"))
    return out.select(*cols)


def unpivot(df: DataFrame, value: str, name: str, columns: list[str]) -> DataFrame:
    """Columns become rows; nulls are left out."""
    return df.unpivot([c for c in df.columns if c not in columns], columns, name, value).where(F.col(value).isNotNull())


def sample(df: DataFrame, method: str, size: float, percent: bool) -> DataFrame:
    """``bernoulli`` and ``system`` take each row with the same chance (``system`` goes by blocks elsewhere; file splits aren't
    fair samples, so here it doesn't); ``reservoir`` takes an exact number, or an exact share, of rows."""
    if method == "reservoir":
        n = int(size) if not percent else round(df.count() * size / 100)
        return df.orderBy(F.rand()).limit(n)
    if not percent:
        return df.limit(int(size)) if method == "system" else df.orderBy(F.rand()).limit(int(size))
    return df.sample(size / 100)


#: Ranges of time that an AS-OF join is cut into where one key, or none, may hold very much; and the size it is done from.
RANGES, SPLIT_BYTES = 256, 1 << 30


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def asof_join(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], times: tuple[str, str, str], how: str, split: bool | None = None) -> DataFrame:
    """Each left row with the nearest right row of equal keys whose time is not after (``<=``, ``<``) or not before it.

    One shuffle and no growth: both sides are put under each other and the last right row before each left row is carried
    down.  Null keys and times never match; an inner join drops left rows without a match.  Without keys, or on much data, time
    is cut into ranges that are worked on side by side, and each range's last right row is carried into the next ones.
    """
    lt, op, rt = times  # left time, operator of right against left, right time
    names_l, names_r = [f"l{i}" for i in range(len(left.columns))], [f"r{i}" for i in range(len(right.columns))]
    keys = [f"k{i}" for i in range(len(equal))]
    a = left.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, names_l)]).alias("l"), *[F.expr(x).alias(k) for (x, _), k in zip(equal, keys)], F.expr(lt).alias("t"))
    b = right.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(right.columns, names_r)]).alias("r"), *[F.expr(y).alias(k) for (_, y), k in zip(equal, keys)], F.expr(rt).alias("t"))
    b = b.dropna(subset=[*keys, "t"])
    strict, backward = op in ("<", ">"), op in ("<", "<=")
    # right rows stand before left rows of the same time unless equality doesn't count
    both = a.withColumn("side", F.lit(0 if strict else 1)).unionByName(b.withColumn("side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    order = [F.col("t").asc_nulls_first() if backward else F.col("t").desc_nulls_first(), F.col("side")]
    if split is None:
        split = not keys or _bytes(left) + _bytes(right) >= SPLIT_BYTES
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not split:
        out = both.withColumn("m", F.last("r", ignorenulls=True).over(w)).where("l is not null")
    else:
        out = _carried(both, keys, order, backward)
    if keys:
        out = out.withColumn("m", F.when(F.col("t").isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.col("m")))
    else:
        out = out.withColumn("m", F.when(F.col("t").isNotNull(), F.col("m")))
    if how == "inner":
        out = out.where("m is not null")
    return out.select(*[F.col(f"l.{n}").alias(c) for c, n in zip(left.columns, names_l)], *[F.col(f"m.{n}").alias(c) for c, n in zip(right.columns, names_r)])


def _carried(both: DataFrame, keys: list[str], order: list, backward: bool) -> DataFrame:
    """Left rows with ``m``, the last right row before each: found within its range of time, else brought from the ranges before."""
    cuts = both.agg(F.percentile_approx("t", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("c")).first()[0]  # at most RANGES values
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast(f"array<{dict(both.dtypes)['t']}>")
    place = F.when(F.col("t").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("t"))))
    both = both.withColumn("b", place if backward else -place)
    by = [*keys, "b"]
    within = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("m", F.last("r", ignorenulls=True).over(within)).where("l is not null")
    spans = both.groupBy(*by).agg((F.max_by if backward else F.min_by)(F.col("r"), F.when(F.col("r").isNotNull(), F.col("t"))).alias("e"))
    before = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.last("e", ignorenulls=True).over(before)).where("before is not null")
    named = spans.select(*[F.col(c).alias(f"x_{c}") for c in by], "before")
    on = functools.reduce(lambda a, c: a & (F.col(c) == F.col(f"x_{c}")), by[1:], F.col(by[0]) == F.col(f"x_{by[0]}"))
    return found.join(named, on, "left").withColumn("m", F.coalesce("m", "before"))
