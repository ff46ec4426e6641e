"""The function and method library: which names are aggregates, and how each is said in Spark SQL."""

from __future__ import annotations

#: Aggregate methods of a column in a group: name -> Spark SQL with {x} for the column and {0}, {1} for arguments.
AGGREGATES = {
    "count": "count(1)",
    "count_distinct": "count(distinct {x})",
    "count_if": "count_if({x})",
    "count_approx_distinct": "approx_count_distinct({x})",
    "arbitrary": "any_value({x})",
    "any": "any_value({x})",
    "any_value": "any_value({x})",
    "min": "min({x})",
    "max": "max({x})",
    "min_by": "min_by({x}, {0})",
    "max_by": "max_by({x}, {0})",
    "to_array": "collect_list({x})",
    "array_agg": "collect_list({x})",
    "sum": "sum({x})",
    "avg": "avg({x})",
    "median": "median({x})",
    "variance": "var_samp({x})",
    "stddev": "stddev_samp({x})",
    "stddev_pop": "stddev_pop({x})",
    "stddev_samp": "stddev_samp({x})",
    "approx_quantile": "percentile_approx({x}, {0})",
    "string_agg": "listagg({x}, {0})",
    "first_value": "first_value({x})",
    "last_value": "last_value({x})",
}
#: Plain calls that aggregate.
AGGREGATE_CALLS = set(AGGREGATES) | {
    "approx_count_distinct", "collect_list", "collect_set", "percentile_approx", "var_samp", "var_pop", "listagg", "grouping", "bool_and",
    "bool_or", "every", "some", "corr", "covar_pop", "covar_samp", "kurtosis", "skewness", "mode", "first", "last", "percentile", "sum_distinct",
}
#: Scalar methods: name -> Spark SQL, with defaults for arguments that are left out.
SCALARS = {
    "to_float": ("cast({x} as double)", ()),
    "to_double": ("cast({x} as double)", ()),
    "to_boolean": ("cast({x} as boolean)", ()),
    "to_string": ("cast({x} as string)", ()),
    "to_date": ("cast({x} as date)", ()),
    "or_else": ("coalesce({x}, {0})", ()),
    "round": ("round({x}, {0})", ("0",)),
    "floor": ("floor({x})", ()),
    "ceil": ("ceil({x})", ()),
    "between": ("({x} between {0} and {1})", ()),
    "trim": ("trim({x})", ()),
    "like": ("({x} like {0})", ()),
    "substring": ("substring({x}, {0}, {1})", ("1", "2147483647")),
    "regexp_like": ("({x} rlike {0})", ()),
    "get": ("try_element_at({x}, {0})", ()),
    "exclude": ("filter({x}, _e -> not array_contains({0}, _e))", ()),
    "join": ("array_join({x}, {0})", ("','",)),
    "list_transform": ("transform({x}, {0})", ()),
    "filter": ("filter({x}, {0})", ()),
    "transform": ("transform({x}, {0})", ()),
    "upper": ("upper({x})", ()),
    "lower": ("lower({x})", ()),
    "contains": ("contains({x}, {0})", ()),
    "starts_with": ("startswith({x}, {0})", ()),
    "ltrim": ("ltrim({x})", ()),
    "rtrim": ("rtrim({x})", ()),
    "reverse": ("reverse({x})", ()),
    "abs": ("abs({x})", ()),
    "sqrt": ("sqrt({x})", ()),
    "year": ("year({x})", ()),
    "month": ("month({x})", ()),
    "day": ("day({x})", ()),
}
#: Functions that Spark knows under another name or form.
CALLS = {
    "list_transform": "transform({0}, {1})",
    "list_filter": "filter({0}, {1})",
    "array_filter": "filter({0}, {1})",
    "list_reduce": "reduce(slice({0}, 2, greatest(size({0}) - 1, 0)), {0}[0], {1})",
    "array_concat": "concat({0}, {1})",
    "regexp_matches": "({0} rlike {1})",
    "starts_with": "startswith({0}, {1})",
    "strlen": "length({0})",
    "count_approx_distinct": "approx_count_distinct({0})",
    "arbitrary": "any_value({0})",
    "hash": "xxhash64({0})",
    "unnest": "explode({0})",
    "day_of_week": "(dayofweek({0}) - 1)",
}
