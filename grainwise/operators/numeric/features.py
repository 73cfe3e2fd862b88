"""Features: checks, circular encoding, complete rows and scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.expressions import circular
from ...grain import Relation, RequestError
from ...presets import CIRCULAR_FIELDS, IDENTIFIER_COLUMNS

LEAST_ROWS = 100


def reject_identifiers(fields: list[str]) -> None:
    bad = sorted(set(fields) & set(IDENTIFIER_COLUMNS))
    if bad:
        raise RequestError(f"identifiers are no features: {', '.join(bad)}")


def guarded(rel: Relation, most: int | None = None) -> Relation:
    """Refuse inputs that are empty or have more rows than a request allows, where it says how many; nothing is cut."""
    most = max(LEAST_ROWS, int(most)) if most else None
    n = rel.df.limit(most + 1 if most else 1).count()
    if not n:
        raise RequestError("the input has no rows")
    if most and n > most:
        raise RequestError(f"the input has more than {most} rows")
    return rel


def encode(rel: Relation, fields: list[str]) -> tuple[Relation, list[str]]:
    """Angles become sine and cosine beside the original; the features' names after that."""
    rel.need(*fields)
    new, out = {}, []
    for f in fields:
        if f in CIRCULAR_FIELDS:
            parts = circular(f)
            new |= parts
            out += parts
        else:
            out.append(f)
    return (rel.with_df(rel.df.withColumns(new)) if new else rel), out


def finite(name: str) -> Column:
    x = F.col(name).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def complete(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [finite(f) for f in fields]))


def complete_counts(rel: Relation, partition: list[str], fields: list[str]) -> DataFrame:
    """Rows with all features per partition; null keys don't count, partitions without such rows do."""
    whole = reduce(lambda a, b: a & b, [finite(f) for f in fields])
    return rel.df.dropna(subset=partition).groupBy(*partition).agg(F.count(F.when(whole, 1)).alias("complete_rows"))


def circle_pairs(fields: list[str]) -> dict[str, str]:
    """The other half of each sine or cosine whose pair is there."""
    out = {}
    for f in fields:
        if f.endswith("_sin") and f[:-4] + "_cos" in fields:
            out |= {f: f[:-4] + "_cos", f[:-4] + "_cos": f}
    return out


def standardised(rel: Relation, fields: list[str], partition: list[str] | None = None, suffix: str = "_z") -> Relation:
    """Fields less their mean over their population deviation, in each partition. A zero deviation counts as 1; sine and cosine of
    an angle share one scale, the root of their variances' mean."""
    pairs, w = circle_pairs(fields), Window.partitionBy(*(partition or []))
    out = {}
    for f in fields:
        spread = F.var_pop(f).over(w)
        if f in pairs:
            spread = (spread + F.var_pop(pairs[f]).over(w)) / 2
        scale = F.sqrt(spread)
        scale = F.when((scale > 0) & ~F.isnan(scale), scale).otherwise(F.lit(1.0))
        out[f + suffix] = (F.col(f) - F.avg(f).over(w)) / scale
    return rel.with_df(rel.df.withColumns(out))
