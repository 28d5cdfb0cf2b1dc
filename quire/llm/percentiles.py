"""Exact percentiles per period by radix selection over digit histograms that merge across periods."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small, stage

#: A key has 64 bits and is followed down in digits of BITS bits.
BITS = 16
DIGITS = 64 // BITS
#: Rows up to which the followed prefixes are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Most different percentiles of one call.
PERCENTILES_MOST = 1000


@F.pandas_udf(T.LongType())
def _double_key(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)  # + 0.0 makes -0.0 equal to 0.0
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(T.DoubleType())
def _double_value(k: pd.Series) -> pd.Series:
    k = k.to_numpy(np.int64)
    return pd.Series(np.where(k < 0, k ^ np.int64(2**63 - 1), k).view(np.float64))


def order_key(df: DataFrame, col: str) -> Column:
    """A signed 64-bit integer in the order of the values.

    Integers are their own key. Of doubles the bits are taken; those of negative ones, but for the
    sign, are inverted.
    """
    return F.col(col).cast("long") if isinstance(df.schema[col].dataType, T.IntegralType) else _double_key(F.col(col).cast("double"))


def _prefix(key: Column, digits: int) -> Column:
    """The key without its lower bits: floor(key / 2^k) keeps the order of signed keys."""
    left = 64 - BITS * digits
    return F.shiftright(key, left) if left else key


def histograms(df: DataFrame, base: str, value: str) -> DataFrame:
    """(base, key, n): how often each value, as its ordered key, occurs in each base period.

    What is to be stored of a day: those of other days, or of later rows of the same, are merged
    with it by :func:`merged`, without the values. Rows with a null base or value are left out, NaN too.
    """
    real = F.col(value).isNotNull() if isinstance(df.schema[value].dataType, T.IntegralType) else F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(real & F.col(base).isNotNull()).select(F.col(base).alias("base"), order_key(df, value).alias("key")).groupBy("base", "key").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """The histograms of several partitions or days as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("base", "key").agg(F.sum("n").alias("n"))


def digit_histogram(values: DataFrame, digits: int, followed: DataFrame | None = None) -> DataFrame:
    """(base, p, n) over histograms (base, key, n): how many keys of a base period have the leading digits p.

    With ``followed`` (base, q) only keys whose leading digits but one are q count.
    """
    if followed is not None:
        values = values.withColumn("q", _prefix(F.col("key"), digits - 1)).join(small(followed, BROADCAST_ROWS), ["base", "q"], "left_semi")
    return values.groupBy("base", _prefix(F.col("key"), digits).alias("p")).agg(F.sum("n").alias("n"))


def radix_percentiles(values: DataFrame, periods: DataFrame, pcts: DataFrame, least: int = 1, double: bool = False) -> DataFrame:
    """(grain, period, pct, n, value): the smallest value not exceeded by at least pct % of a period's values.

    ``values`` are the :func:`histograms` of base periods (such as days), ``double`` tells that they
    are of floating values; ``periods`` (base, grain, period) says of which periods a base period is
    a part, and pcts (pct) which percentiles are wanted. All longer periods come from adding the
    histograms of their base periods. Of each digit only the one that holds the target rank is
    followed, so after the last digit the value is exact; leading digits that all keys share need no
    pass. Periods with fewer than ``least`` values give no row.
    """
    values = values if getattr(values, "_quire_staged", False) else stage(values)
    periods = periods.select("base", "grain", "period")
    wanted = [r["pct"] for r in pcts.select("pct").where("pct is not null").distinct().orderBy("pct").limit(PERCENTILES_MOST + 1).collect()]
    if not 1 <= len(wanted) <= PERCENTILES_MOST:
        raise ValueError(f"one to {PERCENTILES_MOST} percentiles, please")
    targets: DataFrame | None = None
    low, high = values.agg(F.min("key"), F.max("key")).first()
    same = next((d for d in range(DIGITS) if (low or 0) >> 64 - BITS * (d + 1) != (high or 0) >> 64 - BITS * (d + 1)), DIGITS - 1)
    for d in range(same + 1, DIGITS + 1):
        followed = targets and targets.join(periods, ["grain", "period"]).select("base", "q").distinct()
        merged = digit_histogram(values, d, followed).join(periods, "base").groupBy("grain", "period", "p").agg(F.sum("n").alias("n"))
        if targets is None:
            merged = stage(merged)
            total = merged.groupBy("grain", "period").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
            rank = F.greatest(F.lit(1), F.ceil(F.col("pct").cast("double") * F.col("total") / 100)).cast("long")
            targets = total.withColumn("pct", F.explode(F.array(*map(F.lit, wanted)))).select("grain", "period", "pct", "total", rank.alias("rank"))
            at = merged.join(targets, ["grain", "period"])
        else:
            at = merged.withColumn("q", F.shiftright("p", BITS)).join(targets, ["grain", "period", "q"])
        w = Window.partitionBy("grain", "period", "pct").orderBy("p")
        at = at.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= F.col("rank"))
        hit = at.groupBy("grain", "period", "pct", "total").agg(F.min(F.struct("p", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))).alias("h"))
        targets = stage(hit.select("grain", "period", "pct", "total", F.col("h.p").alias("q"), F.col("h.rank").alias("rank")))
    back = _double_value("q") if double else F.col("q")
    return targets.select("grain", "period", "pct", F.col("total").alias("n"), back.alias("value"))


def calendar(days: DataFrame) -> DataFrame:
    """(base, grain, period): each day as a day and as a part of its ISO week, from distinct dates ``base``."""
    week = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col("base")).cast("int"), F.weekofyear("base"))
    both = F.array(F.struct(F.lit("day").alias("grain"), F.date_format("base", "yyyy-MM-dd").alias("period")), F.struct(F.lit("week").alias("grain"), week.alias("period")))
    return days.select("base", F.inline(both))
