"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fits, stage

#: A key is heavy when it holds at least one in HEAVY_PARTS rows, so there are at most HEAVY_PARTS heavy keys.
HEAVY_PARTS = 100

#: name -> (partial over the rows of a salt, merge of partials, final value of the merged ones)
_FORMS: dict[str, Callable[[str], tuple[list[tuple[str, Column]], list[tuple[str, Column]], Column]]] = {
    "count": lambda c: ([("n", F.count("*") if c == "*" else F.count(c))], [("n", F.sum("n"))], F.col("n")),
    "sum": lambda c: ([("s", F.sum(c))], [("s", F.sum("s"))], F.col("s")),
    "min": lambda c: ([("m", F.min(c))], [("m", F.min("m"))], F.col("m")),
    "max": lambda c: ([("m", F.max(c))], [("m", F.max("m"))], F.col("m")),
    # equal values get one salt, so distinct values add up
    "distinct": lambda c: ([("n", F.countDistinct(c))], [("n", F.sum("n"))], F.col("n")),
    "avg": lambda c: ([("s", F.sum(F.col(c).cast("double"))), ("n", F.count(c))], [("s", F.sum("s")), ("n", F.sum("n"))], F.try_divide(F.col("s"), F.col("n"))),
}


#: Rows of the sample that tells which keys are heavy; it decides about speed only, never about rows.
SAMPLE_ROWS = 100_000


def heavy_keys(df: DataFrame, key: str, parts: int = HEAVY_PARTS) -> list:
    """The keys that hold about one in ``parts`` rows: at most 2 * ``parts`` values reach the driver.

    Taken from a sample of about SAMPLE_ROWS rows, in which a key counts from half that share on, so
    that none is missed by chance. A small input is its own sample. Null is no key.
    """
    keys = df.select(F.col(key).alias("k"))
    n = keys.count()
    seen = (keys if n <= SAMPLE_ROWS else keys.sample(SAMPLE_ROWS / n, 11)).groupBy("k").agg(F.count("*").alias("n"))
    least = min(n, SAMPLE_ROWS) / (parts if n <= SAMPLE_ROWS else 2 * parts)
    # at most 2 * parts rows reach the share, and two of them for what the sample exceeds its size by
    return [r["k"] for r in seen.where((F.col("n") >= least) & F.col("k").isNotNull()).orderBy(F.desc("n"), "k").limit(2 * parts).collect()]


def salted_aggregate(df: DataFrame, key: str, aggs: dict[str, tuple[str, str]], salts: int = 32, salt_by: str | None = None, heavy: list | None = None) -> DataFrame:
    """One row per key with ``aggs`` {name: (function, column)}, without a task per heavy key.

    Rows of heavy keys get a salt, partial results are computed by (key, salt) and merged by key.
    Functions: count, sum, min, max, avg, distinct (``("count", "*")`` counts rows). Partials of
    count(distinct) don't combine, so it is salted by its own column: ``salt_by`` must name that
    column, and one call can have only one such. A null key is a group of
    its own, as in GROUP BY; null values are skipped by all but count(*); an empty input gives no
    row. ``salt_by`` names a column whose hash is the salt (the same on a retry); where it is not
    given the hash of the row's columns is taken. Columns not named are not read.
    """
    if any(f == "distinct" and c != salt_by for f, c in aggs.values()):
        raise ValueError("distinct values are counted of the column salt_by only")
    used = list(dict.fromkeys([key, *[c for _, c in aggs.values() if c != "*"], *([salt_by] if salt_by else [])]))
    d = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(used)])
    name = {c: f"v{i}" for i, c in enumerate(used)}
    heavy = heavy_keys(df, key) if heavy is None else heavy
    k = F.col(name[key])
    spread = F.pmod(F.xxhash64(name[salt_by] if salt_by else F.struct(*d.columns)), F.lit(salts)).cast("int")
    d = d.withColumn("salt", F.when(k.isNull() | k.isin(heavy), spread).otherwise(F.lit(0)) if heavy else F.when(k.isNull(), spread).otherwise(F.lit(0)))
    partial, merge, last = [], [], []
    for i, (out, (f, c)) in enumerate(aggs.items()):
        p, m, final = _FORMS[f](name.get(c, c))
        partial += [e.alias(f"a{i}_{n}") for n, e in p]
        merge += [(F.min if f == "min" else F.max if f == "max" else F.sum)(f"a{i}_{n}").alias(f"a{i}_{n}") for n, _ in m]
        last.append((F.try_divide(F.col(f"a{i}_s"), F.col(f"a{i}_n")) if f == "avg" else F.col(f"a{i}_{p[0][0]}")).alias(out))
    two = d.groupBy(name[key], "salt").agg(*partial).groupBy(name[key]).agg(*merge)
    return two.select(k.alias(key), *last)


def key_shares(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n, share) of the distinct items of each key; rows with a null key are left out of both sides."""
    d = df.select(F.col(key).alias("k"), F.col(item).alias("i")).where(F.col("k").isNotNull())
    # a null item is an item of its own
    d = d.withColumn("i", F.struct("i"))
    per = stage(salted_aggregate(d, "k", {"n": ("distinct", "i")}, salt_by="i"))
    total = per.agg(F.sum("n")).first()[0] or 1
    return per.select(F.col("k").alias(key), "n", (F.col("n") / F.lit(total)).alias("share"))


def salted_top(df: DataFrame, key: str, order: list, k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, without a task that sorts a heavy key.

    Rows are salted by their hash, the first k of each (key, salt) are taken, then of these the
    first k of the key: at most ``salts`` * k rows. ``order`` must be total for a defined choice. A
    null key is a group of its own.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = df.withColumn("_salt", salt).withColumn("_r", rank(key, "_salt")).where(F.col("_r") <= k)
    return part.withColumn("_r", rank(key)).where(F.col("_r") <= k).drop("_salt", "_r")


def salted_join(big: DataFrame, other: DataFrame, key: str | list[str], salt_by: str, salts: int = 16, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """Equi-join on ``key`` where some keys of ``big`` are heavy and ``other`` has few rows of each.

    Rows of heavy keys in ``big`` are spread over ``salts`` partitions by the hash of ``salt_by``;
    only the rows of these keys in ``other`` are repeated as often. Several key columns are told
    heavy by their hash. Null keys join nothing; with ``how`` left they are kept, spread like heavy
    ones.
    """
    keys = [key] if isinstance(key, str) else key
    k = F.col(key) if isinstance(key, str) else F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]), F.xxhash64(*keys))
    heavy = heavy_keys(big.select(k.alias("_k")), "_k") if heavy is None else heavy
    if not heavy:
        return big.join(other, keys, how)
    part = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    a = big.withColumn("_salt", F.when(k.isNull() | k.isin(heavy), part).otherwise(F.lit(0)))
    b = other.withColumn("_salt", F.explode(F.when(k.isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def checked_join(big: DataFrame, other: DataFrame, key: str | list[str], salt_by: str, most_rows: int, how: str = "inner") -> DataFrame:
    """Equi-join that broadcasts ``other`` where it is counted to be small and salts the heavy keys of ``big`` where not."""
    other, few = fits(other, most_rows)
    return big.join(F.broadcast(other), key, how) if few else salted_join(big, other, key, salt_by, how=how)
