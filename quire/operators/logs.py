"""Search-log analytics: history, summaries, daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws


def _norm() -> Column:
    return F.lower(trim_ws("query_text"))


def history(logs: DataFrame, user: int, limit: int = 50) -> DataFrame:
    """The latest searches of a user, newest first; ties by the larger log_id."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1 and 200")
    return logs.where(F.col("user_id") == user).orderBy(F.desc_nulls_last("created_at"), F.desc("log_id")).limit(limit)


def page_of_logs(logs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    if skip < 0 or not 1 <= limit <= 500:
        raise ValueError("skip must not be negative, limit within 1 and 500")
    return logs.orderBy(F.desc_nulls_last("created_at"), F.desc("log_id")).offset(skip).limit(limit)


def summary(logs: DataFrame) -> DataFrame:
    """One row: searches, average latency, zero-result and success rate in per cent, distinct queries; 0 for an empty table."""
    zero = F.coalesce("total_results", F.lit(0)) == 0
    one = logs.agg(F.count("*").alias("searches"), F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"), F.count_if(zero).alias("zero_results"), F.countDistinct(F.when(_norm() != "", _norm())).alias("unique_queries"))
    rate = F.coalesce(F.round(F.try_divide(F.col("zero_results") * 100.0, F.col("searches")), 2), F.lit(0.0))
    return one.withColumn("zero_result_rate", rate).withColumn("success_rate", F.when(F.col("searches") == 0, 0.0).otherwise(F.round(100 - F.col("zero_result_rate"), 2)))


def daily(logs: DataFrame, last: Column | None = None, days: int = 7) -> DataFrame:
    """(day, searches, avg_latency_ms) of the ``days`` days up to ``last`` (the newest in the logs), zero-filled."""
    day = logs.select(F.to_date("created_at").alias("day"), "latency_ms")
    end = day.agg((last if last is not None else F.max("day")).alias("d"))
    spine = end.where("d is not null").select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"))).alias("day"))
    per = day.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 2).alias("a"))
    # the spine has one row per day asked for
    return per.join(F.broadcast(spine), "day", "right").select("day", F.coalesce("n", F.lit(0)).alias("searches"), F.coalesce("a", F.lit(0.0)).alias("avg_latency_ms"))


def query_frequency(logs: DataFrame) -> DataFrame:
    return logs.select(_norm().alias("query")).where("query <> ''").groupBy("query").agg(F.count("*").alias("searches"))


def result_rows(logs: DataFrame, first: int = 5) -> DataFrame:
    """(log_id, position, page_id, score) of the first results kept with each search."""
    return logs.select("log_id", F.posexplode(F.slice("top_results", 1, first)).alias("p", "r")).select("log_id", (F.col("p") + 1).alias("position"), "r.page_id", "r.score")


def without(logs: DataFrame, user: int, log_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The logs without one search or all searches of a user, and a row (deleted)."""
    gone = (F.col("user_id") == user) & (F.lit(True) if log_id is None else F.col("log_id") == log_id)
    gone = F.coalesce(gone, F.lit(False))
    return logs.where(~gone), logs.agg(F.count_if(gone).alias("deleted"))


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row (next_id): the largest key plus one, 1 for an empty table."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_id"))


def log_rows(queries: DataFrame, results: DataFrame, latency_ms: Column, first: int = 5) -> DataFrame:
    """Rows to append to the logs: (query_id, query_text, normalized_query, total_results, top_results, latency_ms).

    ``results`` (query_id, rank, book_id, page_id, page_number, score) are the rows of a search; a
    query without results gets 0 and an empty list.
    """
    from ..functions.text import tokens

    entry = F.struct("rank", F.struct("book_id", "page_id", "page_number", "score").alias("r"))
    per = results.groupBy("query_id").agg(F.count("*").cast("int").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, first), lambda x: x["r"]).alias("top"))
    x = queries.join(per, "query_id", "left")
    empty = F.array().cast("array<struct<book_id:int,page_id:string,page_number:int,score:double>>")
    return x.select("query_id", F.col("query").alias("query_text"), tokens("query").alias("normalized_query"), F.coalesce("n", F.lit(0)).alias("total_results"), F.coalesce("top", empty).alias("top_results"), latency_ms.cast("int").alias("latency_ms"))


def bars(daily_rows: DataFrame, value: str = "searches") -> DataFrame:
    """Adds ``bar``: the height in per cent of the largest value, 6 at least."""
    most = daily_rows.agg(F.max(value).alias("m"))  # one row
    return daily_rows.join(F.broadcast(most)).withColumn("bar", F.greatest(F.lit(6), F.round(F.coalesce(F.try_divide(F.col(value), F.col("m")), F.lit(0.0)) * 100).cast("int"))).drop("m")


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """One row (rows, pages): pages of ``size`` rows, one at least."""
    return df.agg(F.count("*").alias("rows")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("long"))
