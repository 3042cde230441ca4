"""Lines by period and author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period(when: Column, granularity: str) -> Column:
    """day, week (ISO) or month; any other name means month."""
    if granularity == "day":
        return F.date_format(when, "yyyy-MM-dd")
    if granularity == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), when).cast("int"), F.extract(F.lit("WEEK"), when).cast("int"))
    return F.date_format(when, "yyyy-MM")


def bound(text: Column) -> Column:
    """YYYY-MM-DD, then RFC 3339; null, that is no bound, for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def author_key(use_email: bool) -> Column:
    return F.when(F.coalesce(F.col("email"), F.lit("")) != "", F.lower("email")).otherwise(F.col("author")) if use_email else F.col("author")


def counted(lines: DataFrame, granularity: str = "month", use_email: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """period, author, lines; `until` holds the whole day."""
    rows = lines
    if since:
        rows = rows.where(F.coalesce(F.col("when") >= bound(F.lit(since)), F.lit(True)))
    if until:
        rows = rows.where(F.coalesce(F.col("when") < bound(F.lit(until)) + F.expr("INTERVAL 1 DAY"), F.lit(True)))
    return rows.groupBy(period(F.col("when"), granularity).alias("period"), author_key(use_email).alias("author")).agg(F.count(F.lit(1)).alias("lines"))


def shares(counts: DataFrame) -> DataFrame:
    """Adds total and share (percent) of the period; the window is over one row for each author of a period."""
    total = F.sum("lines").over(Window.partitionBy("period"))
    return counts.withColumns({"total": total, "share": F.round(F.col("lines") * 100.0 / total, 1)})


def overall(counts: DataFrame) -> DataFrame:
    """author, lines, share over all periods, most lines first."""
    by = counts.groupBy("author").agg(F.sum("lines").alias("lines"))
    total = by.agg(F.sum("lines").alias("_total"))
    return by.crossJoin(F.broadcast(total)).select("author", "lines", F.round(F.col("lines") * 100.0 / F.col("_total"), 1).alias("share")).orderBy(F.desc("lines"), "author")


def grouping_sets(lines: DataFrame, granularity: str = "month", use_email: bool = False) -> DataFrame:
    """Counts by period and author, by each alone and of all, in one pass."""
    rows = lines.select(period(F.col("when"), granularity).alias("period"), author_key(use_email).alias("author"))
    return rows.groupingSets([["period", "author"], ["period"], ["author"], []], "period", "author").agg(F.count(F.lit(1)).alias("lines"))


def top_and_rest(counts: DataFrame, n: int = 5, rest: str = "其他") -> DataFrame:
    """author, lines: the n authors with most lines, and the others as one row."""
    top = counts.groupBy("author").agg(F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "author").limit(n)
    total = counts.agg(F.sum("lines").alias("lines"))
    other = total.crossJoin(top.agg(F.sum("lines").alias("_top"))).select(F.lit(rest).alias("author"), (F.col("lines") - F.col("_top")).alias("lines")).where("lines > 0")
    return top.unionByName(other)


def date_series(rows: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """date, value: parsable dates only, added up by day; empty with fewer than two points."""
    day = F.to_date(F.coalesce(F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col(date), F.lit("yyyy/MM/dd"))))
    points = rows.select(day.alias("date"), F.col(value).alias("value")).where("date IS NOT NULL").groupBy("date").agg(F.sum("value").alias("value"))
    enough = points.agg((F.count(F.lit(1)) >= 2).alias("_enough"))
    return points.crossJoin(F.broadcast(enough)).where("_enough").drop("_enough").orderBy("date")
