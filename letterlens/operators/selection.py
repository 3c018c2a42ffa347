"""Selections by key against other tables. Keys are unique, so no group of rows gets hot."""

from pyspark.sql import DataFrame, functions as F


def also_in(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in another result, e.g. content hits that also have attachment hits."""
    return rows.join(others.select(*keys), keys, "left_semi")


def unprocessed(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier run has not logged; resumes where it stopped."""
    return rows.join(log.select(*keys), keys, "left_anti")


def of_confidence(rows: DataFrame, lowest: float = 0.0, highest: float = 1.0) -> DataFrame:
    return rows.filter(F.col("confidence").between(lowest, highest))


def select_routed(
    stored: DataFrame, routes: list[str] | None = None, lowest: float = 0.0, highest: float = 1.0,
    first: str | None = None, last: str | None = None, sender: str | None = None,
) -> DataFrame:
    """Routed messages by route, confidence, date (yyyy-MM-dd) and sender, bounds included. Routes and dates also name the
    folders that are read, and confidence reaches the file reader as a plain comparison."""
    found = of_confidence(stored, lowest, highest)
    if routes:
        found = found.filter(F.col("route").isin(routes))
    if first:
        found = found.filter((F.col("month") >= first[:7]) & (F.to_date("date_wall") >= F.to_date(F.lit(first))))
    if last:
        found = found.filter((F.col("month") <= last[:7]) & (F.to_date("date_wall") <= F.to_date(F.lit(last))))
    return found.filter(F.col("sender") == sender.lower().strip()) if sender else found


def of_dates(messages: DataFrame, first: str, last: str) -> DataFrame:
    """Messages written within two wall-clock dates, both included (yyyy-MM-dd)."""
    day = F.to_date("date_wall")
    return messages.filter(day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
