"""Ticker profiles: four tables of facts to text documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.fixed_values import NEWS_KEPT, QUARTERS_KEPT, YEARS_KEPT

SNAPSHOT = ["price", "pe_ratio", "market_cap", "high_52w", "low_52w", "forward_eps", "trailing_eps"]
QUARTERLY = ["revenue", "net_income", "eps", "profit_margin"]
ANNUAL = ["revenue", "ebitda", "free_cash_flow"]


def ticker_profiles(
    snapshot: DataFrame,
    quarterly: DataFrame,
    annual: DataFrame,
    news: DataFrame,
    source: str = "market_data",
    quarters: int = QUARTERS_KEPT,
    years: int = YEARS_KEPT,
    headlines: int = NEWS_KEPT,
) -> DataFrame:
    """Documents ``doc_id, text, metadata`` of tickers that have all four sections.

    A ticker that lacks a section gives nothing at all. The newest rows are kept
    by ``row_number``, which limits every ticker before the shuffle too.
    """
    tables = {"snapshot": snapshot, "quarterly": quarterly, "annual": annual, "news": news}
    as_of = F.col("as_of") if "as_of" in snapshot.columns else F.current_date()
    story = F.concat_ws(
        "\n",
        F.col("headline"),
        F.concat(F.lit("Publisher: "), F.coalesce("publisher", F.lit("unknown"))),
        F.coalesce("summary", F.lit("")),
    )
    sections = [
        _section(snapshot, "snapshot", F.lit(""), as_of, _facts(SNAPSHOT), source),
        _section(
            _newest(quarterly, "period_end", [], quarters),
            "quarterly",
            _iso("period_end"),
            F.col("period_end"),
            _facts(QUARTERLY),
            source,
        ),
        _section(
            _newest(annual, "fiscal_year", [], years),
            "annual",
            F.col("fiscal_year").cast("string"),
            F.make_date("fiscal_year", F.lit(12), F.lit(31)),
            _facts(ANNUAL),
            source,
        ),
        _section(
            _newest(news, "published", ["headline", "publisher"], headlines),
            "news",
            F.col("_newest").cast("string"),
            F.col("published"),
            story,
            source,
        ),
    ]
    documents = reduce(DataFrame.unionByName, sections)
    return documents.join(_complete(tables), "ticker", "left_semi").drop("ticker")


def _complete(tables: dict[str, DataFrame]) -> DataFrame:
    """Tickers present in every table; each table is reduced to its distinct
    tickers before anything is shuffled, so a ticker with most rows is no burden."""
    present = [df.select("ticker", F.lit(name).alias("section")) for name, df in tables.items()]
    sections = reduce(DataFrame.unionByName, present).distinct()
    counted = sections.groupBy("ticker").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == len(tables)).select("ticker")


def _iso(col) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def _newest(df: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    order = Window.partitionBy("ticker").orderBy(F.col(by).desc(), *ties)
    return df.withColumn("_newest", F.row_number().over(order)).where(F.col("_newest") <= n)


def _facts(names: list[str]) -> Column:
    """``name: value`` lines with two decimals; a missing value reads n/a."""
    lines = [
        F.concat(
            F.lit(f"{name}: "),
            F.coalesce(F.round(name, 2).cast("decimal(20,2)").cast("string"), F.lit("n/a")),
        )
        for name in names
    ]
    return F.concat_ws("\n", *lines)


def _section(
    df: DataFrame, section: str, period: Column, date: Column, body: Column, source: str
) -> DataFrame:
    parts = [F.col("ticker"), F.lit(section), F.nullif(period, F.lit(""))]
    metadata = F.struct(
        F.lit(source).alias("source"), F.col("ticker").alias("ticker"), _iso(date).alias("date")
    )
    return df.select(
        "ticker",
        F.concat_ws("/", *parts).alias("doc_id"),
        F.concat(F.concat_ws(" ", *parts), F.lit("\n"), body).alias("text"),
        metadata.alias("metadata"),
    )
