"""Queries of the engine and their SQL oracles, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def modules() -> list:
    from scriptorium.operators import advice, cards, chains, layout, matching, pages, records, repair, sections, structure, tracking, voting

    return [repair, chains, sections, structure, matching, advice, voting, tracking, cards, records, layout, pages]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators.sections import flagship

    return flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in modules() for k, s in m.ORACLE_SQL.items()}
