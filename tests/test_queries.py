"""Every query against its SQL oracle, with DuckDB on the same tables."""

import re

import duckdb
import pytest

from scriptorium import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(records, cols):
    return sorted(repr([r[c] for c in cols]) for r in records)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, duck, name):
    got = [r.asDict() for r in registry.queries()[name](spark, SF).collect()]
    rel = duck.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in rel.description)
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert got and sorted(got[0]) == cols
    assert rows(got, cols) == rows(want, cols)


def test_repairs_are_not_vacuous(spark):
    q = registry.queries()
    assert q["rp1_repaired"](spark, SF).where("changed").count() > 50
    assert q["sx27_sections"](spark, SF).where("type = 'skills'").count() == 200
    assert q["sx1_scores"](spark, SF).where("peak").count() > 200


def test_no_python_in_plans(spark):
    for name, f in registry.queries().items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("EvalPython|MapInPandas|MapInArrow|PythonUDF|CartesianProduct", plan), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rule_set_unknown_rule_changes_nothing(spark):
    from pyspark.sql import functions as F

    from scriptorium.operators.repair import STANDARD, corrected

    df = spark.createDataFrame([(1, "Sept 2020"), (2, None), (3, "")], "k int, text string")
    got = {r.k: r.x for r in df.select("k", STANDARD.apply_one(F.col("text"), "no such rule").alias("x")).collect()}
    assert got == {1: "Sept 2020", 2: None, 3: ""}
    word = spark.createDataFrame([("TEH teh Teh x",)], "t string").select(corrected(F.col("t"), {"teh": "the"}).alias("x")).first().x
    assert word == "THE the The x"


def test_half_even_scores(spark):
    from pyspark.sql import functions as F

    from scriptorium.functions.text import score

    df = spark.createDataFrame([(1, 8), (3, 8), (0, 0)], "p int, t int").select(score(F.col("p"), F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [12, 38, 0]


def test_new_expressions_on_nulls_and_empty_texts(spark):
    from pyspark.sql import functions as F

    from scriptorium.operators import cards, layout

    df = spark.createDataFrame([(1, None, None), (2, "", 5), (3, "- a\n* b", None)], "k int, t string, n int")
    got = {r.k: r for r in df.select("k", cards.bullets(F.col("t")).alias("b"), cards.salary(F.lit(1000), F.col("n")).alias("s"), layout.slice_of(F.col("t"), F.lit("a"), F.lit("xyz")).alias("p")).collect()}
    assert (got[1].b, got[2].b, got[3].b) == (None, "", "• a\n• b")
    assert (got[1].s, got[2].s) == ("$1,000+", "$1,000 - $5")
    assert got[2].p == "xyz"
    p = spark.createDataFrame([([1, 2, 4, 6, 7],), ([],)], "p array<int>").select(layout.spaced(F.col("p")).alias("x"))
    assert [r.x for r in p.collect()] == [[1, 4, 7], []]
