"""What is searched sooner finds the same, and tables are read once."""

import random
import re
from functools import reduce

from pyspark.sql import functions as F

from scriptorium import registry
from scriptorium.operators import chains, repair, structure

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "skills", "Skills:", "xskills skills_", "my skills.", "work  history", "a b c d", "a b c d e", " a  b c d  e ", "x" * 300, "www", "(555)", "+1", "555-010-0199", "in 2019.", "92019 20195", "é2019é", "developer", "volunteer experience", "éskillsé", "interests\r", "a:\t", "@"]


def test_quick_matches(spark):
    lines = spark.createDataFrame([(x,) for x in ODD], "x string")
    patterns = sorted({p for sql in (*structure.SQL.values(), structure._MARKS) for p in re.findall(r"MATCH\(\w+, '([^']*)'\)", sql)} - {":$"})
    for k in range(0, len(patterns), 40):
        some = patterns[k : k + 40]
        rows = lines.select("x", *[F.expr(f"regexp_like(x, '{p}')").alias(f"a{i}") for i, p in enumerate(some)], *[F.expr(structure._quick("x", p)).alias(f"b{i}") for i, p in enumerate(some)]).collect()
        assert [(r.x, p) for r in rows for i, p in enumerate(some) if r[f"a{i}"] != r[f"b{i}"]] == []


def test_quick_rules(spark):
    texts = ["a @b @c", "aa @ bb @ cc@ dd", "May2020 June2021 Sept2010", "xMay2020", "May2020", "(Sept) Sept Sept", "a\n- May 2020", "St. LouisMade KansasLed KansasCity", "May 2019 - Present, May 2019-Current", "", "@ @@ a@", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = [r for s in (chains.LIBRARY, chains.STATE_SPLIT, chains.HEADER_GLUE, chains.PAGE_DATES, repair.STANDARD) for r in s.rules]
    rows = df.select("t", *[r.on(F.col("t")).alias(f"a{i}") for i, r in enumerate(rules)], *[F.regexp_replace("t", r.pattern, r.replacement).alias(f"b{i}") for i, r in enumerate(rules)]).collect()
    assert [(x.t, r.name) for x in rows for i, r in enumerate(rules) if x[f"a{i}"] != x[f"b{i}"]] == []


def test_library_sooner(spark):
    """Texts made of pieces of matches: each rule, and all of them, give what the plain patterns give."""
    pieces = ["May", "June", "Sept", "March", "January", "2019", "20201", "199", "-", "–", "—", " ", "\n", "\t", "\r", "\x0b", "@", "a", "é", "_", ".", "Present", "Current", "Texas", "New York", "West Virginia", "St. Louis", "Kansas City", "Salt Lake City", "Led", "Managed", "Building", "SKILLS", "EXPERIENCE"]
    rnd = random.Random(7)
    often = [["May", "2019", "-", " ", "\n", "–"], ["Sept", " ", ".", "é"], ["May2019", "Sept2010", " ", "a"], ["a", " ", "@", "\n", "_"], ["Texas", "New York", "Kansas City", "Managed", "Building", " "]]
    texts = ["".join(rnd.choices(p, k=rnd.randint(1, 14))) for p in (pieces, *often) for _ in range(1500)] + ["", None]
    month, dash, gap = ["May", "March", "Sept", "June"], ["-", "–", "\n-", " - ", "\n - ", "-\n", " —"], ["", " ", "\n", " \n ", "\t"]
    dates = [[["", "a", ".", "\n"], month, gap, ["2019", "201"], dash, gap, [*month, "Present", ""], gap, ["2020", "", "20201"], gap], [["-", "\n-"], gap, month, gap, ["2020"], gap, ["x"]]]
    texts += ["".join("".join(map(rnd.choice, parts)) for _ in range(rnd.randint(1, 3))) for parts in dates for _ in range(2500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    plain = lambda t, rules: reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.replacement), rules, t)
    sets = [[r] for r in chains.LIBRARY.rules] + [chains.LIBRARY.rules]
    rows = df.select("t", *[repair.RuleSet(rules).apply(F.col("t")).alias(f"a{i}") for i, rules in enumerate(sets)], *[plain(F.col("t"), rules).alias(f"b{i}") for i, rules in enumerate(sets)]).collect()
    assert [(x.t, rules[0].name) for x in rows for i, rules in enumerate(sets) if x[f"a{i}"] != x[f"b{i}"]] == []
    for i, rules in enumerate(sets[:-1]):
        assert any(x[f"b{i}"] != x.t for x in rows), rules[0].name
    pick = df.select("t", *[structure._hits("t", k).alias(f"a_{k}") for k in structure.ISSUES], *[F.regexp_count("t", F.lit(p)).alias(f"b_{k}") for k, p in structure.ISSUES.items()]).collect()
    assert [(x.t, k) for x in pick for k in structure.ISSUES if x[f"a_{k}"] != x[f"b_{k}"]] == []


def test_rules_search_rare_signs(spark):
    """No rule of the library is searched in all of a text from every letter of it."""
    for r in chains.LIBRARY.rules:
        assert r.needs or r.near or r.sooner, r.name
    plan = registry.queries()["ag16_issues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"{chains._B}Sept" not in plan and f"{chains._B}({chains._MONTH})" not in plan and "[A-Z](?<=[a-z][A-Z])" in plan


def test_touched_lines(spark):
    """The lines that are kept have all issues, and grow as the whole text does, before the rules, after each of them and after all."""
    plan = registry.queries()["ag16_issues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(concat(") == plan.count(structure._APART) == 1
    pieces = ["May", "June", "Sept", "Sep", "2019", "20201", "199", "-", "–", "—", " ", " ", "\n", "\n", "\n", "\t", "\r", "\x0b", "@", "a", "é", "_", ".", ")", "S", "\U0001f600", "Present", "Texas", "New York", "St. Louis", "Kansas City", "Led", "Managed", "Building", "SKILLS", "EXPERIENCE", "plain words"]
    often = [["Sept", "\n", "Sep", " ", "t"], ["May", "2019", "-", "\n", "–", " ", "\nplain"], ["May2019", "June2020", "\n", "a"], ["a", "@", "\n", " ", "b."], ["Texas", "New York", "\n", "Managed", "Building"], [".SKILLS", "a", "\n", "EXPERIENCE"]]
    rnd = random.Random(11)
    line = lambda: "".join(rnd.choices(pieces, k=rnd.randint(0, 6)))
    texts = ["\n".join(rnd.choice([line(), line(), "Plain words, no more.", "plain words"]) for _ in range(rnd.randint(1, 7))) for _ in range(6000)]
    texts += ["".join(rnd.choices(p, k=rnd.randint(1, 14))) for p in (pieces, *often) for _ in range(1500)] + ["", "\n", "-", "\n-May 2019", "-May 2019\nx", "x\n\nSept\nSept\n", None]
    dates = [["", "x\n", "\n", "."], ["May", "Sept"], ["", " ", "\n"], ["2019", "201"], ["-", "–", "\n-", "-\n", "\n—\n"], ["", "-"], ["May", "June", "Present", ""], ["", " ", "\n"], ["2020", ""], ["", "\n", "\nx"]]
    texts += ["".join("".join(map(rnd.choice, dates)) for _ in range(rnd.randint(1, 2))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("kept", structure._touched(F.col("t"))).cache()
    rules = chains.LIBRARY.rules
    plain = lambda t, rules: reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.replacement), rules, F.col(t))
    for some in ([], *([r] for r in rules), *(rules[:k] for k in range(2, len(rules), 3)), rules):
        two = df.select("t", "kept", plain("t", some).alias("a"), plain("kept", some).alias("b")).withColumn("b", F.when(F.col("kept").isNotNull(), F.col("b")))
        counts = lambda x, of: [(F.length(x) - F.length(of)).alias(f"grown_{x}"), *[F.regexp_count(x, F.lit(p)).alias(f"{k}_{x}") for k, p in structure.ISSUES.items()]]
        rows = two.select("t", *counts("a", "t"), *counts("b", "kept")).collect()
        assert [r.t for r in rows if any(r[f"{k}_a"] != r[f"{k}_b"] for k in ("grown", *structure.ISSUES))] == [], [r.name for r in some]
    kept = {r.t: r.kept for r in df.collect()}
    assert sum(k == "" for t, k in kept.items() if t) > 500 and sum(0 < len(k) < len(t) for t, k in kept.items() if t) > 1000
    prose = "Plain words (all of them) go on; a well-kept word - too.\nÉtat of 2019, UN and Others\n" * 50
    assert spark.range(1).select(structure._touched(F.lit(prose))).first()[0] == ""


def test_one_pass_and_no_text_in_windows(spark):
    plan = lambda n: registry.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("ag16_issues", "sx9_scores", "sx10_boundaries", "sx19_tiers"):
        assert len(re.findall(r"FileScan", plan(name).split("Initial Plan")[0])) == 1, name
    for name in ("sx9_scores", "sx10_boundaries"):
        assert not re.search(r"lag\(line|lead\(line|lag\(trim", plan(name))
    assert "(?=" in plan("sx2_headers") and "low_text" in plan("ag19_quality")


def test_headers_behind_borders(spark):
    """sx2_headers tries names only where a word begins, and scores lines as its SQL does."""
    plan = registry.queries()["sx2_headers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "10FFFF}](?=" in plan and "[^a-z0-9_](?=" not in plan
    names = [n for some in structure.FAMILIES.values() for n in some]
    rnd = random.Random(3)
    signs = ["", " ", "  ", "_", "x", "7", "é", "-", ":", "s", "\r", "\x00", "\x7f", "`", "{", "^", "\uffff", "\U0001f600"]
    made = [rnd.choice(signs) + rnd.choice((str, str.upper, str.title))(rnd.choice(names)) + rnd.choice(signs) + rnd.choice(["", rnd.choice(names)]) + rnd.choice(signs) for _ in range(3000)]
    table = spark.createDataFrame([(0, i, x) for i, x in enumerate([*ODD, *names, *made])], "doc_id long, i int, line string")
    found = structure._sum([structure._family(n) for n in structure.FAMILIES.values()])
    plain = structure.SQL["sx2_headers"].replace("MATCH(", "regexp_like(").replace("{L}", "lines_of_test")
    table.createOrReplaceTempView("lines_of_test")
    want = {r.i: r.score for r in spark.sql(plain).collect()}
    got = {r.i: r.score for r in structure._filled(structure.SQL["sx2_headers"].replace(found, structure._where_worded(found)), L=table).collect()}
    assert got == want and len({*want.values()}) > 5
