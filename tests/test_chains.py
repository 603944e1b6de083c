"""Repair chains, evidence and advice on written cases: input and what must be in the output."""

import pytest
from pyspark.sql import functions as F

from scriptorium import registry
from scriptorium.operators import advice, chains, pages, structure

SF = "/root/testdata/sf0.001"


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


CASES = [
    ("January 2018\n- March\n2020", "January 2018 - March 2020"), ("May2020-June2021", "May 2020 - June 2021"), ("- May 2020 on", " - May 2020 on"), ("May 2020 - June\n2022", "May 2020 - June 2022"), ("Sept 2010", "Sep 2010"), ("June2021 on", "June 2021 on"),
    ("May 2020–June 2021", "May 2020 - June 2021"), ("1999-2004", "1999 - 2004"), ("May 2020 – Present", "May 2020 - Present"), ("TexasManaged it", "Texas\nManaged it"), ("OhioBuilding it", "Ohio\nBuilding it"), ("Salt Lake CityWorked", "Salt Lake City\nWorked"),
    ("pat @sample.org", "pat@sample.org"), ("pat@ sample.org", "pat@sample.org"), ("pat @ sample.org", "pat@sample.org"), ("tasksSKILLS", "tasks\n\nSKILLS"), ("workEXPERIENCE", "work\n\nEXPERIENCE"), ("done.SKILLS", "done.\n\nSKILLS"), ("done.EXPERIENCE", "done.\n\nEXPERIENCE"),
]


def test_library_cases(spark):
    rows = spark.createDataFrame(CASES, "t string, want string").select("t", "want", chains.LIBRARY.apply(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows if r.want not in r.got] == []


def test_chains_on_cases(spark):
    assert one(spark, "KansasLed and West VirginiaMade", chains.STATE_SPLIT.apply) == "Kansas\nLed and West Virginia\nMade"
    assert one(spark, "the cornpany and Manage ment, www.site.corn/x", chains.corrected_text) == "the company and Management, www.site.com/x"
    assert one(spark, "cornpany cornpany RNANAGEMENT xcornpany", chains.corrected_text) == "company company MANAGEMENT xcornpany"
    assert one(spark, "call 555-010-0199 JJR now", chains.PATTERNS.apply) == "call 555-010-0199 now"
    assert one(spark, "DataAnalyst OpsTeam McDonald SeniorClerk", chains.merged_capitals) == "Data Analyst Ops Team McDonald Senior Clerk"
    assert one(spark, "TexasRanger", chains.merged_capitals) == "Texas\nRanger"
    assert one(spark, "EXPERIENCE\ned in it", chains.HEAL.apply) == "experienceed in it"
    frame = lambda t, make: make(spark.createDataFrame([(t,)], "text string")).first().text
    assert frame("a. WORK HISTORY b\nKEY SKILLS\nx", chains.standardised).split("\n")[:3] == ["a.", "EXPERIENCE", ""]
    assert frame("a\nmy skills\nb", chains.roomy_headers) == "a\n\nmy skills\n\nb" and frame("", chains.roomy_headers) == "" and frame(None, chains.standardised) is None
    assert frame("SKILLS\na\nSKILLS x\nb", chains.duplicate_skills) == "SKILLS\na\n• SKILLS:\nb"
    text = spark.createDataFrame([(1, "SKILLS\na\nb\nTechnical Skills\nc\nSKILLS"), (2, "none"), (3, None), (4, "")], "k int, text string")
    got = {r.k: r.text for r in chains.repeated_headers(text).collect()}
    assert got == {1: "SKILLS\na\nb\n• Technical Skills:\nc", 2: "none", 3: None, 4: ""}


@pytest.mark.parametrize("name", [n for n in chains.QUERIES if n.startswith("rp") and n not in ("rp1_substitutions", "rp22_noisy")])
def test_chains_change_some_documents(spark, name):
    before = {r.doc_id: r.text for r in chains.damaged(spark, SF).collect()}
    after = {r.doc_id: r.repaired for r in chains.QUERIES[name](spark, SF).collect()}
    assert sum(before[k] != after[k] for k in before) >= 10


def test_evidence_is_not_vacuous(spark):
    q = registry.queries()
    assert q["sx9_scores"](spark, SF).where("peak").count() > 100
    assert q["sx5_types"](spark, SF).select("type").distinct().count() > 3
    assert q["sx20_classified"](spark, SF).select("confidence").distinct().count() >= 2
    assert q["fl13_rejected"](spark, SF).where("rejected <> ''").count() > 0
    assert q["wn10_dropped"](spark, SF).where("resume or job_title").count() > 0
    assert q["ag16_issues"](spark, SF).where("after < before").count() >= 4


def test_advice_on_a_posting(spark):
    df = spark.createDataFrame([(1, "C++ and c++, Node.js, data science; plain words, plain words. 3 yrs experience, MBA", "I know C++ and plain things"), (2, "", "x"), (3, None, None)], "k int, job string, answer string")
    df = df.join(advice.job_keywords(df, "k", "job"), "k")
    got = {r.k: r for r in advice.analysed(df, F.col("keywords"), F.col("job"), F.col("answer")).collect()}
    assert got[1].keywords == ["C++", "Node.js", "c++", "data science", "plain", "words"]
    assert got[1].missing == ["Node.js", "data science", "words"] and got[1].score == 50
    assert got[1].advice == ["add keywords: Node.js, data science, words", "years asked: 3", "degree asked: mba", "brief"]
    assert got[2].score == 0 and got[2].advice[-2:] == ["use the posting's wording", "give figures"] or got[2].advice == ["brief", "use the posting's wording", "give figures"]


def test_word_rows_and_sections_of_nothing(spark):
    df = spark.createDataFrame([(1, "5\t1\t90\tword\n4\t1\t90\tx\n5\t2\t80\t \nbroken"), (2, ""), (3, None)], "k int, t string")
    assert [tuple(r) for r in pages.word_rows(df, "k", "t").collect()] == [(1, 1, "word", 90)]
    assert structure.lines(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).count() == 1
