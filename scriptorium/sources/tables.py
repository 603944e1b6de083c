"""Tables of the driver, and fixtures made from them by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: three sections with all lines of the document (half in the summary, half as bullets), contact data and a defect chosen by doc_id."""
    d = read(spark, sf_dir, "documents").withColumn("l", F.split(F.coalesce("text", F.lit("")), "\n"))
    half = F.ceil(F.size("l") / 2).cast("int")
    text = F.concat(
        F.lit("Alex Example\nuser"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, " @ ").otherwise("@"), F.lit("example.com | 555-01"),
        F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("-7733\n\nSUMMARY\n"), F.array_join(F.slice("l", F.lit(1), half), "\n"), F.lit("\n\nExperience:\n- Built things 2019 - 2021"),
        F.array_join(F.transform(F.slice("l", half + 1, F.size("l")), lambda x: F.concat(F.lit("\n- "), x)), ""),
        F.lit("\n\nSKILLS\nPython, SQL, Spark"), F.when(F.col("doc_id") % 2 == 0, ", Docker").otherwise(""), F.lit("\n\nEDUCATION\nB.Sc. degree, 5+ years of experience\n"),
    )
    return d.select("doc_id", text.alias("text"))


RESUMES_SQL = r"""resumes AS (SELECT doc_id, concat(E'Alex Example\nuser', doc_id, CASE WHEN doc_id % 3 = 0 THEN ' @ ' ELSE '@' END, 'example.com | 555-01',
 lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0'), E'-7733\n\nSUMMARY\n', array_to_string(l[1 : CAST(ceil(len(l) / 2.0) AS BIGINT)], E'\n'), E'\n\nExperience:\n- Built things 2019 - 2021',
 array_to_string(list_transform(l[CAST(ceil(len(l) / 2.0) AS BIGINT) + 1 :], lambda x: concat(E'\n- ', x)), ''), E'\n\nSKILLS\nPython, SQL, Spark', CASE WHEN doc_id % 2 = 0 THEN ', Docker' ELSE '' END,
 E'\n\nEDUCATION\nB.Sc. degree, 5+ years of experience\n') AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))"""

#: Invented lines with one defect or two each, for the repair chains.
DEFECTS = [
    "Austin, TexasManaged nine systems", "Dayton, OHLed the night shift", "West VirginiaBuilding bridges since May2019-June2021", "finished all tasks.SKILLSWriting, SQL", "SKILLS\nSQL and Spark\nSKILLS",
    "January 2018 - March\n2020 Tester at Sample Works, Inc", "-February 2016 kept records", "mail: pat @ sample.org, pat@ sample.org", "the cornpany developrnent and Environrnent of www.site.corn/x",
    "Manage ment of corn pany units, call 555-010-0199 JJR", "RESUME\n\nPROFILE\nCareful worker", "March 2015 – Present DataAnalyst OpsTeam McDonald", "WORK EXPERIENCE\nTyped 1999-2004 • filed • sorted",
    "Salt Lake CityWorked, Ogden , UTTaught Sept 2010", "EXPERIENCE\ned in many fields; OBJECTIVE: none", "details.EXPERIENCEMade things 2001–2003\nTechnical Skills\nWriting",
]


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each whole document between two defects chosen by doc_id."""
    lines = F.array(*[F.lit(d) for d in DEFECTS])
    one = lambda k: F.get(lines, F.pmod(k, F.lit(len(DEFECTS))).cast("int"))
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(one(F.col("doc_id")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), one(F.floor(F.col("doc_id") / len(DEFECTS)))).alias("text"))


_LIST = "[" + ", ".join("'" + d.replace("'", "''") + "'" for d in DEFECTS) + "]"
DAMAGED_SQL = f"damaged AS (SELECT doc_id, concat({_LIST}[doc_id % {len(DEFECTS)} + 1], E'\\n', coalesce(text, ''), E'\\n', {_LIST}[doc_id // {len(DEFECTS)} % {len(DEFECTS)} + 1]) AS text FROM documents)"

#: Invented lines that ask for something, for postings.
ASKED = [
    "Requires Python, C++ and Node.js; 5+ years of experience. Bachelor's degree asked, MBA welcome", "We use Spark, SQL and Docker; spark jobs, SQL reports, full-time", "Machine Learning, Data Science and data science again; PhD",
    "Leadership, teamwork, Problem Solving and time management with GitHub, CI/CD, Linux", "3 yrs experience with Java, JavaScript and React; master's degree", "Plain work with plain words and plain words", "Go, Rust, C#, Objective-C, PyTorch, macOS", "Technical Writing and Writing; SEO, UX",
]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text: each whole benchmark text with a line that asks for something, chosen by item_id."""
    lines = F.array(*[F.lit(a) for a in ASKED])
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(lines, F.pmod("item_id", F.lit(len(ASKED))).cast("int"))).alias("text"))


_ASKED = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in ASKED) + "]"
POSTINGS_SQL = f"postings AS (SELECT item_id, concat(coalesce(text, ''), E'\\n', {_ASKED}[item_id % {len(ASKED)} + 1]) AS text FROM benchmark)"
