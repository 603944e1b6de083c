"""Sections: line model, header scores, peaks, the caps-or-colon parser, types of titles, and contact data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import found
from scriptorium.sources.tables import RESUMES_SQL, read, resumes

# Section types and the words of their titles, in order of precedence.
TYPES = [("contact", "contact|personal"), ("summary", "summary|profile|objective"), ("experience", "experience|employment|work"), ("education", "education|academic"), ("skills", "skills|technologies"), ("projects", "projects|portfolio")]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}"
YEARS = r"([0-9]+)\+?[ ]+years?[ ]+(?:of[ ]+)?experience"


def lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no, line (trimmed, not blank)."""
    return df.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def is_header(line: Column) -> Column:
    """Capitals only with a letter in it, or a colon at the end."""
    return (line.rlike("[A-Z]") & (line == F.upper(line)) & ~line.rlike("[0-9@]")) | line.endswith(":")


def title_type(title: Column) -> Column:
    t = F.lower(F.rtrim(title))
    out = F.when(t.rlike(TYPES[0][1]), TYPES[0][0])
    for name, pattern in TYPES[1:]:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("other")


def sections(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, seq, title, type, content: text before the first header is section 0 without title."""
    w = Window.partitionBy(doc).orderBy("line_no")
    marked = lines(df, doc, text).withColumn("head", is_header(F.col("line")))
    marked = marked.withColumn("seq", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy(doc, "seq").agg(F.first(F.when(F.col("head"), F.regexp_replace("line", ":$", "")), ignorenulls=True).alias("title"), body.alias("content"))
    return out.withColumn("type", F.when(F.col("title").isNull(), "contact").otherwise(title_type(F.col("title"))))


def header_scores(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no, score, peak: additive evidence for a header; a peak is the best of its neighbourhood of five lines either way."""
    w = Window.partitionBy(doc).orderBy("line_no")
    t = F.rtrim(F.lower(F.regexp_replace("line", ":$", "")))
    every = "|".join(p for _, p in TYPES)
    caps = F.col("line").rlike("[A-Z]") & (F.col("line") == F.upper("line"))
    score = (
        F.when(t.rlike(f"^({every})$"), 4.0).when(t.rlike(every), 2.0).otherwise(0.0)
        + F.when(caps, 2.5).when(F.col("line").rlike("^([A-Z][a-z]+ ?)+$"), 1.5).otherwise(0.0)
        + F.when(F.col("line").endswith(":"), 1.0).otherwise(0.0)
        + F.when(F.length("line") < 20, 1.0).when(F.length("line") < 30, 0.5).otherwise(0.0)
        + F.when(F.lead("line").over(w).rlike("^[-*•]"), 1.0).otherwise(0.0)
    )
    scored = lines(df, doc, text).withColumn("score", score)
    near = F.max("score").over(w.rowsBetween(-5, 5))
    return scored.select(doc, "line_no", "score", ((F.col("score") >= 3) & (F.col("score") == near)).alias("peak"))


def contacts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """First e-mail, phone, LinkedIn path, and years of experience; null where there is none."""
    t = F.col(text)
    return df.select(
        doc, found(t, EMAIL).alias("email"), found(t, PHONE).alias("phone"), found(t, r"linkedin\.com/in/[A-Za-z0-9_-]+").alias("linkedin"), found(t, YEARS, 1).try_cast("int").alias("years")
    )


def analysis(parsed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, n_sections, n_types, missing: of contact, experience, education, skills."""
    by = parsed.groupBy(doc).agg(F.count("*").alias("n_sections"), F.collect_set("type").alias("t"))
    want = F.array(*[F.lit(x) for x in ("contact", "education", "experience", "skills")])
    return by.select(doc, "n_sections", F.size("t").cast("long").alias("n_types"), F.array_join(F.array_except(want, "t"), ",").alias("missing"))


def sx27_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(resumes(spark, sf_dir)).select("doc_id", "seq", F.coalesce("title", F.lit("")).alias("title"), "type", "content")


def sx1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_scores(resumes(spark, sf_dir))


def sx21_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(sections(resumes(spark, sf_dir)))


def ex1_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(read(spark, sf_dir, "documents")).select("doc_id", "email", "phone")


def ex4_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(resumes(spark, sf_dir)).select("doc_id", "years", "email")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resumes(spark, sf_dir)
    return sx27_sections(spark, sf_dir).join(contacts(r), "doc_id")


QUERIES = {"sx27_sections": sx27_sections, "sx1_scores": sx1_scores, "sx21_analysis": sx21_analysis, "ex1_contacts": ex1_contacts, "ex4_years": ex4_years}
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in TYPES) + " ELSE 'other' END"
_LINES = r"l AS (SELECT * FROM (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line_no, trim(unnest(x)) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS x FROM resumes)) WHERE line <> '')"
_SECTIONS = rf"""WITH {RESUMES_SQL}, {_LINES},
h AS (SELECT *, (regexp_matches(line, '[A-Z]') AND line = upper(line) AND NOT regexp_matches(line, '[0-9@]')) OR ends_with(line, ':') AS head FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS seq FROM h),
g AS (SELECT doc_id, seq, max(CASE WHEN head THEN regexp_replace(line, ':$', '') END) AS title, coalesce(string_agg(CASE WHEN NOT head THEN line END, E'\n' ORDER BY line_no), '') AS content FROM s GROUP BY doc_id, seq),
o AS (SELECT doc_id, seq, coalesce(title, '') AS title, CASE WHEN title IS NULL THEN 'contact' ELSE {_TYPE} END AS type, content FROM g)"""
_EVERY = "|".join(p for _, p in TYPES)
ORACLE_SQL = {
    "sx27_sections": f"{_SECTIONS} SELECT * FROM o",
    "sx21_analysis": f"{_SECTIONS} SELECT doc_id, count(*) AS n_sections, count(DISTINCT type) AS n_types, array_to_string(list_filter(['contact', 'education', 'experience', 'skills'], lambda x: NOT list_contains(list(type), x)), ',') AS missing FROM o GROUP BY doc_id",
    "sx1_scores": rf"""WITH {RESUMES_SQL}, {_LINES}, s AS (SELECT doc_id, line_no,
 CASE WHEN regexp_matches(lower(regexp_replace(line, ':$', '')), '^({_EVERY})$') THEN 4.0 WHEN regexp_matches(lower(regexp_replace(line, ':$', '')), '{_EVERY}') THEN 2.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(line, '[A-Z]') AND line = upper(line) THEN 2.5 WHEN regexp_matches(line, '^([A-Z][a-z]+ ?)+$') THEN 1.5 ELSE 0.0 END
 + CASE WHEN ends_with(line, ':') THEN 1.0 ELSE 0.0 END + CASE WHEN length(line) < 20 THEN 1.0 WHEN length(line) < 30 THEN 0.5 ELSE 0.0 END
 + CASE WHEN regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '^[-*•]') THEN 1.0 ELSE 0.0 END AS score FROM l)
SELECT doc_id, line_no, CAST(score AS DOUBLE) AS score, score >= 3 AND score = max(score) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS peak FROM s""",
    "ex1_contacts": f"SELECT doc_id, nullif(regexp_extract(text, '{EMAIL}'), '') AS email, nullif(regexp_extract(text, '{PHONE}'), '') AS phone FROM documents",
    "ex4_years": f"WITH {RESUMES_SQL} SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '{YEARS}', 1), '') AS INTEGER) AS years, nullif(regexp_extract(text, '{EMAIL}'), '') AS email FROM resumes",
}
