"""Keywords, match scores, skills and missing parts of a text against a description."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import holds, score, words
from scriptorium.sources.tables import RESUMES_SQL, read, resumes

STOP = ["the", "and", "for", "with", "that", "this", "are", "was", "from", "you", "your", "our", "have", "has", "will", "not", "but", "all", "can"]
SKILLS = {"data": ["Spark", "SQL", "Pandas"], "languages": ["Java", "Python", "Scala"], "platform": ["Docker", "Kubernetes", "Linux"]}


def keywords(df: DataFrame, key: str, top: int = 20) -> DataFrame:
    """key, word, n, rank: the most frequent words of more than two letters, first position first on ties; at most `top`."""
    each = df.select(key, F.posexplode(words(F.col("text"))).alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP))
    counts = each.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "word", "n", "rank")


def asked_keywords(df: DataFrame, key: str) -> DataFrame:
    """key, keyword, word (in lower case), rank: skills that the text names, then words of the top 20 that occur more than once."""
    skills = [s for names in SKILLS.values() for s in names]
    own = words(F.col("text"))
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("keyword"), F.lit(s.lower()).alias("word")) for i, s in enumerate(skills)]), lambda x: F.array_contains(own, x["word"]))
    named = df.select(key, F.explode(hits).alias("h")).select(key, "h.keyword", "h.word", "h.rank")
    common = keywords(df, key).where((F.col("n") > 1) & ~F.col("word").isin([s.lower() for s in skills]))
    return named.unionByName(common.select(key, F.col("word").alias("keyword"), "word", (F.col("rank") + 100).alias("rank")))


def pairs(texts: DataFrame, asked: DataFrame, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """doc, item, present, missing, score: every pair that shares a keyword.  All other pairs have score 0 by definition, and no row."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias(c)
    own = texts.select(doc, F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    hits = own.join(asked, "word").groupBy(doc, item).agg(in_order("present"))
    both = hits.join(asked.groupBy(item).agg(in_order("all")), item)
    return both.select(doc, item, F.array_join("present", ",").alias("present"), F.array_join(F.array_except("all", "present"), ",").alias("missing"), score(F.size("present"), F.size("all")).alias("score"))


def skill_columns(text: Column) -> list:
    """By kind, the skills that a text names, sorted."""
    low = F.lower(text)
    return [F.concat_ws(",", *[F.when(holds(low, s.lower()), F.lit(s)) for s in sorted(names)]).alias(kind) for kind, names in SKILLS.items()]


def ag2_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords(read(spark, sf_dir, "benchmark"), "item_id").where("n > 1")


def mt3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item that it shares a keyword with, by all keywords."""
    return pairs(read(spark, sf_dir, "documents"), asked_keywords(read(spark, sf_dir, "benchmark"), "item_id"))


def ag18_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes(spark, sf_dir).select("doc_id", *skill_columns(F.col("text")))


def missing_skills(text: Column, top: int = 5) -> list:
    """top_missing and more: the first `top` skills that a text lacks, and how many others it lacks."""
    low = F.lower(text)
    lacks = [(s, ~holds(low, s.lower())) for names in SKILLS.values() for s in names]
    n = reduce(add, [F.coalesce(x.cast("int"), F.lit(0)) for _, x in lacks])
    return [F.substring_index(F.concat_ws(",", *[F.when(x, F.lit(s)) for s, x in lacks]), ",", top).alias("top_missing"), F.greatest(n - top, F.lit(0)).alias("more")]


def so6_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes(spark, sf_dir).select("doc_id", *missing_skills(F.col("text")))


QUERIES = {"ag2_keywords": ag2_keywords, "mt3_pairs": mt3_pairs, "ag18_skills": ag18_skills, "so6_missing": so6_missing}
_STOP = ", ".join(f"'{w}'" for w in STOP)
_KEYS = rf"""w AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_]+'), lambda x: x <> '') AS l FROM benchmark)),
c AS (SELECT item_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT item_id, word, n, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM c)"""
_OWN = r"list_distinct(list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_]+'), lambda x: x <> ''))"
_WANT = "[" + ", ".join(f"'{s}'" for n in SKILLS.values() for s in n) + "]"
ORACLE_SQL = {
    "ag2_keywords": f"WITH {_KEYS} SELECT * FROM k WHERE rank <= 20 AND n > 1",
    "mt3_pairs": f"""WITH {_KEYS}, v AS (SELECT unnest({_WANT}) AS keyword, unnest(range(len({_WANT}))) AS rank),
a AS (SELECT DISTINCT item_id, keyword, word, rank FROM w JOIN v ON lower(keyword) = word UNION ALL SELECT item_id, word, word, rank + 100 FROM k WHERE rank <= 20 AND n > 1 AND word NOT IN (SELECT lower(keyword) FROM v)),
l AS (SELECT item_id, list(keyword ORDER BY rank) AS every FROM a GROUP BY item_id), o AS (SELECT doc_id, unnest({_OWN}) AS word FROM documents),
h AS (SELECT doc_id, item_id, list(keyword ORDER BY rank) AS present FROM o JOIN a USING (word) GROUP BY ALL)
SELECT doc_id, item_id, array_to_string(present, ',') AS present, array_to_string(list_filter(every, lambda x: NOT list_contains(present, x)), ',') AS missing,
 CAST(round_even(100.0 * len(present) / len(every), 0) AS INTEGER) AS score FROM h JOIN l USING (item_id)""",
    "ag18_skills": f"WITH {RESUMES_SQL}, o AS (SELECT doc_id, {_OWN} AS own FROM resumes) SELECT doc_id, " + ", ".join(f"array_to_string(list_sort(list_filter([{', '.join(f"'{s}'" for s in names)}], lambda x: list_contains(own, lower(x)))), ',') AS {kind}" for kind, names in SKILLS.items()) + " FROM o",
    "so6_missing": f"""WITH {RESUMES_SQL}, o AS (SELECT doc_id, {_OWN} AS own FROM resumes), m AS (SELECT doc_id, list_filter({_WANT}, lambda x: NOT list_contains(own, lower(x))) AS missing FROM o)
SELECT doc_id, array_to_string(missing[1:5], ',') AS top_missing, CAST(greatest(len(missing) - 5, 0) AS INTEGER) AS more FROM m""",
}
