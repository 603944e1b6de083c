"""Selection among alternative transcriptions: most words, quality scores, positional votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens
from scriptorium.sources.tables import read


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text: four variants of each benchmark text - itself, a word dropped, in capitals, words glued."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    kinds = F.array(F.col("text"), F.regexp_replace("text", "^[^ ]+ ", ""), F.upper("text"), F.replace("text", F.lit(" th"), F.lit("th")))
    return b.select("doc_id", F.posexplode(kinds).alias("ord", "text"))


CANDIDATES_SQL = "c AS (SELECT item_id AS doc_id, CAST(unnest(range(4)) AS INTEGER) AS ord, unnest([text, regexp_replace(text, '^[^ ]+ ', ''), upper(text), replace(text, ' th', 'th')]) AS text FROM benchmark)"


def best_by(df: DataFrame, score, doc: str = "doc_id") -> DataFrame:
    """The highest score wins, the first candidate on ties."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.col("score").desc(), "ord"))
    return df.withColumn("score", score).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def most_words(df: DataFrame) -> DataFrame:
    return best_by(df, F.size(tokens(F.col("text"))))


def best_quality(df: DataFrame) -> DataFrame:
    """Ten for each token of 3 to 19 letters with a vowel, one for each non-blank line."""
    good = F.filter(tokens(F.col("text")), lambda t: (F.length(t) >= 3) & (F.length(t) <= 19) & F.lower(t).rlike("[aeiou]"))
    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return best_by(df, F.size(good) * 10 + F.size(full))


def voted(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Word by word: at each position the word that most candidates have (case aside; first on ties), in its commonest spelling."""
    each = df.select(doc, "ord", F.posexplode(tokens(F.col("text"))).alias("pos", "word")).withColumn("low", F.lower("word"))
    spelled = each.groupBy(doc, "pos", "low", "word").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max(F.struct("n", -F.col("first"), "word")).alias("s")
    lows = spelled.groupBy(doc, "pos", "low").agg(F.sum("n").alias("votes"), F.min("first").alias("first"), best)
    won = lows.groupBy(doc, "pos").agg(F.max(F.struct("votes", -F.col("first"), F.col("s.word").alias("word"))).alias("w"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("w.word").alias("word")))), lambda x: x["word"])
    return won.groupBy(doc).agg(F.array_join(joined, " ").alias("text"))


def vt1_most_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_words(candidates(spark, sf_dir))


def vt2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_quality(candidates(spark, sf_dir))


def vt5_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voted(candidates(spark, sf_dir))


QUERIES = {"vt1_most_words": vt1_most_words, "vt2_quality": vt2_quality, "vt5_voted": vt5_voted}
_TOK = r"list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "vt1_most_words": f"WITH {CANDIDATES_SQL}, s AS (SELECT *, CAST(len({_TOK}) AS INTEGER) AS score FROM c) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1",
    "vt2_quality": f"WITH {CANDIDATES_SQL}, s AS (SELECT *, CAST(10 * len(list_filter({_TOK}, lambda t: length(t) BETWEEN 3 AND 19 AND regexp_matches(lower(t), '[aeiou]'))) + len(list_filter(string_split(text, E'\\n'), lambda x: trim(x) <> '')) AS INTEGER) AS score FROM c) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1",
    "vt5_voted": f"""WITH {CANDIDATES_SQL}, e AS (SELECT doc_id, ord, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT doc_id, ord, {_TOK} AS l FROM c)),
s AS (SELECT doc_id, pos, lower(word) AS low, word, count(*) AS n, min(ord) AS first FROM e GROUP BY ALL),
l AS (SELECT doc_id, pos, low, sum(n) AS votes, min(first) AS f, arg_max(word, n * 100 - first) AS word FROM s GROUP BY doc_id, pos, low),
w AS (SELECT doc_id, pos, arg_max(word, votes * 100 - f) AS word FROM l GROUP BY doc_id, pos)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM w GROUP BY doc_id""",
}
