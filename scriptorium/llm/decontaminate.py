"""Benchmark decontamination with a positional inverted index; DataFrame operations only.

1. Benchmark texts become windows: WINDOW consecutive words, or the whole item
   where it is shorter.
2. One pass over the documents counts every benchmark word in the corpus.  A
   window with a word that no document has can't occur and goes.
3. For each window the two rarest of its words (by those counts) are its list
   heads.  A second pass writes the index: the postings of all list heads -
   document, position, and the words around it as payload - plus one row a
   document with its length.
4. The heads' lists, shifted by their offsets in the window, are intersected on
   (document, start).  What is left is compared with the payload word by word
   (exact phrases), or up to a slack (proximity).

Test terms and windows are broadcast only where their measured bytes are below
MOST_BROADCAST.  Beyond that single words (document, position, word) are shuffled
to the terms, and the hits of a document meet its text once; a text is never
repeated for its words.  Postings are hashed by document and start, so frequent
words and passages spread.

Nulls: a null text has no words, hence no hits; a null item text has no windows;
null ids are compared null-safely.  Rows that share doc_id and text are one
document's repeats and each gets its result; rows that share only doc_id are
judged apart.  Items without words have no windows; a window of several items
counts for each.  Ties among a window's rarest words go to the earlier one.  A
very long text is one row's array of words while it is indexed.  Empty tables: no
documents give no rows, no items give clean documents.  Only doc_id, text and
item_id are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import MOST_BROADCAST, measured_bytes, sized, table, written

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z lowered, runs of ASCII letters and digits and all else beyond ASCII."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), NOT_WORD), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase, words, items: each distinct window and the ids (as strings) of the items that have it."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    each = w.select("item", "w", length.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    return (
        each.select("item", F.slice("w", F.col("at"), F.col("n")).alias("words"))
        .withColumn("phrase", F.array_join("words", " "))
        .groupBy("phrase", "words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, w: the words from position 1 on, after an empty one that every document has."""
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.concat(F.array(F.lit("")), words(F.col("text"))).alias("w"))


def corpus_counts(docs: DataFrame, wins: DataFrame, limit: int = MOST_BROADCAST) -> DataFrame:
    """term, n: occurrences in all documents of every word of the windows."""
    terms = wins.select(F.explode("words").alias("term")).distinct()
    # outer: else a filter on the words' number is inferred, for which they'd be split twice
    every = _tokens(docs).select(F.explode_outer("w").alias("term"))
    if measured_bytes(terms) <= limit:
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return every.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def with_heads(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds heads: the two rarest words of each window with their offsets; windows with an absent word are left out."""
    each = wins.select("phrase", F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    ranked = each.groupBy("phrase").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by"))
    return wins.join(ranked.where("least > 0"), "phrase").select("phrase", "words", "items", F.size("words").alias("n"), F.slice("by", 1, 2).alias("heads"))


def index(docs: DataFrame, terms: DataFrame, around: int, limit: int = MOST_BROADCAST) -> DataFrame:
    """The written index: term, doc_id, text_key, pos (from 1), length, payload, first (position of the payload's first word).

    The empty term's posting in each document has pos 0 and the document's length; no other has a length.
    """
    tokens = _tokens(docs)
    first = F.greatest(F.lit(1), F.col("pos") - around)
    payload = F.when(F.col("term") != "", F.slice("w", first + 1, F.lit(2 * around + 1)))
    length = F.when(F.col("term") == "", F.size("w") - 1)
    columns = ["term", "doc_id", "text_key", "pos", length.alias("length"), payload.alias("payload"), first.alias("first")]
    if measured_bytes(terms) <= limit:
        with_empty = terms.unionByName(docs.sparkSession.sql("select '' term")).distinct()
        hit = tokens.select("doc_id", "text_key", "w", F.posexplode_outer("w").alias("pos", "term")).join(F.broadcast(with_empty), "term")
        return written(hit.select(*columns), "postings")
    each = tokens.select("doc_id", "text_key", F.posexplode_outer("w").alias("pos", "term")).where("term <> ''").join(terms, "term")
    of_doc = each.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set(F.struct("pos", "term")).alias("hits"))
    lengths = tokens.select(F.lit("").alias("term"), "doc_id", "text_key", F.lit(0).alias("pos"), "w")
    met = tokens.join(of_doc, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")))
    hit = met.select("doc_id", "text_key", "w", F.explode("hits").alias("x")).select("x.term", "doc_id", "text_key", "x.pos", "w")
    return written(hit.unionByName(lengths).select(*columns), "postings")


def matches(postings: DataFrame, wins: DataFrame, slack: int = 0) -> DataFrame:
    """doc_id, text_key, start, n, phrase, items of each occurrence of a window.

    slack 0: exact phrases, found by intersecting both heads' shifted lists.
    slack s > 0: all words of the window, in any order, within a stretch of
    n + s words that holds the window's rarest word (start: of that stretch's
    earliest possible word); needs postings with a payload of n + s words around.
    """
    lists = wins.select("phrase", "words", "items", "n", F.size("heads").alias("lists"), F.posexplode("heads").alias("no", "head"))
    lists = lists.select("phrase", "words", "items", "n", "lists", "no", F.col("head.off").alias("off"), F.col("head.term").alias("term"))
    if slack:
        near = postings.join(sized(lists.where("no = 0")), "term")
        low = F.greatest(F.col("pos") - F.col("n") - slack + 1, F.col("first"))
        stretch = lambda s: F.slice("payload", s - F.col("first") + 1, F.col("n") + slack)
        found = F.filter(F.sequence(low, F.col("pos")), lambda s: F.size(F.array_except("words", stretch(s))) == 0)
        return near.withColumn("found", found).where(F.size("found") > 0).select("doc_id", "text_key", F.array_min("found").alias("start"), "n", "phrase", "items")
    shifted = postings.join(sized(lists), "term").withColumn("start", F.col("pos") - F.col("off"))
    seen = F.slice("payload", F.col("start") - F.col("first") + 1, F.col("n"))
    agrees = (F.col("no") > 0) | ((F.col("start") >= F.col("first")) & (seen == F.col("words")))
    both = (
        shifted.where((F.col("start") >= 1))
        .select("doc_id", "text_key", "start", "n", "lists", "no", F.xxhash64("phrase").alias("win"), F.when(F.col("no") == 0, F.struct("phrase", "items", agrees.alias("agrees"))).alias("w"))
        .groupBy("doc_id", "text_key", "start", "n", "win")
        .agg(F.countDistinct("no").alias("met"), F.first("lists").alias("lists"), F.first("w", ignorenulls=True).alias("w"))
    )
    return both.where("met = lists and w.agrees").select("doc_id", "text_key", "start", "n", "w.phrase", "w.items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items array<string>, spans array<struct<start, n>> of every document."""
    wins = written(windows(items, window), "windows")
    wins = written(with_heads(wins, corpus_counts(docs, wins)), "heads")
    terms = wins.select(F.explode("heads.term").alias("term")).distinct()
    postings = index(docs, terms, window)
    found = matches(postings, wins)
    by_doc = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("start"), F.col("n").alias("n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(1).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["start"] + s["n"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "spans", "items", covered.alias("n_hit"))
    lengths = postings.where("term = ''").select("doc_id", "text_key", F.col("length").cast("long").alias("n_words"))
    return lengths.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
    )


def proximity(docs: DataFrame, items: DataFrame, slack: int, window: int = WINDOW) -> DataFrame:
    """doc_id, start, phrase, items where all words of a window lie within window + slack words, in any order."""
    wins = written(windows(items, window), "windows")
    wins = written(with_heads(wins, corpus_counts(docs, wins)), "heads")
    terms = wins.select(F.explode("heads.term").alias("term")).distinct()
    postings = index(docs, terms, window + slack)
    return matches(postings, wins, slack).select("doc_id", "start", "phrase", "items")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and benchmark items, by windows of ten words."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.phrase = win.phrase AND dw.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
