"""From raw documents to training tokens, in five stages.

    toxicity         documents that the classifier rejects (score >= 0.7) go
    near_dedup       of each group of near copies (five-word shingles, similarity
                     0.8 or more) the document with the smallest doc_id stays
    decontamination  documents with a ten-word benchmark window go
    secrets          secrets in texts are replaced; no document goes
    byte_bpe         texts become token ids, and the ids are decoded again

Each stage reads all that its predecessor kept, as Parquet; all but the last
return the columns of documents.

Nulls: a null text is never toxic, near another or contaminated beyond what an
empty one is, and stays null up to the last stage, where it has no ids; rows
without doc_id or words pass near_dedup.  Repeated rows (equal doc_id and text)
end in one row there; of rows that share doc_id and class the one with the least
hash of its text stays, and rows that share only doc_id are judged apart.  Ties:
the smallest doc_id of a group stays.  Very long texts are bounded as the
operators say.  Empty tables give no rows.  Columns beyond doc_id, text, source
and n_chars pass through untouched, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bytebpe, decontaminate, minhash, secrets, toxicity
from scriptorium.llm.shared import sized, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(spark, docs["text"], model) < toxicity.CUT)


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), d and t: doc_id and the hash of the text.  No column's name can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of keyed() but those in gone (doc_id, text_key; a written table)."""
    gone = gone.select(F.col("doc_id").alias("gd"), F.col("text_key").alias("gt"))
    return rows.join(sized(gone), F.col("d").eqNullSafe(F.col("gd")) & (F.col("t") == F.col("gt")), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(minhash.classes(docs, 5, 80, 100).where("n_shingles > 0 and doc_id is not null"), "pipeline-classes")
    own = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    other = found.where("doc_id = component_id").join(own.where("least < most"), "doc_id").where("text_key > least")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_key").unionByName(other.select("doc_id", "text_key")).distinct()
    kept = without(keyed(docs), written(gone, "pipeline-copies"))
    # repeated rows meet on their keys; without any, this is an exchange of keys only
    again = kept.where("d is not null").groupBy("d", "t").agg(F.count("*").alias("n")).where("n > 1")
    again = written(again.select(F.col("d").alias("doc_id"), F.col("t").alias("text_key")), "pipeline-repeated")
    if not again.limit(1).count():
        return kept.select("row.*")
    ones = kept.join(again, (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("text_key")), "left_semi").dropDuplicates(["d", "t"])
    return without(kept, again).unionByName(ones).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    gone = written(found.select(F.col("doc_id").cast("long").alias("doc_id"), "text_key").distinct(), "pipeline-hits")
    return without(keyed(docs), gone).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.default_forest())
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: Trained models, iteration and tokenizers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
