"""Listings from several sources and applications through their states: payload parsing, federation, event folds, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import truncated
from scriptorium.sources.tables import read

# States of an application in order of priority, and the event that leads to each in the test data.
STATES = {"signup": "preparing", "view": "applied", "click": "interview_scheduled", "purchase": "offered", "error": "rejected"}
# The order of a whole listing; any other state comes last (99).
LISTED = {s: i for i, s in enumerate(["offered", "interview_scheduled", "applied", "preparing", "rejected", "withdrawn"])}
FLAT = "struct<results:array<struct<title:string,company:string,city:string,location:string,snippet:string>>>"


def parsed(payloads: DataFrame) -> DataFrame:
    """Rows of {"results": [...]} payloads; a missing title or company has a default, a missing location is the city."""
    rows = payloads.select("provider", F.posexplode(F.from_json("payload", FLAT)["results"]).alias("pos", "r"))
    return rows.select("provider", "pos", F.coalesce("r.title", F.lit("Unknown Title")).alias("title"), F.coalesce("r.company", F.lit("Unknown Company")).alias("company"), F.coalesce("r.location", "r.city", F.lit("")).alias("location"), truncated(F.coalesce("r.snippet", F.lit("")), 20).alias("snippet"))


def federated(sources: list[DataFrame]) -> DataFrame:
    """UNION ALL in the given order; columns that a source lacks are null; src_ord tells the source."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def folded(events: DataFrame) -> DataFrame:
    """app_id, status, applied_date, n_events, notes: the current state is the latest event's; applied on the first such event."""
    status = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = events.withColumn("status", F.element_at(status, F.col("kind")))
    notes = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "kind"))), lambda x: x["kind"])
    return e.groupBy("app_id").agg(
        F.max(F.struct("ts", "seq", "status"))["status"].alias("status"),
        F.date_format(F.min(F.when(F.col("status") == "applied", F.col("ts"))), "yyyy-MM-dd").alias("applied_date"),
        F.count("*").alias("n_events"), F.array_join(F.slice(notes, 1, 3), ";").alias("first_events"),
    )


def noted(events: DataFrame) -> DataFrame:
    """app_id, n_notes, notes: every event in order as a line "[yyyy-MM-dd HH:mm:ss] kind"."""
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.coalesce("kind", F.lit("")))
    notes = F.array_sort(F.collect_list(F.struct("ts", "seq", F.coalesce(line, F.col("kind"), F.lit("")).alias("note"))))
    return events.groupBy("app_id").agg(F.count("*").alias("n_notes"), F.array_join(F.transform(notes, lambda x: x["note"]), "\n").alias("notes"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("app_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("kind"))


def tr5_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(events(spark, sf_dir))


def tr3_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noted(events(spark, sf_dir))


def ag6_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(events(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.min("applied_date").alias("first_applied"), F.array_join(F.transform(F.array_sort(F.collect_list("app_id")), lambda x: x.cast("string")), ",").alias("applications"))


def listing(applications: DataFrame, status: str | None = None, today: str | None = None) -> DataFrame:
    """app_id, status, priority, date of every application, or of those in one status, by priority, then date (today where none), then id."""
    rows = applications if status is None else applications.where(F.col("status") == status)
    prio = F.create_map(*[F.lit(x) for kv in LISTED.items() for x in kv])
    now = F.lit(today) if today else F.date_format(F.current_date(), "yyyy-MM-dd")
    rows = rows.select("app_id", "status", F.coalesce(F.element_at(prio, F.col("status")), F.lit(99)).alias("priority"), F.coalesce("applied_date", now).alias("date"))
    return rows.orderBy("priority", "date", "app_id")


def so2_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications; those without a date come last in their status, as the result must not depend on the day."""
    return listing(folded(events(spark, sf_dir)), today="9999-12-31")


def sc20_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey") % 3).alias("provider"),
        F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("company"), F.col("p_type").alias("city"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")).alias("snippet"))).alias("results"))).alias("payload"),
    )
    return parsed(p).drop("pos")


def se1_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources under one schema, the ten best paid of each nation by source (a per-source limit)."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").alias("place"), F.col("s_acctbal").alias("pay"))
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("pay"), F.col("c_mktsegment").alias("segment"))
    rank = F.row_number().over(Window.partitionBy("src_ord", "place").orderBy(F.col("pay").desc(), "title"))
    return federated([s, c]).withColumn("rank", rank).where("rank <= 10")


def wn7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between headers as-of their position: each line item belongs to the last first-line item before it in its order; extents by min and max."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").withColumn("section", F.last(head, ignorenulls=True).over(w)).groupBy("l_orderkey", "section").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_extendedprice").alias("y0"), F.max("l_extendedprice").alias("y1")
    )


def sk7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text, one line a turn."""
    line = F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    c = read(spark, sf_dir, "conversations").withColumn("line", line)
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").cast("binary")).alias("md5"))


QUERIES = {"tr5_states": tr5_states, "tr3_notes": tr3_notes, "ag6_by_status": ag6_by_status, "so2_applications": so2_applications, "sc20_payloads": sc20_payloads, "se1_federated": se1_federated, "wn7_spans": wn7_spans, "sk7_chat": sk7_chat}
_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
_FOLD = f"""f AS (SELECT user_id AS app_id, arg_max(status, (ts, event_id)) AS status, strftime(min(CASE WHEN status = 'applied' THEN ts END), '%Y-%m-%d') AS applied_date, count(*) AS n_events,
 array_to_string(list(event_type ORDER BY ts, event_id)[1:3], ';') AS first_events FROM (SELECT *, {_STATUS} AS status FROM events) GROUP BY user_id)"""
_LISTED = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LISTED.items()) + " ELSE 99 END"
ORACLE_SQL = {
    "tr5_states": f"WITH {_FOLD} SELECT * FROM f",
    "tr3_notes": r"SELECT user_id AS app_id, count(*) AS n_notes, string_agg(concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S'), '] ', event_type), E'\n' ORDER BY ts, event_id) AS notes FROM events GROUP BY user_id",
    "ag6_by_status": f"WITH {_FOLD} SELECT status, count(*) AS n, min(applied_date) AS first_applied, string_agg(CAST(app_id AS VARCHAR), ',' ORDER BY app_id) AS applications FROM f GROUP BY status",
    "so2_applications": f"WITH {_FOLD} SELECT app_id, status, CAST({_LISTED} AS INTEGER) AS priority, coalesce(applied_date, '9999-12-31') AS date FROM f ORDER BY priority, date, app_id",
    "sc20_payloads": "SELECT concat('p', p_partkey % 3) AS provider, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Unknown Company' END AS company, p_type AS location, CASE WHEN length(concat(p_name, ' ', p_type)) > 20 THEN concat(left(concat(p_name, ' ', p_type), 17), '...') ELSE concat(p_name, ' ', p_type) END AS snippet FROM part",
    "se1_federated": """WITH u AS (SELECT s_name AS title, s_nationkey AS place, s_acctbal AS pay, NULL AS segment, CAST(0 AS INTEGER) AS src_ord FROM supplier UNION ALL SELECT c_name, c_nationkey, c_acctbal, c_mktsegment, 1 FROM customer),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src_ord, place ORDER BY pay DESC, title) AS INTEGER) AS rank FROM u) SELECT * FROM r WHERE rank <= 10""",
    "wn7_spans": """WITH s AS (SELECT *, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS section FROM lineitem)
SELECT l_orderkey, section, count(*) AS n, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM s GROUP BY ALL""",
    "sk7_chat": r"SELECT conv_id, count(*) AS turns, md5(string_agg(concat('[', turn, '] ', role, ': ', text), E'\n' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id",
}
