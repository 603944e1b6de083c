"""Derived texts and listings: cards, salaries, letters, previews, fonts, payload shapes, caches, keyed replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens, truncated
from scriptorium.sources.tables import read, resumes, RESUMES_SQL

# Families of fonts by a piece of their names, first match first.
FONTS = [("courier", "Courier"), ("times", "Times"), ("arial", "Helvetica"), ("helvetica", "Helvetica")]
NESTED = "struct<elements:array<struct<jobView:struct<title:string,company:string,place:string>>>>"
CACHE = "struct<timestamp:string,results:array<struct<id:bigint>>>"


def salary(low: Column, high: Column) -> Column:
    """$1,000 - $2,000, or $1,000+ without an upper end; null without a lower one."""
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    return F.when(high.isNull(), F.concat(money(low), F.lit("+"))).otherwise(F.concat(money(low), F.lit(" - "), money(high)))


def card(title: Column, details: dict[str, Column], description: Column) -> Column:
    """Title, a rule of its length, `Name: value` of details that are there, and at most 300 characters of the description."""
    named = [F.concat(F.lit(f"{k}: "), F.nullif(v, F.lit(""))) for k, v in details.items()]
    return F.concat_ws("\n", title, F.repeat(F.lit("-"), F.length(title)), *named, F.left(description, F.lit(300)))


def wrapped(text: Column, n: int = 70) -> Column:
    return F.regexp_replace(text, f"(?s)(.{{{n}}})", "$1\n")


def filled(template: str, values: dict[str, Column]) -> Column:
    """Literal placeholders replaced by values, in the given order."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(k), v)
    return out


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def bullets(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), "^[-*•][ \t]*", "• ")), "\n")


def preview(text: Column) -> Column:
    bold = F.regexp_replace(text, r"\*\*([^\n]+?)\*\*", "<b>$1</b>")
    return F.replace(F.regexp_replace(bold, r"\*([^\n]+?)\*", "<i>$1</i>"), F.lit("\n"), F.lit("<br>"))


def font(name: Column) -> Column:
    """A base family with its style; a subset prefix goes."""
    own = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    family = F.when(own.contains(FONTS[0][0]), FONTS[0][1])
    for piece, base in FONTS[1:]:
        family = family.when(own.contains(piece), base)
    return F.concat(family.otherwise("Helvetica"), F.when(own.contains("bold"), "-Bold").otherwise(""), F.when(own.rlike("italic|oblique"), "-Italic").otherwise(""))


def nested(payloads: DataFrame) -> DataFrame:
    """Rows of {"elements": [{"jobView": {...}}]} payloads with defaults."""
    rows = payloads.select("provider", F.explode(F.from_json("payload", NESTED)["elements"]).alias("e")).select("provider", "e.jobView.*")
    return rows.select("provider", F.coalesce("title", F.lit("Unknown Title")).alias("title"), F.coalesce("company", F.lit("Unknown Company")).alias("company"), F.coalesce("place", F.lit("Unknown Location")).alias("location"))


def records(texts: DataFrame, key: str) -> DataFrame:
    """key, rec, and the fields of `Key: value` lines; a new title starts the next record, lines before the first are dropped."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    field = F.lower(F.trim(F.regexp_extract("line", "^([A-Za-z ]+):", 1)))
    each = each.select(key, "pos", field.alias("field"), F.trim(F.regexp_extract("line", "^[A-Za-z ]+:([^\n]*)$", 1)).alias("value"))
    each = each.withColumn("rec", F.sum((F.col("field") == "title").cast("int")).over(w).cast("int")).where("rec > 0 and field <> ''")
    last = lambda f: F.max(F.when(F.col("field") == f, F.struct("pos", "value")))["value"].alias(f)
    return each.groupBy(key, "rec").agg(last("title"), last("company"), last("location"))


def catalog(cached: DataFrame) -> DataFrame:
    """name, timestamp, result_count of readable caches; others are left out."""
    c = cached.withColumn("c", F.from_json("payload", CACHE)).where("c.timestamp is not null")
    return c.select("name", "c.timestamp", F.coalesce(F.size("c.results"), F.lit(0)).alias("result_count"))


def upserted(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `base` whose key it lacks."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pj3_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    text = card(F.col("p_name"), {"Company": F.col("p_brand"), "Place": F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")}, F.repeat("p_type", 30))
    return p.select("p_partkey", text.alias("card"), F.md5(wrapped(F.repeat("p_type", 12)).cast("binary")).alias("wrapped_md5"))


def pj7_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.floor(F.abs("c_acctbal") * 10), F.when(F.col("c_custkey") % 3 > 0, F.floor(F.abs("c_acctbal") * 20))
    return read(spark, sf_dir, "customer").select("c_custkey", salary(low, high).alias("salary"))


def pj8_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    letter = filled("[Date]: to [Company Name], about [Job Title] ([Job Title])", {"[Job Title]": F.col("p_name"), "[Company Name]": F.col("p_brand"), "[Date]": F.date_format(F.make_date(F.lit(2024), F.lit(3), 1 + F.col("p_partkey") % 28), "MMMM dd, yyyy")})
    return p.select("p_partkey", letter.alias("letter"), safe_name(F.concat_ws("/", "p_name", "p_type")).alias("file"), slug(F.col("p_name")).alias("slug"), F.left(F.md5(F.concat_ws("|", "p_name", "p_brand").cast("binary")), F.lit(8)).alias("id"))


def pj13_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes(spark, sf_dir).select("doc_id", bullets(F.col("text")).alias("text"))


def pj15_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("**Item** *no* "), F.col("item_id"), F.lit("\n*"), F.col("text"), F.lit("*"))
    return read(spark, sf_dir, "benchmark").select("item_id", preview(t).alias("html"))


def pj16_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(tokens(F.col("text"))).cast("long").alias("words"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


def pj18_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("ABCDEF+ArialMT-Bold", "TimesNewRomanPS", "CourierNew-BoldOblique", "Verdana-Italic")])
    return read(spark, sf_dir, "part").select("p_partkey", font(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("font"))


def pj9_tailored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, the text, and a list of skills where it has no such section."""
    r = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("\nSkills: none"))).otherwise(F.col("text")).alias("t"))
    return r.select("item_id", F.concat_ws("\n\n", F.lit("TAILORED"), "t", F.when(~F.upper("t").contains("SKILLS"), "SKILLS\n- Python\n- SQL")).alias("text"))


def sc19_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("company"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("place"))
    p = read(spark, sf_dir, "part").select(F.lit("nested").alias("provider"), F.to_json(F.struct(F.array(F.struct(view.alias("jobView"))).alias("elements"))).alias("payload"))
    return nested(p)


def sc26_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("Title: "), F.col("p_name"), F.lit("\nCompany:"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\nLocation: "), F.col("p_type"))).otherwise("\nnothing more"))
    p = read(spark, sf_dir, "part").groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("t")))), lambda x: x["t"]).alias("l"))
    return records(p.select("p_size", F.concat(F.lit("Company: early\n"), F.array_join("l", "\n")).alias("text")), "p_size")


def sc31_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.collect_list(F.struct(F.col("o_orderkey").cast("long").alias("id"))).alias("r"))
    payload = F.when(F.col("o_custkey") % 7 == 0, '{"broken').otherwise(F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd").alias("timestamp"), F.col("r").alias("results"))))
    return catalog(cached.select(F.concat(F.lit("search_"), "o_custkey").alias("name"), payload.alias("payload")))


def sk3_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("app_id"), F.col("c_name").alias("name"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("app_id"), F.col("s_name").alias("name"))
    return upserted(base, new, "app_id").where("app_id <> 3")


def sk5_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as JSON and as cards whose description is cut at 40."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("size"))).alias("json"), truncated(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 30).alias("text"))


def sc23_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen sources only, with counts; fixed inline rows where a source has none."""
    c = read(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("source"), "c_custkey")
    stub = spark.sql("SELECT * FROM VALUES ('stub', 1L), ('stub', 2L) AS t(source, c_custkey)")
    every = c.unionByName(stub.withColumn("c_custkey", F.col("c_custkey").cast(c.schema["c_custkey"].dataType)))
    return every.where(F.col("source").isin("stub", "household", "machinery")).groupBy("source").agg(F.count("*").alias("n"))


def looked_up(text: Column, names: list[str]) -> list[Column]:
    """The value of each `Name: value` line, null where there is none."""
    return [F.nullif(F.trim(F.regexp_extract(text, f"(?m)^{n}:([^\\n]*)$", 1)), F.lit("")).alias(n.lower()) for n in names]


def first_readable(candidates: list[Column], least: int = 100) -> Column:
    """The first candidate text with more than `least` characters, else the first that isn't blank."""
    return F.coalesce(*[F.when(F.length(F.trim(x)) > least, x) for x in candidates], *[F.when(F.trim(x) != "", x) for x in candidates])


def best_of_type(found: DataFrame, kind: str, by: str, order: str) -> DataFrame:
    """Of each kind the row with the highest `by`, the first in order on ties."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.col(by).desc(), order))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r")


def pj20_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("intro\nTitle: "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\nBrand: "), F.col("p_brand"))).otherwise(""), F.lit("\nend"))
    return read(spark, sf_dir, "part").select("p_partkey", *looked_up(t, ["Title", "Brand", "Place"]))


def vt6_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(50))), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(""), F.lit("placeholder")]
    return read(spark, sf_dir, "documents").select("doc_id", first_readable(c).alias("text"))


def so11_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    return best_of_type(p, "p_brand", "p_size", "p_partkey")


def ag13_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of expected values by kind, and the change in length in percent."""
    e = read(spark, sf_dir, "part").select("p_brand", bullets(F.concat(F.lit("- "), F.col("p_name"))).alias("actual"), F.concat(F.when(F.col("p_partkey") % 4 > 0, "• ").otherwise("- "), F.col("p_name")).alias("expected"))
    return e.groupBy("p_brand").agg(F.count("*").alias("cases"), F.avg((F.col("actual") == F.col("expected")).cast("double")).alias("rate"), F.sum(F.length("expected") - F.length("actual")).cast("long").alias("delta"))


QUERIES = {f.__name__: f for f in (pj3_cards, pj7_salaries, pj8_letters, pj9_tailored, pj13_bullets, pj15_preview, pj16_stats, pj18_fonts, sc19_nested, sc23_sources, sc26_records, sc31_catalog, sk3_upserted, sk5_listing, pj20_fields, vt6_fallback, so11_best, ag13_passed)}
ORACLE_SQL = {
    "pj3_cards": r"""SELECT p_partkey, concat_ws(E'\n', p_name, repeat('-', length(p_name)), 'Company: ' || p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'Place: ' || p_type END, left(repeat(p_type, 30), 300)) AS card,
 md5(regexp_replace(repeat(p_type, 12), '(?s)(.{70})', E'\\1\n', 'g')) AS wrapped_md5 FROM part""",
    "pj7_salaries": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN concat('$', format('{:,}', CAST(floor(abs(c_acctbal) * 10) AS BIGINT)), ' - $', format('{:,}', CAST(floor(abs(c_acctbal) * 20) AS BIGINT))) ELSE concat('$', format('{:,}', CAST(floor(abs(c_acctbal) * 10) AS BIGINT)), '+') END AS salary FROM customer",
    "pj8_letters": r"""SELECT p_partkey, concat(strftime(make_date(2024, 3, CAST(1 + p_partkey % 28 AS INTEGER)), '%B %d, %Y'), ': to ', p_brand, ', about ', p_name, ' (', p_name, ')') AS letter,
 regexp_replace(concat_ws('/', p_name, p_type), '[^A-Za-z0-9_.\-]', '_', 'g') AS file, replace(lower(p_name), ' ', '-') AS slug, left(md5(concat_ws('|', p_name, p_brand)), 8) AS id FROM part""",
    "pj9_tailored": r"SELECT item_id, concat_ws(E'\n\n', 'TAILORED', t, CASE WHEN NOT contains(upper(t), 'SKILLS') THEN E'SKILLS\n- Python\n- SQL' END) AS text FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN concat(text, E'\nSkills: none') ELSE text END AS t FROM benchmark)",
    "pj13_bullets": rf"WITH {RESUMES_SQL} SELECT doc_id, array_to_string(list_transform(string_split(text, E'\n'), lambda x: regexp_replace(trim(x), '^[-*•][ \t]*', '• ')), E'\n') AS text FROM resumes",
    "pj15_preview": r"SELECT item_id, replace(regexp_replace(regexp_replace(concat('**Item** *no* ', item_id, E'\n*', text, '*'), '\*\*([^\n]+?)\*\*', '<b>\1</b>', 'g'), '\*([^\n]+?)\*', '<i>\1</i>', 'g'), E'\n', '<br>') AS html FROM benchmark",
    "pj16_stats": r"SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS words, len(string_split(text, E'\n')) AS lines FROM documents",
    "pj18_fonts": "SELECT p_partkey, ['Helvetica-Bold', 'Times', 'Courier-Bold-Italic', 'Helvetica-Italic'][p_partkey % 4 + 1] AS font FROM part",
    "sc19_nested": "SELECT 'nested' AS provider, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Unknown Company' END AS company, CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE 'Unknown Location' END AS location FROM part",
    "sc23_sources": "SELECT lower(c_mktsegment) AS source, count(*) AS n FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') GROUP BY 1 UNION ALL SELECT 'stub', 2",
    "sc26_records": "SELECT p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS rec, p_name AS title, p_brand AS company, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS location FROM part",
    "sc31_catalog": "SELECT concat('search_', o_custkey) AS name, strftime(max(o_orderdate), '%Y-%m-%d') AS timestamp, CAST(count(*) AS INTEGER) AS result_count FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey",
    "sk3_upserted": "SELECT * FROM (SELECT CAST(c_custkey AS BIGINT) AS app_id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier) WHERE app_id <> 3",
    "sk5_listing": "SELECT p_partkey, concat('{\"title\":\"', p_name, '\",\"size\":', p_size, '}') AS json, CASE WHEN length(concat_ws(' ', p_name, p_type, p_brand)) > 30 THEN concat(left(concat_ws(' ', p_name, p_type, p_brand), 27), '...') ELSE concat_ws(' ', p_name, p_type, p_brand) END AS text FROM part",
    "pj20_fields": "SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, CAST(NULL AS VARCHAR) AS place FROM part",
    "vt6_fallback": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(trim(text)) > 100 THEN text WHEN doc_id % 3 = 0 AND trim(left(text, 50)) <> '' THEN left(text, 50) WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text ELSE 'placeholder' END AS text FROM documents",
    "so11_best": "SELECT p_brand, p_size, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1",
    "ag13_passed": "SELECT p_brand, count(*) AS cases, avg(CASE WHEN p_partkey % 4 > 0 THEN 1.0 ELSE 0.0 END) AS rate, CAST(0 AS BIGINT) AS delta FROM part GROUP BY p_brand",
}
