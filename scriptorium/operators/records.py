"""Listings and applications as nested records, their text forms, payload shapes, lookups, orders and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens
from scriptorium.operators.sections import sections
from scriptorium.sources.tables import RESUMES_SQL, read, resumes

LISTING = "struct<id:bigint,title:string,company:string,salary:double,skills:array<string>>"
APPLICATION = "struct<app_id:bigint,status:string,job:struct<title:string,company:string>,interviews:array<struct<date:string,kind:string>>>"
PANELS = "struct<response:struct<jobListings:array<struct<jobTitle:string,employer:struct<name:string>,city:string,state:string>>>>"
# Labels of states.
LABELS = {"O": "In preparation", "F": "Applied", "P": "Interview scheduled"}


def round_trip(record: Column, schema: str) -> Column:
    """A record as JSON and back: what a cache file keeps of it."""
    return F.from_json(F.to_json(record), schema)


def first_of(*paths: Column) -> Column:
    """The first path that is there and not empty."""
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in paths])


def resume_text(name: Column, contacts: list[Column], parts: Column) -> Column:
    """# name, contacts that are there joined by bars, and sections underlined by their length; parts: array<struct<title, content>>."""
    line = F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in contacts])
    body = F.array_join(F.transform(parts, lambda p: F.concat_ws("\n", p["title"], F.repeat(F.lit("-"), F.length(p["title"])), p["content"])), "\n\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name), F.nullif(line, F.lit("")), F.nullif(body, F.lit("")))


def joined_sections(parts: Column) -> Column:
    """title, line end, content; sections apart by a blank line."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws("\n", p["title"], p["content"])), "\n\n")


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at, kind, body: bullets with the lines that go on below them, and other lines; blank lines end a bullet."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    each = each.withColumns({"bullet": F.col("line").rlike("^[-*•]"), "blank": F.col("line") == ""})
    last = lambda flag: F.coalesce(F.max(F.when(F.col(flag), F.col("i"))).over(w), F.lit(-1))
    each = each.withColumns({"b": last("bullet"), "e": last("blank")}).where(~F.col("blank"))
    each = each.withColumn("at", F.when(F.col("b") > F.col("e"), F.col("b")).otherwise(F.col("i")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.regexp_replace("line", "^[-*•] *", "").alias("x")))), lambda s: s["x"]), " ")
    return each.groupBy(key, "at").agg(F.when(F.max(F.col("bullet").cast("int")) == 1, "bullet").otherwise("line").alias("kind"), body.alias("body"))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.struct(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("company"), F.col("p_retailprice").alias("salary"), F.split("p_type", " ").alias("skills")).alias("job"))


def pj1_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings through JSON and back; absent fields stay absent."""
    back = _listings(spark, sf_dir).select("p_partkey", round_trip(F.col("job"), LISTING).alias("j"))
    return back.select("p_partkey", "j.title", "j.company", "j.salary", F.array_join("j.skills", "/").alias("skills"))


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application for each order: its job and its interviews (the line items)."""
    talk = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("kind")))).alias("interviews"))
    o = read(spark, sf_dir, "orders").join(talk, "o_orderkey", "left")
    job = F.struct(F.col("o_orderpriority").alias("title"), F.concat(F.lit("C"), F.col("o_custkey")).alias("company"))
    return o.select("o_orderkey", F.struct(F.col("o_orderkey").cast("long").alias("app_id"), F.col("o_orderstatus").alias("status"), job.alias("job"), "interviews").alias("a"))


def pj2_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _applications(spark, sf_dir).select(round_trip(F.col("a"), APPLICATION).alias("a"))
    kinds = F.array_join(F.transform("a.interviews", lambda i: F.concat_ws(":", i["date"], i["kind"])), ",")
    return back.select("a.app_id", "a.status", "a.job.title", "a.job.company", F.coalesce(kinds, F.lit("")).alias("interviews"))


def pj4_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application as a card: title at company, the state's label, and the next interview."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("a.status")), F.col("a.status"))
    following = F.array_min(F.transform("a.interviews", lambda i: i["date"]))
    card = F.concat_ws("\n", F.concat_ws(" at ", "a.job.title", "a.job.company"), F.concat(F.lit("Status: "), label), F.concat(F.lit("Next interview: "), following))
    return _applications(spark, sf_dir).select(F.col("a.app_id").alias("app_id"), card.alias("card"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(resumes(spark, sf_dir)).where("title is not null")
    return s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "content"))).alias("parts"))


def pj5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("user"), F.col("doc_id"), F.lit("@example.com"))).otherwise(F.lit(""))
    return _parts(spark, sf_dir).select("doc_id", F.md5(resume_text(F.lit("Alex Example"), [mail, F.lit("555-0100")], F.col("parts")).cast("binary")).alias("md5"))


def pj6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", F.md5(joined_sections(F.col("parts")).cast("binary")).alias("md5"), F.size("parts").alias("n"))


def pj10_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes for an interview: company, title, and a question for each skill asked."""
    asked = F.transform("job.skills", lambda s: F.concat(F.lit("- Where did you use "), F.lower(s), F.lit("?")))
    text = F.concat_ws("\n", F.concat(F.lit("Interview: "), F.col("job.title")), F.concat(F.lit("Company: "), F.col("job.company")), F.lit("Questions:"), F.array_join(asked, "\n"))
    return _listings(spark, sf_dir).select("p_partkey", text.alias("notes"))


def pj14_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(resumes(spark, sf_dir), "doc_id")


def sc21_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{"response": {"jobListings": [...]}} payloads of several rows each, with positions; city and state make the location."""
    row = F.struct(F.col("p_partkey").alias("k"), F.struct(F.col("p_name").alias("jobTitle"), F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("name")).alias("employer"), F.col("p_type").alias("city"), F.when(F.col("p_size") > 25, F.lit("ST")).alias("state")).alias("x"))
    lists = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("page")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("l"))
    payload = lists.select("page", F.to_json(F.struct(F.struct(F.col("l").alias("jobListings")).alias("response"))).alias("payload"))
    found = payload.select("page", F.posexplode(F.from_json("payload", PANELS)["response"]["jobListings"]).alias("pos", "r"))
    return found.select("page", "pos", F.coalesce("r.jobTitle", F.lit("Unknown Title")).alias("title"), F.coalesce("r.employer.name", F.lit("Unknown Company")).alias("company"), F.concat_ws(", ", "r.city", "r.state").alias("location"))


def sc25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under alternative names: the first that is there, else a placeholder."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("title"), F.when(F.col("p_size") % 3 == 1, F.col("p_type")).alias("jobTitle"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("company"))
    return p.select("p_partkey", F.coalesce(first_of(F.col("title"), F.col("jobTitle")), F.lit("Unknown Title")).alias("title"), F.coalesce(first_of(F.col("company")), F.lit("Unknown Company")).alias("company"))


def sc30_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches cached as JSON (one for each brand) and read back, newest name first; each row with its position."""
    jobs = _listings(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    cache = jobs.groupBy("p_brand").agg(F.to_json(F.struct(F.struct(F.array(F.col("p_brand")).alias("keywords")).alias("search_params"), F.array_sort(F.collect_list("job")).alias("results"))).alias("payload"))
    back = cache.select("p_brand", F.from_json("payload", f"struct<search_params:struct<keywords:array<string>>,results:array<{LISTING}>>").alias("c"))
    return back.select(F.element_at("c.search_params.keywords", 1).alias("keyword"), F.posexplode("c.results").alias("pos", "r")).select("keyword", "pos", "r.id", "r.title").orderBy(F.col("keyword").desc(), "pos")


def sc32_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by id: a missing id gives a row without a state."""
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("app_id"))
    return ids.join(_applications(spark, sf_dir).select("a.app_id", "a.status"), "app_id", "left").select("app_id", "status", F.col("status").isNotNull().alias("found"))


def so1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by score (none is 0), highest first, in their own order on ties."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("match_score"))
    return p.orderBy(F.coalesce("match_score", F.lit(0)).desc(), "p_partkey")


def so9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of line items on their page from the top down, then from the left."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.row_number().over(w).alias("place"))


def fl2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications of one state; the filter reaches the scan."""
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")


def fl7_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the fields that they lack; none is good."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).alias("title"), F.when(F.col("p_size") < 45, F.col("p_brand")).otherwise(" ").alias("company"))
    lacks = F.array_join(F.filter(F.array(*[F.when(first_of(F.col(c)).isNull(), F.lit(c)) for c in ("title", "company")]), lambda x: x.isNotNull()), ",")
    return p.select("p_partkey", lacks.alias("lacks"), (lacks == "").alias("good"))


def jn5_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the new text of their type where there is one."""
    new = {"skills": "Spark and SQL", "summary": "Careful worker", "awards": "none"}
    table = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
    s = sections(resumes(spark, sf_dir))
    return s.select("doc_id", "seq", F.coalesce(F.try_element_at(table, F.col("type")), F.col("content")).alias("content"))


def jn7_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text on the blocks of a page by position; what has no partner goes."""
    lines = resumes(spark, sf_dir).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    blocks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_quantity").alias("x0"))
    return blocks.join(lines, ["page", "pos"])


def ag15_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's methods by words; the first with the most words is best."""
    texts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("method"), F.size(tokens(x)).alias("words")) for i, (n, x) in enumerate([("plain", F.col("text")), ("squeezed", F.regexp_replace("text", "[.,]", " ")), ("lines", F.replace("text", F.lit("\n"), F.lit("")))])])
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(texts).alias("m")).groupBy("doc_id").agg(F.max_by("m.method", F.struct("m.words", -F.col("m.ord"))).alias("best"), F.max("m.words").alias("words"), F.sum("m.words").alias("all_words"))


def sk6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session JSON and back: messages in order."""
    c = read(spark, sf_dir, "conversations")
    made = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("sender"), F.col("text").alias("message")))).alias("chat_history"))).alias("session"))
    back = made.select("conv_id", F.from_json("session", "struct<chat_history:array<struct<turn:bigint,sender:string,message:string>>>")["chat_history"].alias("h"))
    return back.select("conv_id", F.size("h").alias("n"), F.md5(F.array_join(F.transform("h", lambda m: F.concat_ws(":", m["sender"], m["message"])), "\n").cast("binary")).alias("md5"))


def cp19_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the answer that follows it, if any."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return c.where("role = 'user'").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("asked"), F.md5(F.when(F.col("next_role") == "assistant", F.col("next_text")).cast("binary")).alias("answered"))


QUERIES = {f.__name__: f for f in (pj1_listings, pj2_applications, pj4_cards, pj5_texts, pj6_texts, pj10_preparation, pj14_paragraphs, sc21_panels, sc25_normalised, sc30_cached, sc32_lookups, so1_ranked, so9_spans, fl2_status, fl7_validated, jn5_replaced, jn7_zipped, ag15_methods, sk6_sessions, cp19_turns)}


def _oracles() -> dict[str, str]:
    from scriptorium.operators.sections import ORACLE_SQL as SECTIONS

    parts = f"q AS ({SECTIONS['sx27_sections']}), p AS (SELECT * FROM q WHERE title <> '')"
    apps = "t AS (SELECT l_orderkey AS app_id, list({'date': strftime(l_shipdate, '%Y-%m-%d'), 'kind': l_returnflag} ORDER BY strftime(l_shipdate, '%Y-%m-%d'), l_returnflag) AS i FROM lineitem GROUP BY ALL), a AS (SELECT o_orderkey AS app_id, o_orderstatus AS status, o_orderpriority AS title, concat('C', o_custkey) AS company, i FROM orders LEFT JOIN t ON app_id = o_orderkey)"
    first = "coalesce(nullif(trim({}, ' '), ''), {})"
    count = r"len(list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))"
    return {
        "pj1_listings": "SELECT p_partkey, p_name AS title, CASE WHEN p_size > 10 THEN p_brand END AS company, p_retailprice AS salary, replace(p_type, ' ', '/') AS skills FROM part",
        "pj2_applications": f"WITH {apps} SELECT app_id, status, title, company, coalesce(array_to_string(list_transform(i, lambda x: concat(x.date, ':', x.kind)), ','), '') AS interviews FROM a",
        "pj4_cards": f"WITH {apps} SELECT app_id, concat_ws(E'\\n', concat(title, ' at ', company), concat('Status: ', CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE status END), 'Next interview: ' || list_min(list_transform(i, lambda x: x.date))) AS card FROM a",
        "pj5_texts": f"WITH {parts}, b AS (SELECT doc_id, string_agg(concat(title, E'\\n', repeat('-', length(title)), E'\\n', content), E'\\n\\n' ORDER BY seq) AS b FROM p GROUP BY doc_id) SELECT doc_id, md5(concat(E'# Alex Example\\n\\n', CASE WHEN doc_id % 3 <> 0 THEN concat('user', doc_id, '@example.com | ') ELSE '' END, E'555-0100\\n\\n', b)) AS md5 FROM b",
        "pj6_texts": f"WITH {parts} SELECT doc_id, md5(string_agg(concat(title, E'\\n', content), E'\\n\\n' ORDER BY seq)) AS md5, CAST(count(*) AS INTEGER) AS n FROM p GROUP BY doc_id",
        "pj10_preparation": "SELECT p_partkey, concat_ws(E'\\n', concat('Interview: ', p_name), 'Company: ' || CASE WHEN p_size > 10 THEN p_brand END, 'Questions:', array_to_string(list_transform(string_split(p_type, ' '), lambda s: concat('- Where did you use ', lower(s), '?')), E'\\n')) AS notes FROM part",
        "pj14_paragraphs": rf"""WITH {RESUMES_SQL}, e AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS i, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM resumes)),
m AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '^[-*•]') THEN i END) OVER w, -1) AS b, coalesce(max(CASE WHEN line = '' THEN i END) OVER w, -1) AS e FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, CASE WHEN b > e THEN b ELSE i END AS "at" FROM m WHERE line <> '') SELECT doc_id, "at", CASE WHEN bool_or(regexp_matches(line, '^[-*•]')) THEN 'bullet' ELSE 'line' END AS kind, string_agg(regexp_replace(line, '^[-*•] *', ''), ' ' ORDER BY i) AS body FROM g GROUP BY doc_id, "at" """,
        "sc21_panels": "SELECT p_partkey % 50 AS page, CAST(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Unknown Company' END AS company, concat(p_type, CASE WHEN p_size > 25 THEN ', ST' ELSE '' END) AS location FROM part",
        "sc25_normalised": f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE 'Unknown Title' END AS title, {first.format("CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END", "'Unknown Company'")} AS company FROM part",
        "sc30_cached": "SELECT p_brand AS keyword, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_partkey AS id, p_name AS title FROM part",
        "sc32_lookups": "SELECT c_custkey AS app_id, o_orderstatus AS status, o_orderstatus IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_orderkey = c_custkey",
        "so1_ranked": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS match_score FROM part",
        "so9_spans": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem",
        "fl2_status": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
        "fl7_validated": "WITH l AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size <= 5 THEN 'title' END, CASE WHEN p_size >= 45 THEN 'company' END], lambda x: x IS NOT NULL), ',') AS lacks FROM part) SELECT p_partkey, lacks, lacks = '' AS good FROM l",
        "jn5_replaced": f"WITH q AS ({SECTIONS['sx27_sections']}) SELECT doc_id, seq, CASE type WHEN 'skills' THEN 'Spark and SQL' WHEN 'summary' THEN 'Careful worker' ELSE content END AS content FROM q",
        "jn7_zipped": rf"""WITH {RESUMES_SQL}, e AS (SELECT doc_id AS page, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM resumes)),
b AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos, l_quantity AS x0 FROM lineitem) SELECT page, pos, x0, line FROM b JOIN e USING (page, pos)""",
        "ag15_methods": f"WITH c AS (SELECT doc_id, {count.format('text')} AS a, {count.format("regexp_replace(text, '[.,]', ' ', 'g')")} AS b, {count.format("replace(text, E'\\n', '')")} AS c FROM documents) SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'plain' WHEN b >= c THEN 'squeezed' ELSE 'lines' END AS best, CAST(greatest(a, b, c) AS INTEGER) AS words, a + b + c AS all_words FROM c",
        "sk6_sessions": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(concat_ws(':', role, text), E'\\n' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id",
        "cp19_turns": "SELECT conv_id, turn, md5(text) AS asked, md5(CASE WHEN nr = 'assistant' THEN nt END) AS answered FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
    }


ORACLE_SQL = _oracles()
