"""Pages, spans and word rows, boundaries and sections of lines, classified parts, and composed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import capitalised, tokens
from scriptorium.operators import advice, chains, structure
from scriptorium.operators.layout import spaced
from scriptorium.operators.repair import corrected
from scriptorium.operators.sections import analysis, sections
from scriptorium.sources.tables import DAMAGED_SQL, POSTINGS_SQL, RESUMES_SQL, damaged, postings, read, resumes

# Headers of four types, as whole lines.
FOUR = {
    "education": "education|educational|academic|qualifications|degrees?|educational background|academic history", "experience": "work experience|professional experience|employment|work history|experience|professional background",
    "skills": "skills|technical skills|proficiencies|expertise|core competencies|key skills|professional skills", "summary": "professional summary|summary|profile|objective|career objective|professional profile|about me",
}
MOST_WORDS = 150


def word_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, word, conf: rows of a tab-separated listing (level, line, conf, text) at word level with a word in them."""
    rows = df.select(key, F.explode(F.split(text, "\n")).alias("row")).select(key, F.split("row", "\t").alias("f"))
    return rows.where((F.get("f", F.lit(0)) == "5") & (F.trim(F.get("f", F.lit(3))) != "")).select(key, F.get("f", F.lit(1)).cast("int").alias("line"), F.get("f", F.lit(3)).alias("word"), F.get("f", F.lit(2)).cast("int").alias("conf"))


def four_sections(df: DataFrame) -> DataFrame:
    """doc_id, seq, type, title, content: sections that start at a line that is a header of four types."""
    w = Window.partitionBy("doc_id").orderBy("i")
    low = F.lower(F.regexp_replace("line", "[ :]+$", ""))
    kind = F.coalesce(*[F.when(low.rlike(f"^({p})$"), F.lit(k)) for k, p in FOUR.items()])
    each = structure.lines(df).withColumn("kind", kind).withColumn("seq", F.sum(F.col("kind").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("seq > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNull() & (F.col("line") != ""), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    return each.groupBy("doc_id", "seq").agg(F.max("kind").alias("type"), F.max(F.when(F.col("kind").isNotNull(), F.col("line"))).alias("title"), body.alias("content"))


def sc12_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of an order's lines as word rows and back; other levels and blank words go."""
    row = F.concat_ws("\t", F.when(F.col("l_linenumber") % 4 == 0, "4").otherwise("5"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey"))))
    made = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("listing"))
    return word_rows(made, "l_orderkey", "listing")


def sc16_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest span of each line, and whether any is bold."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("size"), F.bool_or(F.col("l_linestatus") == "F").alias("bold"))


def ag11_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page, and its class: many blocks are complex, several columns are columns."""
    p = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("blocks"), F.count_distinct("l_returnflag").alias("columns"))
    return p.select("l_orderkey", "blocks", F.when(F.col("blocks") > 5, "complex").when(F.col("columns") > 1, "columns").otherwise("simple").alias("class"))


def sx10_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 0 and the peaks of the header scores that lie three lines or more behind the boundary before."""
    scored = structure.QUERIES["sx9_scores"](spark, sf_dir)
    at = F.array_sort(F.collect_list(F.when(F.col("peak") | (F.col("i") == 0), F.col("i").cast("int"))))
    kept = spaced(F.col("at"))
    return scored.groupBy("doc_id").agg(at.alias("at")).select("doc_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("boundaries"))


def sx14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four_sections(resumes(spark, sf_dir))


def sx15_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by size, weight, capitals, colon and family: four points or more are a header."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(F.col("p_size") % 7 == 0, ":").otherwise(""), F.when(F.col("p_size") % 6 == 0, " Skills").otherwise("")).alias("text"), (F.col("p_size") / 3.0).alias("size"), (F.col("p_size") % 2 == 0).alias("bold"))
    score = F.when(F.col("size") > 12, 3).when(F.col("size") > 10, 1).otherwise(0) + F.when(F.col("bold"), 2).otherwise(0) + F.when(~F.col("text").rlike("[a-z]"), 2).otherwise(0) + F.when(F.col("text").rlike(":$"), 1).otherwise(0) + F.when(F.lower("text").rlike("skills|education|experience"), 3).otherwise(0)
    return p.withColumn("score", score).select("p_partkey", "score", (F.col("score") >= 4).alias("header"), ((F.col("size") > 11) & (F.col("bold") | ~F.col("text").rlike("[a-z]")) | (F.col("size") >= 14)).alias("formatted"))


def sx17_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any header: the lines in thirds, as contact, experience and skills."""
    each = structure.lines(damaged(spark, sf_dir)).where("line <> ''")
    w = Window.partitionBy("doc_id")
    each = each.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("i")) - 1})
    part = F.floor(F.col("r") * 3 / F.col("n")).cast("int")
    names = F.array(F.lit("contact"), F.lit("experience"), F.lit("skills"))
    return each.groupBy("doc_id", part.alias("part")).agg(F.count("*").alias("lines"), F.min("i").alias("first")).select("doc_id", F.element_at(names, F.col("part") + 1).alias("type"), "lines", "first")


def sx18_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of more than 150 words by the evidence of their lines: a line without any goes on with the type before."""
    big = sections(resumes(spark, sf_dir)).where(F.size(tokens(F.col("content"))) > MOST_WORDS)
    each = big.select("doc_id", "seq", "type", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    low = F.lower("line")
    own = F.when(low.rlike("university|college|degree|school"), "education").when(low.rlike("(19|20)[0-9]{2} *[-–] *((19|20)[0-9]{2}|present)|manager|engineer"), "experience").when(low.rlike("python|sql|java|software"), "skills")
    w = Window.partitionBy("doc_id", "seq").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("kind", F.coalesce(F.last(own, ignorenulls=True).over(w), F.col("type")))
    return each.groupBy("doc_id", "seq", "kind").agg(F.count("*").alias("lines"), F.min("i").alias("first"))


def sx29_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in order with their words; the longest comes first in rank, the earlier on ties."""
    s = sections(resumes(spark, sf_dir)).select("doc_id", "seq", "type", F.size(tokens(F.col("content"))).alias("words"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("words").desc(), "seq")))


def sx19_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way that finds more than one section in a page: headers of four types, header scores, else thirds; and how many it finds."""
    headers = [w for p in FOUR.values() for w in p.replace("degrees?", "degree|degrees").split("|")]
    typed = F.lower(F.rtrim("line", F.lit(" :"))).isin(headers)
    scored = structure.header_scores(structure.lines(damaged(spark, sf_dir)), typed=typed)
    both = scored.groupBy("doc_id").agg(*[F.sum(F.col(c).cast("int")).alias(n) for c, n in (("typed", "typed"), ("peak", "peaks"))]).where("doc_id IS NOT NULL")
    tier = F.when(F.col("typed") > 1, "pattern").when(F.col("peaks") > 1, "format").otherwise("default")
    return both.select("doc_id", tier.alias("tier"), F.when(F.col("typed") > 1, F.col("typed")).when(F.col("peaks") > 1, F.col("peaks")).otherwise(3).alias("n"))


def sc22_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand for a source without access: two for each query, the second remote."""
    made = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(F.lit(t), F.initcap("n_name"), F.lit(u)).alias("title"), F.lit(p).alias("location")) for i, (t, u, p) in enumerate([("Senior ", " Clerk", "on site"), ("", " Writer", "remote")])])
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(made).alias("r")).select("n_nationkey", "r.*")


def se6_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources under one schema; what both hold stays twice."""
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place"), F.lit("a").alias("source"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("place"), F.lit("b").alias("source"))
    return a.unionByName(b).groupBy("place").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def cp21_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each event: its own over the defaults, unknown ones left out."""
    own = F.from_json("props", "struct<k:int>")["k"]
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(own, F.lit(10)).alias("k"), F.lit("light").alias("theme"))


def jn9_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the class that the classifier gave them."""
    found = structure.QUERIES["sx20_classified"](spark, sf_dir)
    return sections(resumes(spark, sf_dir)).select("doc_id", "seq", F.col("type").alias("by_title")).join(found, ["doc_id", "seq"])


def jn2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One résumé (the first) against every posting: a side of one row."""
    jobs = postings(spark, sf_dir)
    one = resumes(spark, sf_dir).orderBy("doc_id").limit(1).select(F.col("text").alias("answer"))
    both = jobs.join(advice.job_keywords(jobs, "item_id"), "item_id").crossJoin(F.broadcast(one))
    out = advice.analysed(both, F.col("keywords"), F.col("text"), F.col("answer"))
    return out.select("item_id", F.size("present").alias("present"), F.size("missing").alias("missing"), "score")


def so5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rules with the most substitutions."""
    return chains.rp1_substitutions(spark, sf_dir).where("name <> ''").orderBy(F.col("n").desc(), "name").limit(10)


def ex8_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that the library changes, before and after."""
    each = structure.lines(damaged(spark, sf_dir)).withColumn("after", chains.LIBRARY.apply(F.col("line")))
    return each.where("after <> line").select("doc_id", "i", F.col("line").alias("before"), "after")


def cp27_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each problem word before and after the corrections."""
    d = damaged(spark, sf_dir).withColumn("after", chains.corrected_text(F.col("text")))
    words = list(chains.CORRECTIONS)
    sums = d.agg(*[F.sum(F.col(c).contains(w).cast("long")).alias(f"{c}_{i}") for i, w in enumerate(words) for c in ("text", "after")])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.coalesce(f"text_{i}", F.lit(0)).alias("before"), F.coalesce(f"after_{i}", F.lit(0)).alias("after")) for i, w in enumerate(words)])).alias("x")).select("x.*")


def rp14_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word corrections with the case of the word, then the patterns."""
    lower = {k: v for k, v in chains.CORRECTIONS.items() if k == k.lower()}
    return damaged(spark, sf_dir).select("doc_id", chains.patterns(corrected(F.col("text"), lower)).alias("repaired"))


def pj19_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of a posting as Markdown."""
    jobs = postings(spark, sf_dir)
    items = lambda c: F.array_join(F.transform(F.split(c, ","), lambda x: F.concat(F.lit("- "), x)), "\n")
    found = advice.mt2_analysis(spark, sf_dir)
    return found.select("item_id", F.concat_ws("\n", F.concat(F.lit("## Score: "), F.col("score")), F.lit("### Present"), items("present"), F.lit("### Missing"), items("missing")).alias("markdown")).join(jobs.select("item_id"), "item_id")


def cp2_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on every résumé: sections, their classes by title and content, and what is missing."""
    parsed = sections(resumes(spark, sf_dir))
    classes = structure.QUERIES["sx20_classified"](spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type"))), lambda x: x["type"]), ",").alias("classes"))
    return analysis(parsed).join(classes, "doc_id")


def cp14_tailored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on every damaged page: the chain for pages, the final chain, and text that a screening program reads."""
    from scriptorium.operators.repair import ATS

    done = chains.final_text(chains.page_text(damaged(spark, sf_dir)))
    return done.select("doc_id", F.md5(F.trim(ATS.apply(F.col("text"))).cast("binary")).alias("md5"))


def st_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of words, title case, centring and URL quoting."""
    n = F.col("p_name")
    pad = F.greatest(70 - F.length(n), F.lit(0))
    return read(spark, sf_dir, "part").select(
        "p_partkey", (n.rlike("[A-Z]") & ~n.rlike("[a-z]")).alias("isupper"), (n.rlike("[a-z]") & ~n.rlike("[A-Z]")).alias("islower"), n.rlike("^[A-Za-z0-9]+$").alias("isalnum"),
        F.array_join(F.transform(F.split(n, " "), capitalised), " ").alias("title"), F.concat(F.repeat(F.lit(" "), F.floor(pad / 2).cast("int")), n, F.repeat(F.lit(" "), (pad - F.floor(pad / 2)).cast("int"))).alias("centred"), F.url_encode(n).alias("quoted"),
    )


QUERIES = {f.__name__: f for f in (sc12_words, sc16_fonts, ag11_formats, sx10_boundaries, sx14_sections, sx15_spans, sx17_thirds, sx18_parts, sx29_counts, sx19_tiers, sc22_simulated, se6_union, cp21_settings, jn9_classified, jn2_scores, so5_rules, ex8_examples, cp27_left, rp14_live, pj19_markdown, cp2_analysed, cp14_tailored, st_functions)}


def _oracles() -> dict[str, str]:
    from scriptorium.operators.repair import ATS
    from scriptorium.operators.sections import ORACLE_SQL as SECTIONS

    four = "CASE " + " ".join(f"WHEN regexp_matches(t, '^({p})$') THEN '{k}'" for k, p in FOUR.items()) + " END"
    line = r"L AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS i, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM {}))"
    count = r"len(list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))"
    parsed = f"q AS ({SECTIONS['sx27_sections']})"
    lower = {k: v for k, v in chains.CORRECTIONS.items() if k == k.lower()}
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lower.items()) + "}"
    cased = f"CASE WHEN {table}[lower(t)] IS NULL THEN t WHEN t = upper(t) AND length(t) > 1 THEN upper({table}[lower(t)]) WHEN left(t, 1) = upper(left(t, 1)) THEN concat(upper(left({table}[lower(t)], 1)), lower(substring({table}[lower(t)], 2))) ELSE {table}[lower(t)] END"
    # the final chain on what the chain for pages gives
    final = chains.ORACLE_SQL["rp3_final"].replace(DAMAGED_SQL, f"damaged AS (SELECT doc_id, repaired AS text FROM ({chains.ORACLE_SQL['rp2_page_text']}))")
    return {
        "sc12_words": "SELECT l_orderkey, l_linenumber AS line, concat('w', l_partkey) AS word, CAST(l_quantity AS INTEGER) AS conf FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_linenumber % 3 <> 0",
        "sc16_fonts": "SELECT l_orderkey, l_returnflag, max(l_quantity) AS size, bool_or(l_linestatus = 'F') AS bold FROM lineitem GROUP BY ALL",
        "ag11_formats": "SELECT l_orderkey, count(*) AS blocks, CASE WHEN count(*) > 5 THEN 'complex' WHEN count(DISTINCT l_returnflag) > 1 THEN 'columns' ELSE 'simple' END AS class FROM lineitem GROUP BY l_orderkey",
        "sx10_boundaries": f"WITH q AS ({structure.ORACLE_SQL['sx9_scores']}), p AS (SELECT doc_id, list([i] ORDER BY i) AS p FROM q WHERE peak OR i = 0 GROUP BY doc_id) SELECT doc_id, array_to_string(list_reduce(p, lambda a, b: CASE WHEN b[1] - a[-1] >= 3 THEN list_concat(a, b) ELSE a END), ',') AS boundaries FROM p",
        "sx14_sections": rf"""WITH {RESUMES_SQL}, {line.format('resumes')}, k AS (SELECT *, {four} AS kind FROM (SELECT *, lower(regexp_replace(line, '[ :]+$', '')) AS t FROM L)), s AS (SELECT *, CAST(count(kind) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS seq FROM k)
SELECT doc_id, seq, max(kind) AS type, max(CASE WHEN kind IS NOT NULL THEN line END) AS title, coalesce(string_agg(CASE WHEN kind IS NULL AND line <> '' THEN line END, E'\n' ORDER BY i), '') AS content FROM s WHERE seq > 0 GROUP BY doc_id, seq""",
        "sx15_spans": """WITH p AS (SELECT p_partkey, concat(CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END, CASE WHEN p_size % 7 = 0 THEN ':' ELSE '' END, CASE WHEN p_size % 6 = 0 THEN ' Skills' ELSE '' END) AS t, p_size / 3.0 AS z, p_size % 2 = 0 AS b FROM part),
s AS (SELECT *, CAST(CASE WHEN z > 12 THEN 3 WHEN z > 10 THEN 1 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN NOT regexp_matches(t, '[a-z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, ':$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'skills|education|experience') THEN 3 ELSE 0 END AS INTEGER) AS score FROM p)
SELECT p_partkey, score, score >= 4 AS header, z > 11 AND (b OR NOT regexp_matches(t, '[a-z]')) OR z >= 14 AS formatted FROM s""",
        "sx17_thirds": f"WITH {DAMAGED_SQL}, {line.format('damaged')}, r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r FROM L WHERE line <> '') SELECT doc_id, ['contact', 'experience', 'skills'][r * 3 // n + 1] AS type, count(*) AS lines, min(i) AS first FROM r GROUP BY doc_id, type",
        "sx18_parts": rf"""WITH {parsed}, e AS (SELECT doc_id, seq, type, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS i FROM (SELECT *, string_split(content, E'\n') AS l FROM q WHERE {count.format('content')} > {MOST_WORDS})),
o AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'university|college|degree|school') THEN 'education' WHEN regexp_matches(lower(line), '(19|20)[0-9]{{2}} *[-–] *((19|20)[0-9]{{2}}|present)|manager|engineer') THEN 'experience' WHEN regexp_matches(lower(line), 'python|sql|java|software') THEN 'skills' END AS own FROM e),
c AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, seq ORDER BY i ROWS UNBOUNDED PRECEDING), type) AS kind FROM o) SELECT doc_id, seq, kind, count(*) AS lines, min(i) AS first FROM c GROUP BY ALL""",
        "sx19_tiers": f"""WITH {DAMAGED_SQL}, {line.format('damaged')}, t AS (SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(lower(regexp_replace(line, '[ :]+$', '')), '^({'|'.join(FOUR.values())})$') THEN 1 ELSE 0 END) AS BIGINT) AS typed FROM L GROUP BY doc_id),
k AS (SELECT doc_id, CAST(sum(CASE WHEN peak THEN 1 ELSE 0 END) AS BIGINT) AS peaks FROM ({structure.ORACLE_SQL['sx9_scores']}) GROUP BY doc_id)
SELECT doc_id, CASE WHEN typed > 1 THEN 'pattern' WHEN peaks > 1 THEN 'format' ELSE 'default' END AS tier, CASE WHEN typed > 1 THEN typed WHEN peaks > 1 THEN peaks ELSE 3 END AS n FROM t JOIN k USING (doc_id)""",
        "sc22_simulated": "SELECT n_nationkey, pos, concat(CASE pos WHEN 0 THEN 'Senior ' ELSE '' END, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: concat(upper(left(x, 1)), substring(x, 2))), ' '), CASE pos WHEN 0 THEN ' Clerk' ELSE ' Writer' END) AS title, CASE pos WHEN 0 THEN 'on site' ELSE 'remote' END AS location FROM nation, (VALUES (0), (1)) v(pos)",
        "se6_union": "WITH u AS (SELECT c_nationkey AS place, 'a' AS source FROM customer UNION ALL SELECT s_nationkey, 'b' FROM supplier) SELECT place, count(*) AS n, count(DISTINCT source) AS sources FROM u GROUP BY place",
        "cp21_settings": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 10) AS k, 'light' AS theme FROM events",
        "sx29_counts": f"WITH {parsed}, c AS (SELECT doc_id, seq, type, CAST({count.format('content')} AS INTEGER) AS words FROM q) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, seq) AS INTEGER) AS rank FROM c",
        "jn9_classified": f"WITH {parsed}, k AS ({structure.ORACLE_SQL['sx20_classified']}) SELECT doc_id, seq, q.type AS by_title, k.type, k.confidence FROM q JOIN k USING (doc_id, seq)",
        "jn2_scores": f"""WITH one AS (SELECT text AS answer FROM (WITH {RESUMES_SQL} SELECT * FROM resumes) ORDER BY doc_id LIMIT 1), {POSTINGS_SQL}, {advice._KEYS}, b AS (SELECT item_id, keywords, {advice._PLAIN.format('answer')} AS plain FROM q, one),
m AS (SELECT item_id, len(keywords) AS n, len(list_filter(keywords, lambda x: contains(plain, concat(' ', trim(regexp_replace(lower(x), '[^a-z0-9_]+', ' ', 'g')), ' ')))) AS p FROM b)
SELECT item_id, CAST(p AS INTEGER) AS present, CAST(n - p AS INTEGER) AS missing, CAST(CASE WHEN n = 0 THEN 0 ELSE round_even(100.0 * p / n, 0) END AS INTEGER) AS score FROM m""",
        "so5_rules": f"SELECT * FROM ({chains.ORACLE_SQL['rp1_substitutions']}) WHERE name <> '' ORDER BY n DESC, name LIMIT 10",
        "ex8_examples": f"WITH {DAMAGED_SQL}, {line.format('damaged')}, a AS (SELECT doc_id, i, line AS before, {chains.LIBRARY.sql('line')} AS after FROM L) SELECT * FROM a WHERE before <> after",
        "cp27_left": f"WITH {DAMAGED_SQL}, a AS (SELECT text, {chains.corrected_sql('text')} AS after FROM damaged) " + " UNION ALL ".join(f"SELECT '{w}' AS word, CAST(sum(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN contains(after, '{w}') THEN 1 ELSE 0 END) AS BIGINT) AS after FROM a" for w in chains.CORRECTIONS),
        "rp14_live": rf"WITH {DAMAGED_SQL}, c AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> ''), lambda t: {cased}), ' ') AS text FROM damaged) SELECT doc_id, {chains.patterns_sql('text')} AS repaired FROM c",
        "pj19_markdown": f"WITH m AS ({advice.ORACLE_SQL['mt2_analysis']}) SELECT item_id, concat_ws(E'\\n', concat('## Score: ', score), '### Present', array_to_string(list_transform(string_split(present, ','), lambda x: concat('- ', x)), E'\\n'), '### Missing', array_to_string(list_transform(string_split(missing, ','), lambda x: concat('- ', x)), E'\\n')) AS markdown FROM m",
        "cp2_analysed": f"WITH a AS ({SECTIONS['sx21_analysis']}), k AS ({structure.ORACLE_SQL['sx20_classified']}), c AS (SELECT doc_id, string_agg(type, ',' ORDER BY seq) AS classes FROM k GROUP BY doc_id) SELECT * FROM a JOIN c USING (doc_id)",
        "cp14_tailored": f"SELECT doc_id, md5(trim({ATS.sql('repaired')}, ' ')) AS md5 FROM ({final})",
        "st_functions": """SELECT p_partkey, regexp_matches(p_name, '[A-Z]') AND NOT regexp_matches(p_name, '[a-z]') AS isupper, regexp_matches(p_name, '[a-z]') AND NOT regexp_matches(p_name, '[A-Z]') AS islower, regexp_matches(p_name, '^[A-Za-z0-9]+$') AS isalnum,
 array_to_string(list_transform(string_split(p_name, ' '), lambda x: concat(upper(left(x, 1)), lower(substring(x, 2)))), ' ') AS title, concat(repeat(' ', greatest(70 - length(p_name), 0) // 2), p_name, repeat(' ', greatest(70 - length(p_name), 0) - greatest(70 - length(p_name), 0) // 2)) AS centred, replace(url_encode(p_name), '%20', '+') AS quoted FROM part""",
    }


ORACLE_SQL = _oracles()
