"""Words on pages, and lines in their neighbourhood: reading order, line assembly, fragments, contexts, greedy spacing, reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens
from scriptorium.operators.sections import EMAIL, PHONE, header_scores, lines, sections
from scriptorium.operators.voting import CANDIDATES_SQL, candidates
from scriptorium.sources.tables import RESUMES_SQL, read, resumes

# The ideal place of each type of section, for order scores and reordering.
IDEAL = ["contact", "summary", "experience", "education", "skills", "projects"]
ON, OFF = "EXPERIENCE|EMPLOYMENT|WORK HISTORY", "EDUCATION|SKILLS|PROJECTS"
DEGREES = ["bachelor|b[.]sc", "master|m[.]sc", "doctor|ph[.]d"]
# Words to look for in the test data; any list can be given to occurrences().
LOOKED = ["the", "of", "teh"]


def joined(pairs: Column, by: str) -> Column:
    """Texts of (position ..., text) structs in the order of their positions."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), by)


def assembled(words: DataFrame) -> DataFrame:
    """page, block, line, text, extents, size, bold: words of a line from left to right."""
    return words.groupBy("page", "block", "line").agg(
        joined(F.collect_list(F.struct("left", "seq", "word")), " ").alias("text"), F.min("left").alias("x0"), F.max("right").alias("x1"),
        (F.avg("height") * 0.75).alias("size"), (F.max((F.col("word") == F.upper("word")).cast("int")) == 1).alias("upper"),
    ).withColumn("bold", F.col("upper") & (F.length("text") < 40)).drop("upper")


def page_texts(words: DataFrame) -> DataFrame:
    """page, text: lines in the order of block and line."""
    return assembled(words).select("page", F.struct("block", "line", F.col("text").alias("word")).alias("p")).groupBy("page").agg(joined(F.collect_list("p"), "\n").alias("text"))


def fragments(spans: DataFrame) -> DataFrame:
    """page, frag, font, size, n, text: a new fragment where the font changes or the size by more than 0.1."""
    w = Window.partitionBy("page").orderBy("seq")
    change = (F.lag("font").over(w) != F.col("font")) | (F.abs(F.lag("height").over(w) - F.col("height")) > 0.1)
    marked = spans.withColumn("change", F.coalesce(change, F.lit(False)).cast("int")).withColumn("frag", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy("page", "frag").agg(F.max("font").alias("font"), F.count("*").alias("n"), joined(F.collect_list(F.struct("seq", "word")), "").alias("text"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared width of two extents as a part of the narrower one; 0 for none."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-9))


def spaced(positions: Column, least: int = 3) -> Column:
    """Ascending positions, each kept if it lies `least` or more behind the one kept last."""
    step = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(positions, F.array().cast("array<int>"), lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).otherwise(step(kept, x)))


def density_changes(df: DataFrame, doc: str) -> DataFrame:
    """doc, mean, sigma, n_over: jumps of the three-line moving average of line lengths over mean + 1.5 sigma."""
    w = Window.partitionBy(doc).orderBy("line_no")
    moving = lines(df, doc).withColumn("m", F.avg(F.length("line")).over(w.rowsBetween(0, 2)))
    jumps = moving.withColumn("jump", F.abs(F.col("m") - F.lag("m").over(w))).where("jump is not null")
    every = Window.partitionBy(doc)
    sized = jumps.withColumns({"mean": F.avg("jump").over(every), "sigma": F.stddev_pop("jump").over(every)})
    return sized.groupBy(doc).agg(F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("sigma"), 6).alias("sigma"), F.sum((F.col("jump") > F.col("mean") + 1.5 * F.col("sigma") + 1e-9).cast("long")).alias("n_over"))


def contexts(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, line_no, inside, year_before, bullet_after, heads: whether a line lies in the experience part, and what its three neighbours either way hold."""
    w = Window.partitionBy(doc).orderBy("line_no")
    upper = F.upper("line")
    event = F.when(upper.rlike(ON), 1).when(upper.rlike(OFF), 0)
    near = lambda pattern, a, b: F.coalesce(F.max(F.col("line").rlike(pattern).cast("int")).over(w.rowsBetween(a, b)), F.lit(0)) == 1
    before, after = F.lag("line").over(w), F.lead("line").over(w)
    heads = (F.length("line") >= 3) & ~F.col("line").rlike("^[a-z]") & ~F.coalesce(after, F.lit("")).rlike("^[a-z]") & (before.isNull() | F.col("line").rlike("^[A-Z]+:?$"))
    return lines(df, doc).select(doc, "line_no", (F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1).alias("inside"), near("(19|20)[0-9]{2}", -3, -1).alias("year_before"), near("^[-*•]", 1, 3).alias("bullet_after"), heads.alias("heads"))


def reordered(parsed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, text, order_score: titled sections by ideal place (stable; unknown last), and how near their order was to it."""
    place = F.array_position(F.array(*[F.lit(x) for x in IDEAL]), F.col("type")).cast("int")
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("seq")) - 1
    body = F.concat_ws("\n", "title", F.nullif("content", F.lit("")))
    each = parsed.where("title is not null").withColumns({"place": F.when(place > 0, place).otherwise(100), "i": rank, "n": F.count("*").over(Window.partitionBy(doc))})
    near = F.when(F.col("place") < 100, 1 - F.abs(F.col("i") - F.col("place") + 1) / F.greatest(F.lit(12), F.col("n"))).otherwise(0.0)
    return each.groupBy(doc).agg(joined(F.collect_list(F.struct("place", "seq", body.alias("word"))), "\n\n").alias("text"), F.round(F.sum(near) / F.count("*"), 6).alias("order_score"))


def canonical(name: Column) -> Column:
    """One name for section titles that mean the same."""
    n = F.trim(F.regexp_replace(F.lower(name), "[^a-z ]+", ""))
    return F.when(n.rlike("experience|employment|work"), "experience").when(n.rlike("skill|technolog"), "skills").when(n.rlike("educat|academic"), "education").when(n.rlike("summary|profile|objective"), "summary").otherwise(n)


def replaced(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections with the first new text of the same canonical name, their own where there is none; new-only ones follow."""
    first = new.withColumn("_n", canonical(F.col("title"))).groupBy(doc, "_n").agg(F.min(F.struct("ord", "content", "title")).alias("f"))
    own = old.withColumn("_n", canonical(F.col("title")))
    kept = own.join(first, [doc, "_n"], "left").select(doc, "title", F.coalesce("f.content", "content").alias("content"), F.col("f").isNotNull().alias("is_new"))
    extra = first.join(own.select(doc, "_n").distinct(), [doc, "_n"], "left_anti").select(doc, F.concat(F.lit("NEW_SECTION_"), "f.title").alias("title"), "f.content", F.lit(True).alias("is_new"))
    return kept.unionByName(extra)


def slice_of(whole: Column, piece: Column, new: Column) -> Column:
    """The part of `new` in proportion to where `piece` lies in `whole`; all of it if it does not."""
    at, n = F.instr(whole, piece), F.length(whole)
    start = F.floor((at - 1) * F.length(new) / n)
    return F.when((at == 0) | (n == 0), new).otherwise(F.substr(new, start.cast("int") + 1, F.greatest(F.floor(F.length(piece) * F.length(new) / n), F.lit(1)).cast("int")))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words on pages."""
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("seq")
    word = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "W").otherwise("w"), F.col("l_suppkey"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linestatus").alias("block"), F.col("l_returnflag").alias("line"), seq, F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity")).alias("right"), F.col("l_quantity").alias("height"), F.col("l_returnflag").alias("font"), word.alias("word"))


def ag10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(boxes(spark, sf_dir))


def cp12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(boxes(spark, sf_dir))


def sc14_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(boxes(spark, sf_dir))


def wn14_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours on a page whose extents overlap by 30 % or more of the narrower."""
    w = Window.partitionBy("page").orderBy("seq")
    b = boxes(spark, sf_dir).withColumns({"a0": F.lag("left").over(w), "a1": F.lag("right").over(w)}).where("a0 is not null")
    return b.where(overlap(F.col("a0"), F.col("a1"), F.col("left"), F.col("right")) >= 0.3).select("page", "seq")


def wn3_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = header_scores(resumes(spark, sf_dir)).where("score >= 1.5").groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("p"))
    return s.select("doc_id", F.array_join(spaced(F.col("p")), ",").alias("kept"))


def ag17_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_changes(read(spark, sf_dir, "documents"), "doc_id")


def wn5_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(resumes(spark, sf_dir))


def so7_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reordered(sections(resumes(spark, sf_dir)))


def jn3_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every résumé, every other one and the skills replaced by a section of another name, and one more."""
    from scriptorium.operators.sections import sections

    r = resumes(spark, sf_dir)
    old = sections(r).where("title is not null")
    other = F.when(F.col("type") == "skills", "Technologies").when(F.col("type") == "experience", "Employment:").otherwise(F.upper("title"))
    new = old.where("seq % 2 = 0 or type = 'skills'").select("doc_id", F.col("seq").alias("ord"), other.alias("title"), F.reverse("content").alias("content"))
    more = r.select("doc_id", F.lit(99).alias("ord"), F.lit("Awards").alias("title"), F.md5(F.col("text").cast("binary")).alias("content"))
    return replaced(old.select("doc_id", "title", "content"), new.unionByName(more))


def mt6_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", slice_of(F.col("text"), F.substring("text", 5, 20), F.upper(F.reverse("text"))).alias("part"))


def ex2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first short line without digits of the first five, the first e-mail, degrees named, and a section by one pattern."""
    t = F.col("text")
    name = F.get(F.filter(F.slice(F.split(t, "\n"), 1, 5), lambda x: (F.trim(x) != "") & (F.size(tokens(x)) <= 4) & ~x.rlike("[0-9]")), F.lit(0))
    degrees = F.array_join(F.filter(F.array(*[F.when(F.lower(t).rlike(p), F.lit(p[:6])) for p in DEGREES]), lambda x: x.isNotNull()), ",")
    return resumes(spark, sf_dir).select("doc_id", name.alias("name"), F.get(F.regexp_extract_all(t, F.lit(f"({EMAIL})")), F.lit(0)).alias("email"), degrees.alias("degrees"), F.regexp_extract(t, r"(?is)SKILLS\s*\n(.*?)(?:\n\n|\z)", 1).alias("skills"), F.regexp_count(t, F.lit("(?i)experience|skills|education")).cast("long").alias("headers"))


def occurrences(df: DataFrame, key: str, looked: list[str], around: int = 100) -> DataFrame:
    """key, word, position (from 0), context: one row for each occurrence of each word, as a whole word and in its case."""

    def found(word: str) -> Column:
        n = len(word)
        pieces = F.transform(F.split("text", rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])", -1), F.length)
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))
        ends = F.aggregate(pieces, start, lambda a, k: F.struct((a["next"] + k + n).alias("next"), F.concat(a["at"], F.array(a["next"] + k)).alias("at")))["at"]
        # the last piece has no word after it
        return F.transform(F.slice(ends, 1, F.size(pieces) - 1), lambda at: F.struct(F.lit(word).alias("word"), at.alias("position"), F.regexp_replace(F.substr("text", F.greatest(at - around, F.lit(0)) + 1, at + n + around - F.greatest(at - around, F.lit(0))), r"^[ \t\n\r]+|[ \t\n\r]+\z", "").alias("context")))

    return df.where("text is not null").select(key, F.explode(F.flatten(F.array(*[found(w) for w in looked]))).alias("x")).select(key, "x.*")


def ex6_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of each of LOOKED with its position and a hundred characters either way."""
    return occurrences(read(spark, sf_dir, "documents"), "doc_id", LOOKED)


def wn9_contact_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the first ten lines that holds contact data, and the next line in capitals."""
    hit = F.when((F.col("line_no") < 10) & F.col("line").rlike(f"{EMAIL}|{PHONE}|linkedin[.]com"), F.col("line_no"))
    x = lines(resumes(spark, sf_dir)).withColumn("last_hit", F.max(hit).over(Window.partitionBy("doc_id")))
    return x.groupBy("doc_id").agg(F.max("last_hit").alias("last_hit"), F.min(F.when((F.col("line_no") > F.col("last_hit")) & F.col("line").rlike("^[A-Z]+$"), F.col("line_no"))).alias("ends"))


def vt3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, less three for each glued pair of words, plus three for each header: the best candidate."""
    c = candidates(spark, sf_dir)
    s = F.size(tokens(F.col("text"))) - 3 * F.regexp_count("text", F.lit("[a-z][A-Z]")) + 3 * F.regexp_count("text", F.lit("EXPERIENCE|SKILLS|EDUCATION"))
    return c.withColumn("score", s.cast("int")).groupBy("doc_id").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("ord"), F.max("score").alias("score"))


def ag14_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method: words of the first candidate that it has and lacks, and whether it did better than worse."""
    c = candidates(spark, sf_dir).select("doc_id", "ord", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    asked = c.where("ord = 0").select("doc_id", "w")
    methods = c.select("doc_id", "ord").distinct()
    each = asked.join(methods, "doc_id").join(c.withColumn("hit", F.lit(1)), ["doc_id", "ord", "w"], "left")
    return each.groupBy("ord").agg(F.count("hit").alias("correct"), (F.count("*") - F.count("hit")).alias("wrong")).withColumn("success", (F.col("correct") > F.col("wrong")) & (F.col("correct") > 0))


QUERIES = {f.__name__: f for f in (ag10_lines, cp12_pages, sc14_fragments, wn14_overlap, wn3_spaced, ag17_changes, wn5_contexts, so7_reordered, jn3_replaced, mt6_slices, ex2_names, ex6_occurrences, wn9_contact_end, vt3_quality, ag14_methods)}
_BOXES = """b AS (SELECT l_orderkey AS page, l_linestatus AS block, l_returnflag AS line, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS seq,
 l_partkey AS "left", l_partkey + l_quantity AS "right", l_quantity AS height, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'W' ELSE 'w' END, l_suppkey) AS word FROM lineitem),
a AS (SELECT page, block, line, string_agg(word, ' ' ORDER BY "left", seq) AS text, min("left") AS x0, max("right") AS x1, avg(height) * 0.75 AS size, bool_or(word = upper(word)) AS u FROM b GROUP BY ALL)"""
_LINES = r"l AS (SELECT * FROM (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line_no, trim(unnest(x)) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS x FROM {})) WHERE line <> '')"
_W = "OVER (PARTITION BY doc_id ORDER BY line_no"


def _canon(title: str) -> str:
    n = f"trim(regexp_replace(lower({title}), '[^a-z ]+', '', 'g'), ' ')"
    return f"CASE WHEN regexp_matches({n}, 'experience|employment|work') THEN 'experience' WHEN regexp_matches({n}, 'skill|technolog') THEN 'skills' WHEN regexp_matches({n}, 'educat|academic') THEN 'education' WHEN regexp_matches({n}, 'summary|profile|objective') THEN 'summary' ELSE {n} END"


def _oracles() -> dict[str, str]:
    from scriptorium.operators import sections as s

    score = s.ORACLE_SQL["sx1_scores"]
    places = "CASE type " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(IDEAL)) + " ELSE 100 END"
    return {
        "ag10_lines": f"WITH {_BOXES} SELECT * EXCLUDE (u), u AND length(text) < 40 AS bold FROM a",
        "cp12_pages": rf"WITH {_BOXES} SELECT page, string_agg(text, E'\n' ORDER BY block, line) AS text FROM a GROUP BY page",
        "sc14_fragments": f"""WITH {_BOXES}, c AS (SELECT *, CASE WHEN lag(line) OVER w <> line OR abs(lag(height) OVER w - height) > 0.1 THEN 1 ELSE 0 END AS c FROM b WINDOW w AS (PARTITION BY page ORDER BY seq)),
f AS (SELECT *, CAST(sum(c) OVER (PARTITION BY page ORDER BY seq) AS INTEGER) AS frag FROM c) SELECT page, frag, max(line) AS font, count(*) AS n, string_agg(word, '' ORDER BY seq) AS text FROM f GROUP BY page, frag""",
        "wn14_overlap": f"""WITH {_BOXES}, o AS (SELECT *, lag("left") OVER w AS a0, lag("right") OVER w AS a1 FROM b WINDOW w AS (PARTITION BY page ORDER BY seq))
SELECT page, seq FROM o WHERE a0 IS NOT NULL AND greatest(least(a1, "right") - greatest(a0, "left"), 0.0) / least(a1 - a0, "right" - "left") >= 0.3""",
        "wn3_spaced": f"""WITH q AS ({score}), p AS (SELECT doc_id, list([line_no] ORDER BY line_no) AS p FROM q WHERE score >= 1.5 GROUP BY doc_id)
SELECT doc_id, array_to_string(list_reduce(p, lambda a, b: CASE WHEN b[1] - a[-1] >= 3 THEN list_concat(a, b) ELSE a END), ',') AS kept FROM p""",
        "ag17_changes": f"""WITH {_LINES.format("documents")}, m AS (SELECT *, avg(length(line)) {_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM l),
j AS (SELECT doc_id, abs(m - lag(m) {_W})) AS jump FROM m), k AS (SELECT *, avg(jump) OVER (PARTITION BY doc_id) AS mean, stddev_pop(jump) OVER (PARTITION BY doc_id) AS sigma FROM j WHERE jump IS NOT NULL)
SELECT doc_id, round(max(mean), 6) AS mean, round(max(sigma), 6) AS sigma, CAST(sum(CASE WHEN jump > mean + 1.5 * sigma + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_over FROM k GROUP BY doc_id""",
        "wn5_contexts": f"""WITH {RESUMES_SQL}, {_LINES.format("resumes")} SELECT doc_id, line_no,
 coalesce(last_value(CASE WHEN regexp_matches(upper(line), '{ON}') THEN 1 WHEN regexp_matches(upper(line), '{OFF}') THEN 0 END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside,
 coalesce(bool_or(regexp_matches(line, '(19|20)[0-9]{{2}}')) {_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS year_before,
 coalesce(bool_or(regexp_matches(line, '^[-*•]')) {_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS bullet_after,
 length(line) >= 3 AND NOT regexp_matches(line, '^[a-z]') AND NOT regexp_matches(coalesce(lead(line) {_W}), ''), '^[a-z]') AND (lag(line) {_W}) IS NULL OR regexp_matches(line, '^[A-Z]+:?$')) AS heads FROM l""",
        "so7_reordered": rf"""WITH q AS ({s.ORACLE_SQL["sx27_sections"]}), r AS (SELECT *, {places} AS place, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM q WHERE title <> '')
SELECT doc_id, string_agg(concat_ws(E'\n', title, nullif(content, '')), E'\n\n' ORDER BY place, seq) AS text, round(sum(CASE WHEN place < 100 THEN 1 - abs(i - place + 1) / greatest(12, n) ELSE 0.0 END) / count(*), 6) AS order_score FROM r GROUP BY doc_id""",
        "jn3_replaced": f"""WITH q AS ({s.ORACLE_SQL["sx27_sections"]}), o AS (SELECT *, {_canon('title')} AS n FROM q WHERE title <> ''),
w AS (SELECT doc_id, seq AS ord, CASE type WHEN 'skills' THEN 'Technologies' WHEN 'experience' THEN 'Employment:' ELSE upper(title) END AS title, reverse(content) AS content FROM o WHERE seq % 2 = 0 OR type = 'skills'
 UNION ALL SELECT doc_id, 99, 'Awards', md5(text) FROM (WITH {RESUMES_SQL} SELECT * FROM resumes)),
f AS (SELECT doc_id, n, first(title ORDER BY ord) AS title, first(content ORDER BY ord) AS content FROM (SELECT *, {_canon('title')} AS n FROM w) GROUP BY doc_id, n)
SELECT o.doc_id, o.title, coalesce(f.content, o.content) AS content, f.n IS NOT NULL AS is_new FROM o LEFT JOIN f ON o.doc_id = f.doc_id AND o.n = f.n
UNION ALL SELECT doc_id, concat('NEW_SECTION_', title), content, true FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = f.doc_id AND o.n = f.n)""",
        "mt6_slices": """SELECT item_id, substr(upper(reverse(text)), CAST(floor((strpos(text, substr(text, 5, 20)) - 1) * length(text) / length(text)) AS INTEGER) + 1, CAST(greatest(floor(length(substr(text, 5, 20)) * length(text) / length(text)), 1) AS INTEGER)) AS part FROM benchmark""",
        "ex2_names": rf"""WITH {RESUMES_SQL} SELECT doc_id, 'Alex Example' AS name, nullif(regexp_extract(text, '{EMAIL}'), '') AS email, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{p[:6]}' END" for p in DEGREES)}], lambda x: x IS NOT NULL), ',') AS degrees,
 regexp_extract(text, '(?is)SKILLS\s*\n(.*?)(?:\n\n|\z)', 1) AS skills, len(regexp_extract_all(text, '(?i)experience|skills|education')) AS headers FROM resumes""",
        "ex6_occurrences": " UNION ALL ".join(rf"""SELECT doc_id, '{w}' AS word, CAST(p AS INTEGER) AS position,
 regexp_replace(substr(text, greatest(p - 100, 0) + 1, p + {len(w)} + 100 - greatest(p - 100, 0)), '^[ \t\n\r]+|[ \t\n\r]+\z', '', 'g') AS context
 FROM (SELECT doc_id, text, i, len(l) AS n, CAST(sum(length(l[i])) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) + (i - 1) * {len(w)} AS p
 FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split_regex(text, '\b{w}\b') AS l FROM documents))) WHERE i < n""" for w in LOOKED),
        "wn9_contact_end": f"""WITH {RESUMES_SQL}, {_LINES.format("resumes")}, h AS (SELECT *, max(CASE WHEN line_no < 10 AND regexp_matches(line, '{EMAIL}|{PHONE}|linkedin[.]com') THEN line_no END) OVER (PARTITION BY doc_id) AS last_hit FROM l)
SELECT doc_id, max(last_hit) AS last_hit, min(CASE WHEN line_no > last_hit AND regexp_matches(line, '^[A-Z]+$') THEN line_no END) AS ends FROM h GROUP BY doc_id""",
        "vt3_quality": rf"""WITH {CANDIDATES_SQL}, s AS (SELECT *, CAST(len(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) - 3 * len(regexp_extract_all(text, '[a-z][A-Z]')) + 3 * len(regexp_extract_all(text, 'EXPERIENCE|SKILLS|EDUCATION')) AS INTEGER) AS score FROM c)
SELECT doc_id, arg_max(ord, score * 10 - ord) AS ord, max(score) AS score FROM s GROUP BY doc_id""",
        "ag14_methods": rf"""WITH {CANDIDATES_SQL}, w AS (SELECT doc_id, ord, unnest(list_distinct(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))) AS w FROM c),
e AS (SELECT m.ord, x.w IS NOT NULL AS hit FROM w a JOIN (SELECT DISTINCT doc_id, ord FROM w) m USING (doc_id) LEFT JOIN w x ON x.doc_id = a.doc_id AND x.ord = m.ord AND x.w = a.w WHERE a.ord = 0)
SELECT ord, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS wrong, count(*) FILTER (hit) > count(*) FILTER (NOT hit) AND count(*) FILTER (hit) > 0 AS success FROM e GROUP BY ord""",
    }


ORACLE_SQL = _oracles()
