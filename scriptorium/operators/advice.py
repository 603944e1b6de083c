"""Keywords of job postings, skills, and advice for a text that answers a posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import score, tokens
from scriptorium.sources.tables import POSTINGS_SQL, RESUMES_SQL, postings, resumes

# Skills that are looked for, in order.
SKILLS = [
    "Python", "Java", "JavaScript", "TypeScript", "React", "Vue", "Angular", "Node.js", "Express", "Django", "Flask", "Spring", "SQL", "NoSQL", "MongoDB", "PostgreSQL", "MySQL", "Oracle", "AWS", "Azure", "GCP",
    "Docker", "Kubernetes", "CI/CD", "DevOps", "Agile", "Scrum", "Machine Learning", "AI", "Data Science", "Big Data", "Hadoop", "Spark", "ETL", "Data Warehouse", "Business Intelligence", "Power BI", "Tableau",
    "Product Management", "Project Management", "Leadership", "Team Management", "Strategic Planning", "Marketing", "SEO", "SEM", "Content Marketing", "Social Media", "Digital Marketing", "Sales",
    "Customer Success", "Customer Service", "Technical Support", "UX", "UI", "User Research", "Wireframing", "Prototyping", "Figma", "Sketch", "Adobe XD", "Photoshop", "Illustrator", "InDesign", "After Effects",
    "Video Editing", "Animation", "3D Modeling", "Game Development", "Unity", "Unreal Engine", "C++", "C#", "Swift", "Objective-C", "Kotlin", "Go", "Rust", "PHP", "Ruby", "Rails", "Perl", "Scala", "Haskell",
    "Clojure", "Linux", "Unix", "Bash", "Shell Scripting", "Networking", "Security", "Cybersecurity", "Penetration Testing", "Ethical Hacking", "Cryptography", "Blockchain", "Smart Contracts",
    "Cryptocurrency", "Solidity", "AR", "VR", "IoT", "Embedded Systems", "Robotics", "Automation", "Communication", "Presentation", "Public Speaking", "Writing", "Technical Writing", "Documentation",
    "Research", "Analysis", "Problem Solving", "Critical Thinking", "Creativity", "Innovation",
]
# Skills by category; words that are no keywords; degrees.
CATEGORIES = {
    "languages": ["Python", "Java", "C++", "JavaScript", "TypeScript", "C#", "Ruby", "PHP", "Swift", "Kotlin", "Go", "Rust"],
    "frameworks": ["React", "Angular", "Vue", "Django", "Flask", "Spring", "Express", "TensorFlow", "PyTorch", "Pandas", "NumPy", "scikit-learn"],
    "tools": ["Docker", "Kubernetes", "AWS", "Azure", "GCP", "Git", "GitHub", "GitLab", "CI/CD", "Jenkins", "Linux", "Windows", "macOS"],
    "soft": ["leadership", "teamwork", "communication", "problem solving", "project management", "organization", "time management", "collaboration", "initiative", "adaptability", "creativity", "critical thinking"],
}
STOP_WORDS = """a an the and or but if because as what when where how who which this that these those then than such both through about for is are was were be been being have has had having do does did doing at by
with from to in out on off over under again further once here there all any each few more most other some no nor not only own same so too very can will just should now""".split()  # fmt: skip
DEGREES = ["bachelor(?:'s)? +degree", "master(?:'s)? +degree", "phd", "doctorate", "mba"]
YEARS = "([0-9]+)[+]? *(?:years|yrs)(?: +of)? +experience"
TOKEN = "(^|[^a-z0-9_])([a-z][a-z0-9#-.+]*[a-z0-9])"  # the range from # to . is meant


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() or c in " -/" else f"[{c}]" for c in s)


def mentions(text: Column, name: str) -> Column:
    """array<string>: every mention of a name as a word of its own, in any case, as it is written."""
    hits = F.regexp_extract_all(text, F.lit(f"(?i)(?:^|[^A-Za-z0-9_])({_literal(name)})(?:[^A-Za-z0-9_]|\\z)"), 1)
    # most names are in few texts: a plain search first
    return F.when(F.lower(text).contains(name.lower()), hits).otherwise(F.array().cast("array<string>"))


def skills(text: Column, names: list[str] = SKILLS) -> Column:
    """Distinct mentions of any skill as they are written, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[mentions(text, n) for n in names]))))


def frequent(df: DataFrame, key: str, text: str = "text", top: int = 20) -> DataFrame:
    """key, word, n, rank: the `top` most frequent words (a letter, then letters, digits and # to . inside), first position first on ties."""
    each = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 2)).alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS))
    counts = each.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "word", "n", "rank")


def job_keywords(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, keywords: skills as written, then frequent words that occur more than once and are no skill yet, by rank."""
    often = frequent(df, key, text).where("n > 1").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("often"))
    named = df.select(key, skills(F.col(text)).alias("skills")).join(often, key, "left")
    known = F.transform("skills", F.lower)
    rest = F.filter(F.coalesce("often", F.array().cast("array<string>")), lambda w: ~F.array_contains(F.col("known"), w))
    return named.withColumn("known", known).select(key, F.concat("skills", rest).alias("keywords"))


def analysed(df: DataFrame, keywords: Column, job: Column, answer: Column) -> DataFrame:
    """df with present, missing (of the keywords in the answer), score, and advice: lines of text."""
    # a keyword is present where its words follow each other, whatever signs are between them
    clean = lambda s: F.concat(F.lit(" "), F.regexp_replace(F.lower(s), "[^a-z0-9_]+", " "), F.lit(" "))
    has = lambda k: F.col("_plain").contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(k), "[^a-z0-9_]+", " ")), F.lit(" ")))
    df = df.withColumns({"_plain": clean(answer), "_keys": keywords, "_job": job, "_answer": answer})
    df = df.withColumns({"present": F.filter("_keys", has), "missing": F.filter("_keys", lambda k: ~has(k))})
    n, years, size = F.size("missing"), F.nullif(F.regexp_extract("_job", "(?i)" + YEARS, 1), F.lit("")), F.size(tokens(F.col("_answer")))
    degrees = [F.when(F.col("_job").rlike("(?i)" + d) & ~F.col("_answer").rlike("(?i)" + d), F.concat(F.lit("degree asked: "), F.lower(F.regexp_extract("_job", "(?i)" + d, 0)))) for d in DEGREES]
    lines = F.array(
        F.when(n > 0, F.concat(F.lit("add keywords: "), F.array_join(F.slice("missing", 1, 5), ", "))), F.when(n > 5, F.concat((n - 5).cast("string"), F.lit(" more keywords"))),
        F.concat(F.lit("years asked: "), years), *degrees, F.when(size < 300, F.lit("brief")).when(size > 700, F.lit("long")),
    )
    df = df.withColumn("_lines", F.filter(lines, lambda x: x.isNotNull()))
    general = F.when(F.size("_lines") < 2, F.array(F.lit("use the posting's wording"), F.lit("give figures"))).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"score": score(F.size("present"), F.size("_keys")), "advice": F.concat("_lines", general)}).drop("_plain", "_keys", "_job", "_answer", "_lines")


def ag1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(postings(spark, sf_dir), "item_id")


def ag3_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("item_id", F.array_join(skills(F.col("text")), ",").alias("skills"))


def ag18_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills by four categories, as written; a category without any has none."""
    return postings(spark, sf_dir).select("item_id", *[F.array_join(skills(F.col("text"), names), ",").alias(k) for k, names in CATEGORIES.items()])


def mt1_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_keywords(postings(spark, sf_dir), "item_id").select("item_id", F.array_join("keywords", ",").alias("keywords"))


def mt2_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each posting against the résumé of its own number: present and missing keywords, score and advice."""
    jobs = postings(spark, sf_dir)
    both = jobs.join(job_keywords(jobs, "item_id"), "item_id").join(resumes(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")
    out = analysed(both, F.col("keywords"), F.col("text"), F.col("answer"))
    return out.select("item_id", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "score", F.array_join("advice", "; ").alias("advice"))


def fl1_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of a few names is in a résumé as a word of its own, in any case."""
    names = ["sql", "spark", "C++", "degree"]
    return resumes(spark, sf_dir).select("doc_id", *[(F.size(mentions(F.col("text"), n)) > 0).alias(f"has_{i}") for i, n in enumerate(names)])


QUERIES = {"ag1_words": ag1_words, "ag3_skills": ag3_skills, "ag18_categories": ag18_categories, "mt1_keywords": mt1_keywords, "mt2_analysis": mt2_analysis, "fl1_present": fl1_present}
_hits = lambda column, n: f"regexp_extract_all({column}, '(?i)(?:^|[^A-Za-z0-9_])({_literal(n)})(?:[^A-Za-z0-9_]|\\z)', 1)"
_skills = lambda column, names: f"list_sort(list_distinct(flatten([{', '.join(_hits(column, n) for n in names)}])))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FREQUENT = f"""w AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}', 2) AS l FROM postings)),
c AS (SELECT item_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY ALL),
k AS (SELECT item_id, word, n, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM c)"""
_KEYS = f"""{_FREQUENT}, s AS (SELECT item_id, text, {_skills('text', SKILLS)} AS skills FROM postings), f AS (SELECT item_id, list(word ORDER BY rank) AS often FROM k WHERE rank <= 20 AND n > 1 GROUP BY item_id),
q AS (SELECT item_id, text, list_concat(skills, list_filter(coalesce(often, []), lambda x: NOT list_contains(list_transform(skills, lambda y: lower(y)), x))) AS keywords FROM s LEFT JOIN f USING (item_id))"""
_PLAIN = "concat(' ', regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'), ' ')"
_DEGREES = ", ".join("CASE WHEN regexp_matches(text, '(?i){0}') AND NOT regexp_matches(answer, '(?i){0}') THEN concat('degree asked: ', lower(regexp_extract(text, '(?i){0}', 0))) END".format(d.replace("'", "''")) for d in DEGREES)
ORACLE_SQL = {
    "ag1_words": f"WITH {POSTINGS_SQL}, {_FREQUENT} SELECT * FROM k WHERE rank <= 20",
    "ag3_skills": f"WITH {POSTINGS_SQL} SELECT item_id, array_to_string({_skills('text', SKILLS)}, ',') AS skills FROM postings",
    "ag18_categories": f"WITH {POSTINGS_SQL} SELECT item_id, " + ", ".join(f"array_to_string({_skills('text', n)}, ',') AS {k}" for k, n in CATEGORIES.items()) + " FROM postings",
    "mt1_keywords": f"WITH {POSTINGS_SQL}, {_KEYS} SELECT item_id, array_to_string(keywords, ',') AS keywords FROM q",
    "mt2_analysis": rf"""WITH {POSTINGS_SQL}, {RESUMES_SQL}, {_KEYS}, b AS (SELECT item_id, q.text, keywords, r.text AS answer, {_PLAIN.format('r.text')} AS plain FROM q JOIN resumes r ON r.doc_id = item_id),
m AS (SELECT *, list_filter(keywords, lambda x: contains(plain, concat(' ', trim(regexp_replace(lower(x), '[^a-z0-9_]+', ' ', 'g')), ' '))) AS present, list_filter(keywords, lambda x: NOT contains(plain, concat(' ', trim(regexp_replace(lower(x), '[^a-z0-9_]+', ' ', 'g')), ' '))) AS missing,
 len(list_filter(string_split_regex(answer, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS size FROM b),
l AS (SELECT *, list_filter([CASE WHEN len(missing) > 0 THEN concat('add keywords: ', array_to_string(missing[1:5], ', ')) END, CASE WHEN len(missing) > 5 THEN concat(len(missing) - 5, ' more keywords') END,
 CASE WHEN regexp_matches(text, '(?i){YEARS}') THEN concat('years asked: ', regexp_extract(text, '(?i){YEARS}', 1)) END, {_DEGREES}, CASE WHEN size < 300 THEN 'brief' WHEN size > 700 THEN 'long' END], lambda x: x IS NOT NULL) AS lines FROM m)
SELECT item_id, array_to_string(present, ',') AS present, array_to_string(missing, ',') AS missing, CAST(CASE WHEN len(keywords) = 0 THEN 0 ELSE round_even(100.0 * len(present) / len(keywords), 0) END AS INTEGER) AS score,
 array_to_string(CASE WHEN len(lines) < 2 THEN list_concat(lines, ['use the posting''s wording', 'give figures']) ELSE lines END, '; ') AS advice FROM l""",
    "fl1_present": f"WITH {RESUMES_SQL} SELECT doc_id, " + ", ".join(f"len({_hits('text', n)}) > 0 AS has_{i}" for i, n in enumerate(["sql", "spark", "C++", "degree"])) + " FROM resumes",
}
