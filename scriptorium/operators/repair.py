"""Text repair: ordered rewrite rules as one Catalyst expression each (a left fold of regexp_replace)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import capitalised, squeeze, tokens
from scriptorium.sources.tables import RESUMES_SQL, read, resumes


_BORDER = "(^|[^A-Za-z0-9_])"


def _quick(pattern: str, replacement: str) -> str:
    """The same matches for Java, sooner: a list of names is tried only where a letter begins one of them; and a leading
    word, which the replacement keeps, is not read again from each of its letters (the match ends with a whole word, so the
    next one can't begin inside it)."""
    word = "([A-Za-z0-9_]+)"
    if re.match(re.escape(word) + r"(@|\\s)", pattern) and pattern.endswith(word) and not re.search(r"[|]|\\[1-9]", pattern) and replacement.startswith("$1") and replacement.count("$1") == 1:
        pattern = "([A-Za-z0-9_])" + pattern.removeprefix(word)

    def begun(m: re.Match) -> str:
        names = m[1].split("|")
        return f"((?=[{''.join(sorted({n[0] for n in names}))}])(?:{m[1]}))" if len(names) > 3 else m[0]

    return re.sub(r"(?<![\\\[])\(((?:[A-Za-z][A-Za-z .[\]]*[|])+[A-Za-z][A-Za-z .[\]]*)\)", begun, pattern)


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    pattern: str  # RE2 and Java alike: no look-around
    replacement: str  # with $1, $2
    needs: str = ""  # what every match holds: a text without it isn't searched
    near: tuple[tuple[str, str], ...] = ()  # Java only: a text with a match holds one of the signs ('' is in all), and what is found there sooner
    sooner: tuple[str, str] = ()  # Java only: pattern and replacement that give the same text sooner

    def on(self, text: Column) -> Column:
        return _where(self.near, self._rewritten, text)

    def _rewritten(self, text: Column) -> Column:
        rewritten = lambda t: F.regexp_replace(t, *(self.sooner or (_quick(self.pattern, self.replacement), self.replacement)))
        inner = self.pattern.removeprefix(_BORDER)
        if self.needs and (self.near or self.sooner):
            able = lambda t: t.contains(self.needs)
        elif self.near or self.sooner:
            return rewritten(text)
        elif inner != self.pattern and not re.search(r"\\[1-9]", inner) and _quick(inner, "") != inner:
            # every match holds one of the rest of the pattern, which is found sooner
            able = lambda t: t.rlike(_quick(inner, ""))
        elif self.needs:
            able = lambda t: t.contains(self.needs)
        else:
            return rewritten(text)
        return _named(text, lambda t: F.when(able(t), rewritten(t)).otherwise(t))


def _named(text: Column, f: Callable[[Column], Column]) -> Column:
    """As an array of one, the text is named and so is evaluated once."""
    return F.transform(F.array(text), f)[0]


def _where(near: tuple[tuple[str, str], ...], f: Callable[[Column], Column], text: Column) -> Column:
    if not near:
        return f(text)
    able = lambda t: reduce(Column.__or__, [t.contains(sign) & t.rlike(p) if sign else t.rlike(p) for sign, p in near])
    return _named(text, lambda t: F.when(able(t), f(t)).otherwise(t))


@dataclass
class RuleSet:
    """Rules in the order in which they are applied; users add their own."""

    rules: list[Rule] = field(default_factory=list)

    def add(self, name: str, category: str, pattern: str, replacement: str, needs: str = "", near: tuple[tuple[str, str], ...] = (), sooner: tuple[str, str] = ()) -> RuleSet:
        self.rules.append(Rule(name, category, pattern, replacement, needs, near, sooner))
        return self

    def get(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)

    def chosen(self, categories: list[str] | None = None) -> list[Rule]:
        if categories is None:
            return self.rules
        return [r for c in categories for r in self.rules if r.category == c]

    def apply(self, text: Column, categories: list[str] | None = None) -> Column:
        """Rules in a row with the same `near` are looked for once: where it isn't found, none of them changes the text."""
        for near, some in groupby(self.chosen(categories), lambda r: r.near):
            rules = list(some)
            text = _where(near, lambda t: reduce(lambda x, r: r._rewritten(x), rules, t), text)  # noqa: B023
        return text

    def apply_one(self, text: Column, name: str) -> Column:
        """An unknown rule leaves the text as it is."""
        r = self.get(name)
        return r.on(text) if r else text

    def statistics(self, df: DataFrame, text: str = "text") -> DataFrame:
        """rule_no, name, category, changed: texts that each rule alone would change."""
        marks = [F.sum((F.regexp_replace(text, r.pattern, r.replacement) != F.col(text)).cast("long")).alias(f"r{i}") for i, r in enumerate(self.rules)]
        rows = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("changed")) for i, r in enumerate(self.rules)])
        return df.agg(*marks).select(F.explode(rows).alias("x")).select("x.*")

    def sql(self, text: str, categories: list[str] | None = None) -> str:
        """The same fold in DuckDB's dialect."""
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        back = lambda s: s.replace("$", "\\")
        return reduce(lambda t, r: f"regexp_replace({t}, {quote(r.pattern)}, {quote(back(r.replacement))}, 'g')", self.chosen(categories), text)


MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
STANDARD = (
    RuleSet()
    .add("year_range", "dates", r"\b((?:19|20)[0-9]{2})[ ]*[-–][ ]*((?:19|20)[0-9]{2}|Present|Current)\b", "$1 - $2")
    .add("sept", "dates", r"\bSept\b", "Sep")
    .add("month_year", "dates", rf"\b({MONTHS})[.]?[ ]*((?:19|20)[0-9]{{2}})\b", "$1 $2")
    .add("city_verb", "locations", r"\b([A-Z][a-z]+, [A-Z]{2})(Developed|Managed|Led|Built|Designed)\b", "$1\n$2")
    .add("at_sign", "contact", r"([A-Za-z0-9._+-]+)[ ]*@[ ]*([A-Za-z0-9-]+[.][A-Za-z]{2,})", "$1@$2")
    .add("header_glue", "headers", r"([a-z.])(SKILLS|EXPERIENCE|EDUCATION|SUMMARY)\b", "$1\n\n$2")
)
#: Spaces lost between a small and a capital letter, or a letter and a digit.
SPACING = RuleSet().add("camel", "spacing", r"([a-z])([A-Z])", "$1 $2").add("digit", "spacing", r"([a-z])([0-9])", "$1 $2").add("blanks", "spacing", r"[ \t]+", " ")
ATS = RuleSet().add("bullets", "ats", r"[•●▪◦‣]", "-").add("white", "ats", r"[ \t\n\r]+", " ")
NORMAL = RuleSet().add("cid", "normal", r"\(cid:[0-9]+\)", "").add("white", "normal", r"[ \t\n\r]+", " ").add("signs", "normal", r"[^A-Za-z0-9_ ]", "")
HTML = (
    RuleSet()
    .add("script", "html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    .add("tags", "html", r"<[^>]+>", " ")
    .add("lt", "html", "&lt;", "<").add("gt", "html", "&gt;", ">").add("quot", "html", "&quot;", '"').add("nbsp", "html", "&nbsp;", " ").add("amp", "html", "&amp;", "&")
)


def corrected(text: Column, known: dict[str, str]) -> Column:
    """Words looked up in lower case; the correction takes the case of the word (UPPER, Capital, as it is)."""
    pairs = F.create_map(*[F.lit(x.lower()) for kv in known.items() for x in kv])

    def fix(t: Column) -> Column:
        new = F.try_element_at(pairs, F.lower(t))
        cased = F.when((t == F.upper(t)) & (F.length(t) > 1), F.upper(new)).when(F.left(t, F.lit(1)) == F.upper(F.left(t, F.lit(1))), capitalised(new)).otherwise(new)
        return F.when(new.isNull(), t).otherwise(cased)

    return F.array_join(F.transform(tokens(text), fix), " ")


def joined_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Broken lines joined by one space: a line without . : ; at its end before one that starts with a small letter or digit; bullets never."""
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(doc).orderBy("line_no")
    before = F.lag("line").over(w)
    glue = before.isNotNull() & (F.trim(before) != "") & ~before.rlike(r"[.:;]\s*$") & F.col("line").rlike("^[a-z0-9]") & ~F.col("line").rlike("^[-*•]")
    piece = F.when(F.col("line_no") == 0, F.col("line")).otherwise(F.concat(F.when(glue, F.lit(" ")).otherwise(F.lit("\n")), F.col("line")))
    marked = lines.withColumn("piece", piece)
    return marked.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "").alias(text))


def distinct_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no, line: each distinct non-blank trimmed line where it comes first."""
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return lines.groupBy(doc, "line").agg(F.min("line_no").alias("line_no")).select(doc, "line_no", "line")


def rp1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resumes(spark, sf_dir).select("doc_id", "text", STANDARD.apply(F.col("text")).alias("repaired"))
    return d.select("doc_id", "repaired", (F.col("repaired") != F.col("text")).alias("changed"))


def rp8_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    glued = F.concat(F.lower("n_name"), F.lit("Developed"), F.col("n_nationkey"), F.lit("  systems2020"))
    return n.select("n_nationkey", SPACING.apply(glued).alias("spaced"))


def rp12_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", corrected(F.col("text"), {"th": "the", "er": "her", "onthe": "on", "and": "plus"}).alias("corrected"))


def rp15_ats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes(spark, sf_dir).select("doc_id", F.trim(ATS.apply(F.replace("text", F.lit("- "), F.lit("• ")))).alias("ats"))


def rp17_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", squeeze(HTML.apply(F.col("html"))).alias("plain"))


def rp18_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(NORMAL.apply(F.col("text"))).cast("binary")).alias("md5"))


def rp9_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "([a-z]) ([a-z])", "$1\n$2").alias("text"))
    return joined_lines(broken, "item_id")


def rp1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STANDARD.statistics(resumes(spark, sf_dir))


def wn12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "rp1_repaired": rp1_repaired, "rp1_statistics": rp1_statistics, "rp8_spacing": rp8_spacing, "rp9_joined": rp9_joined, "rp12_corrected": rp12_corrected,
    "rp15_ats": rp15_ats, "rp17_html": rp17_html, "rp18_normalised": rp18_normalised, "wn12_lines": wn12_lines,
}
_STATS = " UNION ALL ".join(
    f"SELECT {i} AS rule_no, '{r.name}' AS name, '{r.category}' AS category, CAST(coalesce(sum(CASE WHEN {RuleSet([r]).sql('text')} <> text THEN 1 ELSE 0 END), 0) AS BIGINT) AS changed FROM resumes" for i, r in enumerate(STANDARD.rules)
)
ORACLE_SQL = {
    "rp1_repaired": f"WITH {RESUMES_SQL}, r AS (SELECT doc_id, text, {STANDARD.sql('text')} AS repaired FROM resumes) SELECT doc_id, repaired, repaired <> text AS changed FROM r",
    "rp1_statistics": f"WITH {RESUMES_SQL} {_STATS}",
    "rp8_spacing": f"SELECT n_nationkey, {SPACING.sql("concat(lower(n_name), 'Developed', n_nationkey, '  systems2020')")} AS spaced FROM nation",
    "rp12_corrected": r"""WITH t AS (SELECT item_id, list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS l FROM benchmark),
e AS (SELECT item_id, unnest(l) AS t, unnest(range(len(l))) AS p FROM t), k(a, b) AS (VALUES ('th', 'the'), ('er', 'her'), ('onthe', 'on'), ('and', 'plus')),
f AS (SELECT item_id, p, CASE WHEN b IS NULL THEN t WHEN t = upper(t) AND length(t) > 1 THEN upper(b) WHEN left(t, 1) = upper(left(t, 1)) THEN concat(upper(left(b, 1)), lower(substring(b, 2))) ELSE b END AS x FROM e LEFT JOIN k ON lower(t) = a)
SELECT item_id, string_agg(x, ' ' ORDER BY p) AS corrected FROM f GROUP BY item_id""",
    "rp15_ats": f"WITH {RESUMES_SQL} SELECT doc_id, trim({ATS.sql("replace(text, '- ', '• ')")}) AS ats FROM resumes",
    "rp17_html": rf"SELECT page_id, trim(regexp_replace({HTML.sql('html')}, '[ \t\n\r]+', ' ', 'g')) AS plain FROM pages",
    "rp18_normalised": f"SELECT doc_id, md5(lower({NORMAL.sql('text')})) AS md5 FROM documents",
    "rp9_joined": r"""WITH b AS (SELECT item_id, string_split(regexp_replace(text, '([a-z]) ([a-z])', E'\\1\n\\2', 'g'), E'\n') AS l FROM benchmark),
e AS (SELECT item_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM b), g AS (SELECT *, lag(line) OVER (PARTITION BY item_id ORDER BY p) AS prev FROM e)
SELECT item_id, string_agg(CASE WHEN p = 0 THEN line ELSE concat(CASE WHEN trim(prev) <> '' AND NOT regexp_matches(prev, '[.:;]\s*$') AND regexp_matches(line, '^[a-z0-9]') THEN ' ' ELSE E'\n' END, line) END, '' ORDER BY p) AS text FROM g GROUP BY item_id""",
    "wn12_lines": r"SELECT doc_id, min(p) AS line_no, line FROM (SELECT doc_id, trim(unnest(l)) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS p FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents)) WHERE line <> '' GROUP BY doc_id, line",
}
