"""Headers, section types and qualities of texts by additive evidence on lines.

The evidence is SQL text that Spark and DuckDB both read, with MATCH, WORDS and
CHARS for what they name differently; patterns hold no backslashes and ASCII only.
Windows are by document; there is no join but on the document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.sections import sections
from scriptorium.sources.tables import DAMAGED_SQL, damaged, resumes

# Header families and their wordings, in order.
FAMILIES = {
    "experience": ["experience", "employment", "work history", "professional experience"], "education": ["education", "academic background", "qualifications", "degrees"],
    "skills": ["skills", "technical skills", "core competencies", "expertise"], "summary": ["summary", "profile", "objective", "professional summary"],
    "projects": ["projects", "portfolio", "select projects", "key projects"], "certifications": ["certifications", "certificates", "licenses", "credentials"],
    "achievements": ["achievements", "accomplishments", "awards", "honors"], "references": ["references", "recommendations", "testimonials"],
    "volunteering": ["volunteering", "volunteer experience", "community service"], "interests": ["interests", "hobbies", "activities", "personal interests"],
    "publications": ["publications", "papers", "research", "articles"], "languages": ["languages", "language skills", "language proficiency"],
}
# Words that are no headers, headers and their types, and words of job titles.
NO_HEADERS = ["RESUME", "CV", "CURRICULUM VITAE", "NAME", "PAGE", "EMAIL", "PHONE", "ADDRESS", "STREET", "CITY", "STATE", "ZIP"]
HEADER_TYPES = {
    "SUMMARY": "summary", "PROFILE": "summary", "PROFESSIONAL": "summary", "OBJECTIVE": "summary", "EXPERIENCE": "experience", "EMPLOYMENT": "experience", "WORK HISTORY": "experience", "EDUCATION": "education",
    "ACADEMIC": "education", "SKILLS": "skills", "TECHNICAL SKILLS": "skills", "COMPETENCIES": "skills", "PROJECTS": "projects", "ACCOMPLISHMENTS": "achievements", "ACHIEVEMENTS": "achievements",
    "CERTIFICATIONS": "certifications", "LANGUAGES": "languages", "INTERESTS": "interests", "VOLUNTEER": "volunteer", "REFERENCES": "references",
}
JOB_TITLES = ["MANAGER", "DIRECTOR", "ENGINEER", "DEVELOPER", "ANALYST", "COORDINATOR", "ASSISTANT", "SPECIALIST", "CONSULTANT"]
# Patterns of titles, and clues of contents, by type in order.
TITLE_PATTERNS = {
    "contact": "email|phone|address|contact|linkedin|github", "education": "education|academic|degree|university|college|school|gpa", "experience": "experience|employment|work history|professional|career",
    "skills": "skills|expertise|proficiencies|competencies|technologies", "projects": "projects|portfolio|implementations|developments", "certifications": "certifications|certificates|credentials|licenses",
    "awards": "awards|honors|achievements|recognitions", "publications": "publications|papers|research|articles|journals", "summary": "summary|profile|objective|about me|professional summary",
    "languages": "languages|language proficiency|fluent in", "interests": "interests|hobbies|activities|passions", "references": "references|referees|recommendations", "volunteer": "volunteer|community service|non-profit",
}
CLUES = {
    "education": ["bachelor", "master", "ph.d", "diploma", "certificate", "university of", "college", "gpa", "honors"],
    "experience": ["manager", "developer", "engineer", "analyst", "consultant", "intern", "specialist", "coordinator", "responsible for"],
    "skills": ["proficient", "experienced", "familiar with", "expert in", "knowledge of", "skilled in", "mastery of"],
}
_WORD = lambda names: f"(^|[^a-z0-9_])({names})([^a-z0-9_]|$)"
# Evidence of contents (on lower-cased text) and its weight, by type.
EVIDENCE = {
    "contact": [("[a-z0-9_.-]+@[a-z0-9_.-]+[.][a-z0-9_]+", 0.8), ("[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", 0.7), (_WORD("linkedin[.]com|github[.]com|portfolio"), 0.6)],
    "education": [(_WORD("university|college|school|academy|institute"), 0.8), (_WORD("degree|bachelor|master|phd|diploma|graduate|graduated|major"), 0.8), (_WORD("b[.]s[.]|m[.]s[.]|b[.]a[.]|m[.]a[.]|ph[.]d|mba|certificate"), 0.7), (_WORD("gpa|honors|cum laude|scholarship|academic"), 0.6)],
    "experience": [(_WORD("(20|19)[0-9][0-9] *[-–—] *((20|19)[0-9][0-9]|present|current|now)"), 1.0), (_WORD("(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{4}"), 0.8), (_WORD("manager|director|engineer|developer|analyst|coordinator|assistant|specialist"), 0.6), (_WORD("company|corporation|inc[.]|llc|firm|organization"), 0.5), (_WORD("responsible for|managed|led|developed|implemented|created|improved|reduced|increased"), 0.4)],
    "skills": [(_WORD("proficient|expertise|familiar|knowledge|programming|software|tools|technologies"), 0.7), (_WORD("java|python|c[+][+]|javascript|html|css|sql|php|swift|kotlin|ruby|go|rust"), 0.9), (_WORD("aws|azure|gcp|docker|kubernetes|linux|windows|macos|git|rest|api|json|xml"), 0.8), ("[•*,;].*[•*,;]", 0.5)],
    "summary": [(_WORD("professional|experienced|skilled|motivated|passionate|detail-oriented|team player|driven"), 0.6), (_WORD("years of experience|background in|proven track record|expertise in|specialize in"), 0.7), (_WORD("seeking|looking for|aim to|goal|objective|career path|opportunity|position"), 0.5)],
    "projects": [(_WORD("project|developed|created|built|designed|implemented|application|website|system"), 0.7), (_WORD("github|gitlab|portfolio|demo|prototype|collaborated|collaboration"), 0.8), ("(http|https|www|[.]com|[.]org|[.]net|[.]io)([^a-z0-9_]|$)", 0.5)],
    "certifications": [(_WORD("certified|certification|license|accredited|accreditation|exam|credential"), 0.9)],
}
#: Issues that repairs are to remove, counted before and after.
ISSUES = {"glued_at": "[A-Za-z0-9_] +@", "glued_header": "[a-z.]SKILLS|[a-z.]EXPERIENCE", "glued_capital": "[a-z][A-Z]", "tight_range": "[0-9]{4}-[0-9]{4}", "sept": "Sept"}
QUALITY_HEADERS = ["education", "experience", "skills", "summary", "profile", "certifications", "projects", "publications"]


def _dialect(sql: str, duck: bool) -> str:
    """MATCH(x, p): a regular expression is found; HITS(x, p): how often."""
    if not duck:
        sql = re.sub(r"MATCH\((\w+), '([^']*)'\)", lambda m: _quick(m[1], m[2]), sql)
    return sql.replace("MATCH(", "regexp_matches(" if duck else "regexp_like(").replace("HITS(", "hits(" if duck else "regexp_count(")


def _any_of(names: list[str]) -> str:
    """A pattern found where any of the names is: three classes first, then the names by first letter."""
    names = sorted({n for n in names if not any(o != n and o in n for o in names)})
    ahead = "".join(f"[{''.join(sorted({n[i] for n in names}))}]" for i in range(min(3, *map(len, names)) if len(names) > 1 else 0))
    return f"(?={ahead})(?:{'|'.join(f'{a}(?:{"|".join(n[1:] for n in names if n[0] == a)})' for a in sorted({n[0] for n in names}))})"


#: Patterns and what gives the same rows sooner: no alternative is tried where its first sign is missing.
_SAME = {
    ":$": "endswith({x}, ':')",
    "(^|[^A-Za-z0-9_])[0-9]{4}([^A-Za-z0-9_]|$)": "regexp_like({x}, '[0-9]{{4}}(?<![A-Za-z0-9_][0-9]{{4}})(?![A-Za-z0-9_])')",
    "@|http|www|[+][0-9]|[(][0-9]{3}[)]|[0-9]{3}-[0-9]{3}-[0-9]{4}": "contains({x}, '@') OR regexp_like({x}, 'http') OR contains({x}, 'www') OR regexp_like({x}, '[+(0-9](?:(?<=[+])[0-9]|(?<=[(])[0-9]{{3}}[)]|(?<=[0-9])[0-9]{{2}}-[0-9]{{3}}-[0-9]{{4}})')",
}


def _quick(x: str, pattern: str) -> str:
    """What Spark runs for MATCH(x, pattern), with the same rows: words are searched as bytes, and
    their borders looked at only where they occur; lists of words are grouped by first letter; counted words are taken from the start of the line only, each once."""
    plain = lambda p: re.fullmatch(r"[a-z -]+([|][a-z -]+)*", p)
    head, tail = _WORD("\n").split("\n")
    worded = re.fullmatch(f"{re.escape(head)}(.*){re.escape(tail)}", pattern)
    if worded and plain(worded[1]):
        names = worded[1].split("|")
        names = [n for n in names if not any(o != n and re.search(_WORD(o), n) for o in names)]  # a name that holds another adds nothing
        return "(" + " OR ".join(f"contains({x}, '{n}') AND regexp_like({x}, '{n}(?<![a-z0-9_]{n})(?![a-z0-9_])')" for n in names) + ")"
    if plain(pattern):
        names = pattern.split("|")
        return f"regexp_like({x}, '{_any_of(names)}')"
    if pattern in _SAME:
        return f"({_SAME[pattern].format(x=x)})"
    if re.fullmatch(r"\[\^ \]\+( \+\[\^ \]\+)* \+\[\^ \]", pattern):
        pattern = "^ *+" + pattern.replace("+", "++")
    return f"regexp_like({x}, '{pattern}')"


def _run(name: str, **tables: DataFrame) -> DataFrame:
    return _filled(SQL[name], **tables)


def _filled(sql: str, **tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    sql = _dialect(sql, False).replace("{", "{{").replace("}", "}}")  # braces of patterns
    for t in tables:
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return spark.sql(sql, **tables)


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, i (from 0), line: every trimmed line, blank ones too."""
    return df.select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line")).select("doc_id", "i", F.trim("line").alias("line"))


_CAPS = "(MATCH(line, '[A-Z]') AND NOT MATCH(line, '[a-z]'))"
_TITLE = "(MATCH(line, '[A-Z]') AND NOT MATCH(line, '(^|[^A-Za-z])[a-z]') AND NOT MATCH(line, '[A-Za-z][A-Z]'))"
_FEW = "(NOT MATCH(line, '[^ ]+ +[^ ]+ +[^ ]+ +[^ ]+ +[^ ]'))"


def _family(names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN t = '{n}' THEN 3 WHEN MATCH(t, '{_WORD(n)}') THEN 2" for n in names) + " ELSE 0 END"


def _first_family() -> str:
    each = [f"WHEN t IN ({', '.join(f"'{n}'" for n in names)}) THEN 5 WHEN MATCH(t, '{_WORD('|'.join(names))}') THEN 4 WHEN MATCH(t, '{'|'.join(names)}') THEN 2.5" for names in FAMILIES.values()]
    return f"CASE {' '.join(each)} ELSE 0 END"


def _where_named(found: str) -> str:
    """Family scores, which are 0 where no name of any family occurs, worked out only elsewhere."""
    return f"CASE WHEN MATCH(t, '{'|'.join(n for names in FAMILIES.values() for n in names)}') THEN {found} ELSE 0 END"


_NO_WORD = r"[\\x00-/:-^`{-\\x{10FFFF}]"


def _where_worded(found: str) -> str:
    """The same for scores that are 0 where no name stands as words of its own: names are tried only behind a sign that is of no word.

    The class names what it takes (t has no capitals): Java took over ten times as long with [^a-z0-9_] here.
    """
    every = [n for names in FAMILIES.values() for n in names]
    names = [n for n in every if not any(o != n and re.search(_WORD(o), n) for o in every)]  # a name that holds another adds nothing
    assert not any(o != n and o in n for n in names for o in names)
    return f"CASE WHEN regexp_like(concat(' ', t), '{_NO_WORD}{_any_of(names)}(?![a-z0-9_])') THEN {found} ELSE 0 END"


def _sum(parts: list[str]) -> str:
    return " + ".join(f"({p})" for p in parts)


def _type_of(column: str) -> str:
    each = []
    for kind, names in FAMILIES.items():
        listed = ", ".join(f"'{n}'" for n in names)
        shared = "|".join(sorted({w for n in names for w in n.split() if len(w) > 3}))
        each.append((f"{column} IN ({listed})", f"MATCH({column}, '{'|'.join(names)}')", f"MATCH({column}, '(^| )({shared})( |$)')", kind))
    kind = " ".join(f"WHEN {a} OR {b} OR {c} THEN '{k}'" for a, b, c, k in each)
    sure = " ".join(f"WHEN {a} THEN 1.0 WHEN {b} THEN 0.9 WHEN {c} THEN 0.7" for a, b, c, _ in each)
    return f"CASE {kind} ELSE 'unknown' END AS type, CAST(CASE {sure} ELSE 0.0 END AS DOUBLE) AS confidence"


def _evidence() -> str:
    """A score for each type: its header wordings (half as much again, for there is a header) and its evidence in the content."""
    out = []
    for kind in ("contact", "education", "experience", "skills", "summary", "projects", "certifications"):
        names = FAMILIES.get(kind, ["contact", "personal information", "contact information"])
        header = _sum([f"CASE WHEN h = '{n}' THEN 4.5 WHEN MATCH(h, '{_WORD(n)}') THEN 3.0 WHEN MATCH(h, '{n}') THEN 1.5 ELSE 0 END" for n in names])
        found = _sum([f"CASE WHEN MATCH(c, '{p}') THEN {w} ELSE 0 END" for p, w in EVIDENCE[kind]])
        out.append(f"CAST({header} + {found} AS DOUBLE) AS {kind}")
    return ", ".join(out)


_KINDS = ["contact", "education", "experience", "skills", "summary", "projects", "certifications"]
_SCORES = ", ".join(
    f"CAST(0.1 * HITS(c, '{p}')" + "".join(f" + CASE WHEN MATCH(c, '{x.replace('.', '[.]')}') THEN 0.05 ELSE 0 END" for x in CLUES.get(k, []))
    + {"education": f" + CASE WHEN two AND MATCH(c, '{_WORD('bachelor|master|phd|diploma|degree|gpa')}') THEN 0.2 ELSE 0 END", "experience": f" + CASE WHEN two AND MATCH(c, '{_WORD('manage|develop|lead|responsible|project|team')}') THEN 0.2 ELSE 0 END", "skills": f" + CASE WHEN HITS(c, '[•*-]') > 3 OR MATCH(c, '{_WORD('proficient|experienced|knowledge|skills')}') THEN 0.2 ELSE 0 END"}.get(k, "")
    + f" AS DECIMAL(12, 2)) AS s_{k}" for k, p in TITLE_PATTERNS.items()
)
_BEST = f"greatest({', '.join(f's_{k}' for k in TITLE_PATTERNS)})"
_LONG_WORDS = {k: [w for w in p.replace("|", " ").split() if len(w) > 3] for k, p in TITLE_PATTERNS.items()}
# What a line by itself gives to sx9_scores.
_NONE = f"line = '' OR line IN ({', '.join(f"'{w}', '{w.title()}', '{w.lower()}'" for w in NO_HEADERS)})"
_RAISED = f"""{_first_family()}
 + CASE WHEN {_CAPS} AND length(line) > 3 AND {_FEW} THEN 3.0 WHEN {_TITLE} AND length(line) > 3 AND {_FEW} THEN 2.0 ELSE 0 END + CASE WHEN MATCH(line, ':$') THEN 1.5 ELSE 0 END
 + CASE WHEN length(line) < 20 THEN 1.5 WHEN length(line) < 30 THEN 0.75 ELSE 0 END"""
_LOWERED = "- CASE WHEN MATCH(line, '^[0-9]+ *[.]|^[(][0-9]+[)]') THEN 2.0 ELSE 0 END - CASE WHEN MATCH(line, '@|http|www|[+][0-9]|[(][0-9]{3}[)]|[0-9]{3}-[0-9]{3}-[0-9]{4}') THEN 2.0 ELSE 0 END"
_BULLET, _DATES, _YEAR = "^[•*-]", "[0-9]{4} *(-|to) *([0-9]{4}|present|current)", "(^|[^A-Za-z0-9_])[0-9]{4}([^A-Za-z0-9_]|$)"
SQL = {
    "sx2_headers": f"""SELECT doc_id, i, CAST(least(5.0, {_sum([_family(n) for n in FAMILIES.values()])}
 + CASE WHEN {_CAPS} AND {_FEW} THEN 2.0 WHEN {_TITLE} AND {_FEW} THEN 1.5 ELSE 0 END + CASE WHEN MATCH(line, '^[A-Za-z0-9_ ]+:$') THEN 1.5 ELSE 0 END
 + CASE WHEN length(line) < 25 AND NOT MATCH(line, '[^ ]+ +[^ ]+ +[^ ]+ +[^ ]') THEN 1.0 ELSE 0 END) AS DOUBLE) AS score FROM (SELECT *, lower(line) AS t FROM {{L}}) x WHERE line <> ''""",
    "sx9_scores": f"""SELECT doc_id, i, score, score >= 3 AND score = max(score) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS peak FROM (
 SELECT doc_id, i, line, CAST(CASE WHEN {_NONE} THEN 0 ELSE {_RAISED} + CASE WHEN i = 0 OR before = '' THEN 1.0 ELSE 0 END + CASE WHEN before = '' AND after = '' THEN 2.0 ELSE 0 END
 + CASE WHEN MATCH(after, '{_BULLET}') THEN 1.5 ELSE 0 END + CASE WHEN MATCH(lower(after), '{_DATES}') THEN 1.5 ELSE 0 END
 {_LOWERED}
 - CASE WHEN before IS NOT NULL AND after IS NOT NULL AND (year_before = 1 OR bullet_after = 1) AND MATCH(lower(line), '{'|'.join(JOB_TITLES).lower()}') THEN 3.0 ELSE 0 END END AS DOUBLE) AS score
 FROM (SELECT doc_id, i, line, lower(line) AS t, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after,
  max(CASE WHEN MATCH(line, '{_YEAR}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS year_before,
  max(CASE WHEN MATCH(line, '^•') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS bullet_after FROM {{L}}) x) y""",
    "sx11_types": "SELECT doc_id, i, CASE " + " ".join(f"WHEN MATCH(u, '{k}') OR contains('{k}', u) THEN '{v}'" for k, v in HEADER_TYPES.items()) + f" ELSE 'other' END AS type FROM (SELECT *, upper(line) AS u FROM {{L}}) x WHERE line <> '' AND {_CAPS} AND NOT MATCH(line, '[^ -~]') AND length(line) <= 40",
    "sx13_types": f"SELECT doc_id, i, {_type_of('n')} FROM (SELECT doc_id, i, trim(regexp_replace(lower(line), '[^a-z0-9_ ]', '' /*g*/)) AS n FROM {{L}} WHERE line <> '' AND length(line) <= 60) x",
    "sx5_types": f"""SELECT doc_id, seq, type, CAST(least(best / 3, 1.0) AS DOUBLE) AS confidence FROM (SELECT doc_id, seq, best, CASE {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _KINDS)} END AS type FROM (
 SELECT *, greatest({', '.join(_KINDS)}) AS best FROM (SELECT doc_id, seq, {_evidence()} FROM (SELECT doc_id, seq, lower(title) AS h, lower(substring(content, 1, 500)) AS c FROM {{S}}) x) y) z) q""",
    "sx20_classified": f"""SELECT doc_id, seq, CASE WHEN titled IS NOT NULL THEN titled WHEN worded IS NULL OR best > 0.7 THEN content_type ELSE worded END AS type,
 CAST(CASE WHEN titled IS NOT NULL THEN 0.9 WHEN worded IS NULL OR best > 0.7 THEN best ELSE 0.7 END AS DOUBLE) AS confidence FROM (
 SELECT *, CASE {' '.join(f"WHEN s_{k} = best THEN '{k}'" for k in TITLE_PATTERNS)} END AS content_type FROM (SELECT *, {_BEST} AS best FROM (SELECT doc_id, seq,
 CASE {' '.join(f"WHEN MATCH(t, '{p}') THEN '{k}'" for k, p in TITLE_PATTERNS.items())} END AS titled, CASE {' '.join(f"WHEN MATCH(t, '{'|'.join(w)}') THEN '{k}'" for k, w in _LONG_WORDS.items())} END AS worded, {_SCORES} FROM (
 SELECT doc_id, seq, lower(trim(title)) AS t, lower(content) AS c, MATCH(lower(content), '(20|19)[0-9]{{2}}[^a-z0-9_].*((20|19)[0-9]{{2}}|present)') AS two FROM {{S}}) x) y) z) q""",
    "sx16_context": f"""SELECT doc_id, i, CAST(CASE WHEN known AND {_CAPS} THEN 0.9 WHEN {_CAPS} AND MATCH(after, '[0-9]{{4}}|^[•*-]') THEN 0.8 WHEN known AND MATCH(after, '^[•*-]') THEN 0.6 END AS DOUBLE) AS confidence
 FROM (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, MATCH(lower(line), '{'|'.join(n[0] for n in FAMILIES.values())}') AS known FROM {{L}}) x
 WHERE line <> '' AND length(line) < 50 AND (known AND {_CAPS} OR {_CAPS} AND MATCH(after, '[0-9]{{4}}|^[•*-]') OR known AND MATCH(after, '^[•*-]'))""",
    "ex3_contact_lines": """SELECT doc_id, i, MATCH(line, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+[.][A-Za-z0-9_]+') AS email, MATCH(line, '[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}') AS phone,
 MATCH(lower(line), 'linkedin[.]com|/in/') AS linkedin, MATCH(lower(line), '(https?://)?(www[.])?[a-z0-9-]+[.][a-z]{2,}(/[^ ]*)?') AS website, MATCH(line, '[A-Z][a-zA-Z ]+, *[A-Z]{2}( +[0-9]{5})?([^A-Za-z0-9_]|$)') AS address FROM {L} WHERE line <> '' AND i < 10""",
    "fl_lines": f"""SELECT doc_id, i, length(line) > 10 AS long_enough, MATCH(line, '^[•*-]') AS bullet, MATCH(line, '[.:;]$') AS ended, MATCH(line, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9]{{4}}$') AS month_year,
 {_CAPS} AND length(line) > 3 AND {_FEW} AS capitals, {_TITLE} AND {_FEW} AS title_case, MATCH(line, 'Mc|Mac|Van|De|La') AS particle FROM {{L}} WHERE line <> ''""",
    "fl13_rejected": f"""SELECT doc_id, i, header, CASE WHEN MATCH(before, '[A-Za-z0-9]$') THEN 'inside a word' WHEN MATCH(after, '^[A-Za-z0-9]') THEN 'goes on' WHEN MATCH(before, '[a-z,] $') THEN 'inside a sentence' WHEN MATCH(after, '^ [a-z]') THEN 'sentence goes on' ELSE '' END AS rejected
 FROM (SELECT doc_id, i, header, substring(line, 1, instr(line, header) - 1) AS before, substring(line, instr(line, header) + length(header)) AS after FROM (SELECT doc_id, i, line, regexp_extract(line, '({'|'.join(n[0].upper() for n in FAMILIES.values())})', 1) AS header FROM {{L}}) x WHERE header <> '') y""",
    "pj17_tags": f"SELECT doc_id, i, CASE WHEN {_CAPS} AND length(line) < 50 THEN 'header' WHEN MATCH(line, ':$') THEN 'subheader' WHEN MATCH(line, '^[•*-]') THEN 'bullet' ELSE 'text' END AS tag FROM {{L}} WHERE line <> ''",
    "wn10_dropped": f"""SELECT doc_id, i, line = 'RESUME' AS resume, in_work = 1 AND year_near = 1 AND MATCH(lower(line), '{'|'.join(JOB_TITLES).lower()}') AS job_title, length(line) > 30 AND NOT MATCH(lower(line), '{'|'.join(n[0] for n in FAMILIES.values())}') AS too_long FROM (
 SELECT doc_id, i, line, CASE WHEN coalesce(max(CASE WHEN MATCH(line, 'EXPERIENCE|EMPLOYMENT|WORK HISTORY|Experience:') THEN i END) OVER w, -1) > coalesce(max(CASE WHEN MATCH(line, 'EDUCATION|SKILLS|PROJECTS') THEN i END) OVER w, -1) THEN 1 ELSE 0 END AS in_work,
  max(CASE WHEN MATCH(lower(line), '[0-9]{{4}} *(-|–|to) *([0-9]{{4}}|present|current)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS year_near
 FROM {{L}} WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE line <> ''""",
    "ag16_issues": " UNION ALL ".join(f"SELECT '{k}' AS issue, CAST(sum(HITS(text, '{p}')) AS BIGINT) AS before, CAST(sum(HITS(repaired, '{p}')) AS BIGINT) AS after, CAST(sum(length(repaired)) - sum(length(text)) AS BIGINT) AS grown FROM {{R}}" for k, p in ISSUES.items()),
}
_QUALITY = lambda c: f"(CAST(least(length({c}) / 1000.0, 10) AS DOUBLE) + least((HITS({c}, '\n\n') + 1) / 5.0, 5) + {_sum([f"CASE WHEN MATCH(lower({c}), '{_WORD(h)}') THEN 1 ELSE 0 END" for h in QUALITY_HEADERS])})"
SQL["ag19_quality"] = f"""SELECT doc_id, CAST(round(greatest(one, two), 6) AS DOUBLE) AS score, CASE WHEN two > one THEN 'repaired' ELSE 'text' END AS candidate FROM (SELECT doc_id, {_QUALITY('text')} AS one, {_QUALITY('repaired')} AS two FROM {{R}}) x"""


#: sx9_scores with every pattern once for each line, before the windows, which then move marks and no text.
_MARKS = f"""SELECT *, CASE WHEN {_NONE} THEN NULL ELSE CAST({_RAISED.replace(_first_family(), _where_named(_first_family()))} {_LOWERED} AS DOUBLE) END AS own, line = '' AS blank, MATCH(line, '{_BULLET}') AS bullet,
 MATCH(line, '{_YEAR}') AS year, MATCH(t, '{_DATES}') AS dates, MATCH(line, '^•') AS dot, MATCH(t, '{'|'.join(JOB_TITLES).lower()}') AS title FROM (SELECT *, lower(line) AS t FROM {{L}}) x"""
_ON_MARKS = """SELECT *, score >= 3 AND score = max(score) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS peak FROM (
 SELECT *, CASE WHEN own IS NULL THEN 0D ELSE own + CASE WHEN i = 0 OR blank_before THEN 1D ELSE 0D END + CASE WHEN blank_before AND blank_after THEN 2D ELSE 0D END + CASE WHEN bullet_after THEN 1.5D ELSE 0D END
 + CASE WHEN dates_after THEN 1.5D ELSE 0D END - CASE WHEN blank_before IS NOT NULL AND blank_after IS NOT NULL AND (year_before OR dot_after) AND title THEN 3D ELSE 0D END END AS score
 FROM (SELECT *, lag(blank) OVER w AS blank_before, lead(blank) OVER w AS blank_after, lead(bullet) OVER w AS bullet_after, lead(dates) OVER w AS dates_after,
  max(year) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS year_before, max(dot) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS dot_after
  FROM {M} WINDOW w AS (PARTITION BY doc_id ORDER BY i)) x) y"""


def header_scores(each: DataFrame, **marks: Column) -> DataFrame:
    """doc_id, i, score, peak of lines, and marks of a line that go with it."""
    marked = _filled(_MARKS, L=each).withColumns(marks).drop("line", "t")
    return _filled(_ON_MARKS, M=marked).select("doc_id", "i", "score", "peak", *marks)


def sx2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sum([_family(n) for n in FAMILIES.values()])
    return _filled(SQL["sx2_headers"].replace(found, _where_worded(found)), L=lines(damaged(spark, sf_dir)))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators.chains import LIBRARY

    return damaged(spark, sf_dir).select("doc_id", "text", LIBRARY.apply(F.col("text")).alias("repaired"))


def _hits(c: str, issue: str) -> Column:
    """How often an issue is in a text, with the same counts as HITS by what is found sooner."""
    text, p = F.col(c), ISSUES[issue]
    of = lambda p: F.regexp_count(text, F.lit(p))
    if issue == "glued_at":  # every hit ends at its own @
        before = F.split(text, "@")
        glued = lambda x: x.endswith(" ") & F.right(F.rtrim(x), F.lit(1)).rlike("[A-Za-z0-9_]")
        return F.when(text.contains(" @"), F.size(F.filter(F.slice(before, F.lit(1), F.size(before) - 1), glued))).when(text.isNotNull(), 0)
    if issue == "glued_header":
        each = [F.when(text.contains(n), of(f"{n}(?<=[a-z.]{n})")).when(text.isNotNull(), 0) for n in ("SKILLS", "EXPERIENCE")]
        return each[0] + each[1]
    if issue == "glued_capital":
        return of("[A-Z](?<=[a-z][A-Z])")
    able = text.contains("-") & text.rlike("-(?<=[0-9]-)[0-9]{4}") if issue == "tight_range" else text.contains("Sept")
    return F.when(able, of(p)).when(text.isNotNull(), 0)


#: A line end that no match of the library or of an issue reaches across, before the rules, between them and after: that takes white
#: space, a digit, a dash or an @ beside it, or a Sept behind it (whose border may be the end of another Sept).
_APART = r"\n(?<![\s0-9@–—-]\n)(?![\s0-9@–—-]|Sept)"
#: What every such match holds: one of these signs, the pattern where there is one ('' is in all), each found from its one rare letter.
_SIGNS = (("@", ""), ("Sept", ""), *((dash, rf"{dash}(?<![^0-9\s]{dash})\s*+[A-Z0-9]") for dash in "-–—"), ("", "[A-Z0-9](?<=[a-z.][A-Z0-9])(?:(?<=[A-Z])|[0-9]{3}(?<=[a-z][0-9]{4}))"))


def _touched(text: Column) -> Column:
    """The lines of a text that the library may change or that have issues; what it does to the text, it does to them.
    Every line is looked at; the others would go through all rules as they are."""
    signs = lambda x: reduce(Column.__or__, [x.contains(s) & x.rlike(p) if s and p else x.contains(s) if s else x.rlike(p) for s, p in _SIGNS])
    return F.array_join(F.filter(F.split(text, _APART), signs), "\n")


def ag16_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue, before, after, grown: all issues from one pass over the texts."""
    from scriptorium.operators.chains import LIBRARY

    r = damaged(spark, sf_dir).select(_touched(F.col("text")).alias("text"))
    r = r.withColumn("repaired", LIBRARY.apply(F.col("text"))).withColumns({f"text_{k}": _hits("text", k) for k in ISSUES})
    r = r.withColumns({f"repaired_{k}": F.when(F.col("repaired") == F.col("text"), F.col(f"text_{k}")).otherwise(_hits("repaired", k)) for k in ISSUES})
    sums = [F.sum(f"{c}_{k}").alias(f"{c}_{k}") for k in ISSUES for c in ("text", "repaired")]
    totals = r.agg(*sums, (F.sum(F.length("repaired")) - F.sum(F.length("text"))).alias("grown"))
    each = [F.struct(F.lit(k).alias("issue"), F.col(f"text_{k}").alias("before"), F.col(f"repaired_{k}").alias("after"), "grown") for k in ISSUES]
    return totals.select(F.inline(F.array(*each)))


def ag19_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _repaired(spark, sf_dir).withColumns({f"low_{c}": F.lower(c) for c in ("text", "repaired")})
    return _filled(re.sub(r"lower\((\w+)\)", r"low_\1", SQL["ag19_quality"]), R=both)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(resumes(spark, sf_dir)).select("doc_id", "seq", F.coalesce("title", F.lit("")).alias("title"), "content")


def ex7_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, at, range: every range of years or of months and years, in order."""
    found = F.regexp_extract_all("text", F.lit(_RANGE), 0)
    return damaged(spark, sf_dir).select("doc_id", F.posexplode(found).alias("at", "range"))


def pj12_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges, lines in capitals and addresses of pages in tags."""
    lines = F.transform(F.split(F.regexp_replace("text", _RANGE, "<date>$0</date>"), "\n"), lambda x: F.when(x.rlike("[A-Z]") & ~x.rlike("[a-z]") & ~x.rlike("^[•*-]"), F.concat(F.lit("<head>"), x, F.lit("</head>"))).otherwise(x))
    return damaged(spark, sf_dir).select("doc_id", F.regexp_replace(F.array_join(lines, "\n"), "(https?://|www[.])[^ \n<>]+", "<link>$0</link>").alias("marked"))


def se4_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the summary and the experience of a résumé share, without stop words, sorted."""
    from scriptorium.functions.text import words
    from scriptorium.operators.matching import STOP

    s = sections(resumes(spark, sf_dir)).groupBy("doc_id").agg(*[F.max(F.when(F.col("type") == k, F.col("content"))).alias(k) for k in ("summary", "experience")])
    both = F.array_except(F.array_intersect(words(F.col("summary")), words(F.col("experience"))), F.array(*[F.lit(w) for w in STOP]))
    return s.select("doc_id", F.array_join(F.array_sort(both), ",").alias("shared"))


def _lines(name: str):
    return lambda spark, sf_dir: _run(name, L=lines(damaged(spark, sf_dir)))


_RANGE = "((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* )?[0-9]{4} *[-–] *(((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* )?[0-9]{4}|Present|Current)"
_ON_LINES = ["sx16_context", "sx2_headers", "sx9_scores", "sx11_types", "sx13_types", "ex3_contact_lines", "fl_lines", "fl13_rejected", "pj17_tags", "wn10_dropped"]
QUERIES = {n: _lines(n) for n in _ON_LINES} | {
    "sx5_types": lambda spark, sf_dir: _run("sx5_types", S=_titled(spark, sf_dir)), "sx20_classified": lambda spark, sf_dir: _run("sx20_classified", S=_titled(spark, sf_dir)),
    "ag16_issues": ag16_issues, "ag19_quality": ag19_quality,
    "sx2_headers": sx2_headers, "sx9_scores": lambda spark, sf_dir: header_scores(lines(damaged(spark, sf_dir))), "ex7_ranges": ex7_ranges, "pj12_highlighted": pj12_highlighted, "se4_shared": se4_shared,
}


def _oracles() -> dict[str, str]:
    from scriptorium.operators.chains import LIBRARY
    from scriptorium.operators.matching import STOP
    from scriptorium.operators.sections import ORACLE_SQL as SECTIONS

    def duck(sql: str) -> str:
        sql = re.sub(r"HITS\((\w+), ('[^']*')\)", r"len(regexp_extract_all(\1, \2))", sql).replace("/*g*/", ", 'g'")
        return _dialect(sql, True)

    every_line = r"L AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS i, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM damaged))"
    parsed = SECTIONS["sx27_sections"].replace(" SELECT * FROM o", "")
    out = {n: f"WITH {DAMAGED_SQL}, {every_line} {duck(SQL[n]).replace('{L}', 'L')}" for n in _ON_LINES}
    out |= {n: f"{parsed} {duck(SQL[n]).replace('{S}', 'o')}" for n in ("sx5_types", "sx20_classified")}
    repaired = f"R AS (SELECT doc_id, text, {LIBRARY.sql('text')} AS repaired FROM damaged)"
    out |= {n: f"WITH {DAMAGED_SQL}, {repaired} {duck(SQL[n]).replace('{R}', 'R')}" for n in ("ag16_issues", "ag19_quality")}
    out["ex7_ranges"] = f"WITH {DAMAGED_SQL} SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS at, unnest(l) AS range FROM (SELECT doc_id, regexp_extract_all(text, '{_RANGE}') AS l FROM damaged)"
    out["pj12_highlighted"] = (
        rf"""WITH {DAMAGED_SQL} SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '{_RANGE}', '<date>\0</date>', 'g'), E'\n'), lambda x: CASE WHEN regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND NOT regexp_matches(x, '^[•*-]') THEN concat('<head>', x, '</head>') ELSE x END), E'\n'),
 E'(https?://|www[.])[^ \n<>]+', '<link>\0</link>', 'g') AS marked FROM damaged"""
    )
    own = r"list_filter(string_split_regex(lower({}), '[^A-Za-z0-9_]+'), lambda x: x <> '')"
    out["se4_shared"] = f"""{parsed}, p AS (SELECT doc_id, max(CASE WHEN type = 'summary' THEN content END) AS a, max(CASE WHEN type = 'experience' THEN content END) AS b FROM o GROUP BY doc_id)
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_intersect({own.format('a')}, {own.format('b')})), lambda x: NOT list_contains([{', '.join(f"'{w}'" for w in STOP)}], x))), ',') AS shared FROM p"""
    return out


ORACLE_SQL = _oracles()
