"""Repair chains for page text: locations, glued and repeated headers, dates, corrections, header standardisation.

Each chain is a list of ordered rules (one Catalyst expression) or a pass over
lines (array functions, no exchange).  Patterns use ASCII classes and no word
borders or look-around, so that SQL engines agree on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.repair import RuleSet
from scriptorium.sources.tables import DAMAGED_SQL, damaged

# Names of states, their abbreviations, and compound cities.
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky",
    "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming",
]
ABBREVIATIONS = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
CITIES = ["Salt Lake City", "New York", "Los Angeles", "San Francisco", "San Diego", "San Jose", "Las Vegas", "St. Louis", "Kansas City"]
# Section headers, the ones that tend to repeat with their qualifiers, and months.
HEADERS = [
    "SUMMARY", "PROFILE", "OBJECTIVE", "ABOUT ME", "PROFESSIONAL SUMMARY", "EXPERIENCE", "EMPLOYMENT", "WORK HISTORY", "CAREER", "PROFESSIONAL EXPERIENCE", "EDUCATION", "ACADEMIC", "QUALIFICATIONS",
    "EDUCATIONAL BACKGROUND", "SKILLS", "COMPETENCIES", "EXPERTISE", "TECHNICAL SKILLS", "CORE SKILLS", "PROJECTS", "ACCOMPLISHMENTS", "ACHIEVEMENTS", "KEY PROJECTS", "CERTIFICATIONS", "LANGUAGES",
    "INTERESTS", "CERTIFICATES", "PROFESSIONAL", "VOLUNTEER", "REFERENCES", "ACTIVITIES", "PUBLICATIONS", "AWARDS", "HONORS", "LEADERSHIP",
]
REPEATING = {
    "SKILLS": "technical|core|soft|hard|computer|programming|language|software", "EXPERIENCE": "work|professional|industry|volunteer|leadership",
    "EDUCATION": "continuing|additional|professional|further", "PROJECTS": "key|major|selected|notable|personal",
}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
# Synonyms of standard headers.
STANDARD_HEADERS = {
    "SUMMARY": ["SUMMARY", "PROFESSIONAL SUMMARY", "CAREER SUMMARY", "OBJECTIVE", "PROFILE"],
    "EXPERIENCE": ["EXPERIENCE", "WORK EXPERIENCE", "EMPLOYMENT HISTORY", "WORK HISTORY", "PROFESSIONAL EXPERIENCE"],
    "EDUCATION": ["EDUCATION", "ACADEMIC BACKGROUND", "EDUCATIONAL BACKGROUND", "ACADEMIC QUALIFICATIONS"],
    "SKILLS": ["SKILLS", "TECHNICAL SKILLS", "CORE COMPETENCIES", "EXPERTISE", "KEY SKILLS"],
    "PROJECTS": ["PROJECTS", "PROJECT EXPERIENCE", "KEY PROJECTS", "RELEVANT PROJECTS"],
    "CERTIFICATIONS": ["CERTIFICATIONS", "CERTIFICATES", "PROFESSIONAL CERTIFICATIONS", "CREDENTIALS"],
    "AWARDS": ["AWARDS", "HONORS", "ACHIEVEMENTS", "RECOGNITIONS"],
    "PUBLICATIONS": ["PUBLICATIONS", "PAPERS", "RESEARCH", "ARTICLES"],
    "LANGUAGES": ["LANGUAGES", "LANGUAGE SKILLS", "LANGUAGE PROFICIENCY"],
    "INTERESTS": ["INTERESTS", "HOBBIES", "ACTIVITIES", "PERSONAL INTERESTS"],
    "REFERENCES": ["REFERENCES", "RECOMMENDATIONS", "PROFESSIONAL REFERENCES"],
}
# Words with m read as rn, and two names, corrected.
CORRECTIONS = {
    "ciplomacy": "diplomacy", "Ciplomacy": "Diplomacy", "CIPLOMACY": "DIPLOMACY", "villereek": "millcreek", "Villereek": "Millcreek", "VILLEREEK": "MILLCREEK", "cornpany": "company", "comrnittee": "committee",
    "rnanagement": "management", "cornmunication": "communication", "rnanufacturing": "manufacturing", "rnarketing": "marketing", "developrnent": "development", "environrnent": "environment",
    "Environrnent": "Environment", "requirernents": "requirements", "achievernent": "achievement", "irnplementation": "implementation", "Irnplementation": "Implementation", "docurnent": "document",
    "rnonitoring": "monitoring", "prornotion": "promotion", "recomrnendation": "recommendation", "Recomrnendation": "Recommendation", "departrnent": "department", "rnanager": "manager",
}
# Words in which rn stands for m, whatever their case.
RN_WORDS = ["company", "committee", "management", "communication", "manufacturing", "marketing", "development", "environment", "requirements", "achievement", "implementation", "document", "monitoring", "promotion", "recommendation"]
SPLIT_WORDS = ["company", "management", "development", "environment", "implementation", "requirements", "achievement"]

_longest = lambda names: "|".join(sorted(names, key=lambda n: (-len(n), n)))
_STATE, _ABBR, _HEADER = _longest(STATES), "|".join(ABBREVIATIONS), _longest(HEADERS)
_CITY = _longest(c.replace(".", "[.]") for c in CITIES)
_MONTH = _longest([*MONTHS, *(m[:3] for m in MONTHS), "Sept"])
_B, _E = "(^|[^A-Za-z0-9_])", r"([^A-Za-z0-9_]|\z)"  # word borders that take part in the match
_DASH = "[ \t\n]*[-–—][ \t\n]*"

# What finds matches sooner starts with a sign that is rare in texts; names are looked at from there.  What a match
# takes is no border or word of the next one, so a Sept, date or @ that follows at once is taken along unchanged.
_W = "[A-Za-z0-9_]"
_GLUED = f"(?:{_MONTH})[0-9]{{4}}"


def _begun(names: str) -> str:
    """The names, tried only where a letter begins one of them."""
    return f"(?=[{''.join(sorted({n[0] for n in names.split('|')}))}])(?:{names})"


def _after_dash(found: str) -> tuple[tuple[str, str], ...]:
    return tuple((dash, rf"{dash}(?<=[0-9 \t\n]{dash})[ \t\n]*+{found}") for dash in "-–—")


_VERB_AFTER = (("", rf"[A-Z](?<=[a-z][A-Z])(?<=(?:{_STATE}|{_CITY})[A-Z])[a-z]"),)


def _after_state(ending: str) -> tuple[str, str]:
    return rf"[A-Z](?<=[a-z][A-Z])(?<=(?:{_STATE})[A-Z])[a-z]+{ending}(?!{_W})", "\n$0"


#: Dates, locations, contacts and headers: the standard library.
LIBRARY = (
    RuleSet()
    .add("month_year_newline", "dates", rf"({_MONTH})\s+([0-9]{{4}})\s*\n\s*-\s*({_MONTH})\s*\n?\s*([0-9]{{4}})", "$1 $2 - $3 $4", near=(("-", rf"\n\s*+-\s*+{_begun(_MONTH)}"),))
    .add("no_spaces", "dates", rf"({_MONTH})([0-9]{{4}})-({_MONTH})([0-9]{{4}})", "$1 $2 - $3 $4", near=(("-", rf"-(?<=[a-z][0-9]{{4}}-){_begun(_MONTH)}[0-9]"),))
    .add("dash_prefix", "dates", rf"^-\s*({_MONTH})\s+([0-9]{{4}})", " - $1 $2", near=(("-", r"\A-"),))
    .add("dash_prefix_inline", "dates", rf"\n-\s*({_MONTH})\s+([0-9]{{4}})", "\n - $1 $2", "\n-")
    .add("newline_in_range", "dates", rf"({_MONTH})\s+([0-9]{{4}})\s*-\s*({_MONTH})\s*\n\s*([0-9]{{4}})", "$1 $2 - $3 $4", near=(("-", r"\n\s*+[0-9]{4}"),))
    .add("sept", "dates", f"{_B}Sept{_E}", "$1Sep$2", "Sept", sooner=(f"Sept(?<!{_W}Sept)(?!{_W})([^A-Za-z0-9_]Sept(?!{_W}))?+", "Sep$1"))
    .add("month_year_glued", "dates", rf"{_B}({_MONTH})([0-9]{{4}}){_E}", "$1$2 $3$4", sooner=(f"([0-9]{{4}})(?<=[a-z][0-9]{{4}})(?<=(?<!{_W}){_GLUED})(?!{_W})([^A-Za-z0-9_]{_GLUED}(?!{_W}))?+", " $1$2"))
    .add("dash_spacing", "dates", rf"({_MONTH})\s+([0-9]{{4}}){_DASH}({_MONTH})\s+([0-9]{{4}})", "$1 $2 - $3 $4", near=_after_dash(rf"{_begun(_MONTH)}\s"))
    .add("year_range", "dates", rf"([0-9]{{4}}){_DASH}([0-9]{{4}})", "$1 - $2", near=_after_dash("[0-9]{4}"))
    .add("present", "dates", rf"({_MONTH})\s+([0-9]{{4}}){_DASH}(Present|Current)", "$1 $2 - $3", "ent", _after_dash("(?:Present|Current)"))
    .add("state_verb_past", "locations", f"({_STATE})([A-Z][a-z]+ed){_E}", "$1\n$2$3", near=_VERB_AFTER, sooner=_after_state("ed"))
    .add("state_verb_ing", "locations", f"({_STATE})([A-Z][a-z]+ing){_E}", "$1\n$2$3", near=_VERB_AFTER, sooner=_after_state("ing"))
    .add("city_verb", "locations", f"({_CITY})([A-Z][a-z]+)", "$1\n$2", near=_VERB_AFTER)
    .add("space_before_at", "contact", r"([A-Za-z0-9_]+)\s+@([A-Za-z0-9_]+)", "$1@$2", near=(("@", rf"@(?<=\s@){_W}"),))
    .add("space_after_at", "contact", r"([A-Za-z0-9_]+)@\s+([A-Za-z0-9_]+)", "$1@$2", near=(("@", rf"@(?<={_W}@)\s"),), sooner=(rf"@(?<={_W}@)\s++({_W}++@?+)", "@$1"))
    .add("space_around_at", "contact", r"([A-Za-z0-9_]+)\s+@\s+([A-Za-z0-9_]+)", "$1@$2", near=(("@", r"@(?<=\s@)\s"),))
    .add("embedded_skills", "headers", "([a-z])SKILLS", "$1\n\nSKILLS", "SKILLS", sooner=("SKILLS(?<=[a-z]SKILLS)", "\n\nSKILLS"))
    .add("embedded_experience", "headers", "([a-z])EXPERIENCE", "$1\n\nEXPERIENCE", "EXPERIENCE", sooner=("EXPERIENCE(?<=[a-z]EXPERIENCE)", "\n\nEXPERIENCE"))
    .add("period_skills", "headers", "[.]SKILLS", ".\n\nSKILLS", ".SKILLS")
    .add("period_experience", "headers", "[.]EXPERIENCE", ".\n\nEXPERIENCE", ".EXPERIENCE")
)
STATE_SPLIT = (
    RuleSet()
    .add("state_capital", "states", f"({_STATE})([A-Z][a-z]+)", "$1\n$2")
    .add("state_small", "states", f"({_STATE})([a-z]+)", "$1 $2")
    .add("state_digit", "states", f"({_STATE})([0-9])", "$1\n$2")
    .add("abbreviation_capital", "states", f"({_ABBR})([A-Z][a-z]+)", "$1\n$2")
    .add("abbreviation_digit", "states", f"({_ABBR})([0-9])", "$1\n$2")
)
CITY_STATE = (
    RuleSet()
    .add("city_state_word", "cities", r"([A-Z][a-z]+(?: [A-Z][a-z]+)?)\s*,\s*([A-Z]{2})([A-Z][a-z]+)", "$1, $2\n$3")
    .add("salt_lake", "cities", r"Salt\s+Lake\s+City\s*([A-Z][a-z]+)", "Salt Lake City\n$1", "Salt")
    .add("name_location", "cities", r"([A-Z]{2,})\s*([A-Z]{2,})\s*([A-Z][a-z]+)", "$1 $2\n$3")
)
#: Headers in capitals only: in any case, words like "experienced" would be cut.
HEADER_GLUE = (
    RuleSet()
    .add("before", "glue", rf"([a-z0-9.!?:;,*+)•-])({_HEADER})", "$1\n\n$2")
    .add("after", "glue", rf"({_HEADER})([A-Z]?[a-z])", "$1\n\n$2")
)
HEADER_ROOM = RuleSet().add("alone", "room", rf"(^|\n)[ \t]*({_HEADER})[ \t]*:?[ \t]*(\n|\z)", "$1\n$2\n$3").add("lines", "room", r"\n{3,}", "\n\n")
PAGE_DATES = RuleSet().add("bullets", "bullets", r"([^\n])\s*([•*-])\s", "$1\n$2 ")
for _m in MONTHS:
    PAGE_DATES.add(f"short_{_m.lower()}", "months", f"(?i){_B}{_m}{_E}", f"$1{_m[:3]}$2")
_SHORT = "|".join(m[:3] for m in MONTHS)
(
    PAGE_DATES.add("year_ranges", "dates", r"([0-9]{4})\s*([-–—])\s*([0-9]{4}|[A-Za-z0-9_]+)", "$1 $2 $3")
    .add("city_comma", "dates", r"([A-Za-z0-9_]+)\s*,\s*([A-Z]{2})", "$1, $2")
    .add("month_ranges", "dates", rf"(?i)({_SHORT})[a-z]*\s+([0-9]{{4}})\s*[-–—]\s*({_SHORT})[a-z]*\s+([0-9]{{4}})", "$1 $2 - $3 $4")
    .add("broken_lines", "dates", rf"(?i)({_SHORT})[a-z]*\s+([0-9]{{4}})\s*\n\s*({_SHORT})[a-z]*\s+([0-9]{{4}})", "$1 $2 - $3 $4")
    .add("dash_before", "dates", rf"(?i)[-–—]\s*({_SHORT})[a-z]*\s+([0-9]{{4}})", " - $1 $2")
    .add("to_present", "dates", rf"(?i)({_SHORT})[a-z]*\s+([0-9]{{4}})\s*[-–—]\s*(Present|Current)", "$1 $2 - $3")
    .add("glued", "dates", rf"(?i)({_SHORT})([0-9]{{4}})", "$1 $2")
    .add("side_by_side", "dates", rf"(?i)({_SHORT})[a-z]*\s+([0-9]{{4}})\s+({_SHORT})[a-z]*\s+([0-9]{{4}})", "$1 $2 - $3 $4")
    .add("resume", "titles", rf"(?i){_B}(?:RESUME|CV)[ \t]*\n+", "$1")
    .add("objective", "titles", "([a-z])(OBJECTIVE)([a-z])", "$1\n\n$2\n\n$3", "OBJECTIVE")
    .add("position", "titles", r"([A-Z][a-z]+(?: [A-Z][a-z]+)*) (?:at|for) ([A-Z][a-zA-Z\s,.]+)", "\n$1 at $2")
    .add("job_dates", "titles", rf"(?i)((?:{_SHORT})[a-z]* [0-9]{{4}})\s*(-|to|–|—)\s*((?:{_SHORT})[a-z]* [0-9]{{4}}|Present|Current)", "\n$1 $2 $3")
)
PATTERNS = RuleSet().add("https", "urls", "(?i)htt[o]s://", "https://").add("http", "urls", "(?i)hftp://", "http://").add("www", "urls", "(?i)wwvv[.]", "www.").add("spotify", "urls", "(?i)spoti[.]fi([0-9a-zA-Z]+)", "spoti.fi/$1").add("com", "urls", f"(?i)[.]corn{_E}", ".com$1")
PATTERNS.add("before_phone", "phones", rf"{_B}(?:JJR|JJ)\s*([0-9]{{3}}[-\s]*[0-9]{{3}}[-\s]*[0-9]{{4}})", "$1$2", "JJ").add("after_phone", "phones", rf"([0-9]{{3}}[-\s]*[0-9]{{3}}[-\s]*[0-9]{{4}})\s*(?:JJR|JJ){_E}", "$1$2", "JJ").add("artifact", "phones", rf"{_B}(?:JJ\s+R|JJR|JJ){_E}", "$1$2", "JJ")
for _w in SPLIT_WORDS:
    _cut = {"company": 3, "implementation": 5}.get(_w, len(_w.split("ment")[0]))
    _head = _w[1:_cut].replace("m", "rn") if _w == "company" else _w[1:_cut]
    PATTERNS.add(f"split_{_w}", "split words", f"{_B}([{_w[0].upper()}{_w[0]}]){_head} {_w[_cut:]}{_E}", f"$1$2{_w[1:]}$3", f"{_head} {_w[_cut:]}")
RN = {c(next(k for k, v in CORRECTIONS.items() if v == w)): c(w) for w in RN_WORDS for c in (str.lower, str.capitalize, str.upper)}
_PIECES = ["rn", "Rn", "RN", "iplomacy", "IPLOMACY", "illereek", "ILLEREEK"]
WHITE = RuleSet().add("white", "white", r"[ \t\n\r]+", " ")
SYNONYMS = RuleSet().add("blanks", "blanks", r"[ \t]+", " ")
for _std, _names in STANDARD_HEADERS.items():
    _any = _longest(_names)
    SYNONYMS.add(f"glued_{_std}", "glued", f"([a-z])({_any})([A-Za-z])", f"$1\n\n{_std}\n\n$3")
    SYNONYMS.add(f"start_{_std}", "start", f"^({_any})([A-Za-z])", f"{_std}\n\n$2")
    SYNONYMS.add(f"middle_{_std}", "middle", rf"([.!?])(\s+)({_any})(\s+)", f"$1$2\n\n{_std}\n\n")
    SYNONYMS.add(f"alone_{_std}", "alone", rf"(\s)({_any})(\s|:|\z)", f"\n\n{_std}\n\n")
SYNONYMS.add("bullets", "bullets", r"([^\n])(\s*[•*-])(\s)", "$1\n$2$3").add("lines", "lines", r"\n{3,}", "\n\n")
TIDY = RuleSet().add("lines", "tidy", r"\n{3,}", "\n\n", "\n\n\n").add("blanks", "tidy", r"[ \t]{2,}", " ").add("ends", "tidy", r" +\n", "\n", " \n").add("starts", "tidy", r"\n +", "\n", "\n ")
RESUME = RuleSet().add("first", "resume", r"^RESUME\s*\n+", "", "RESUME").add("line", "resume", r"\n\s*RESUME\s*\n", "\n", "RESUME")
BLANKS = RuleSet().add("blanks", "blanks", r"[ \t]+", " ")
#: A header and a small fragment on the next line are one word.
HEAL = RuleSet()
for _h in HEADERS:
    HEAL.add(f"heal_{_h}", "heal", rf"(^|\n){_h}\s*\n\s*([a-z0-9])", f"$1{_h.lower()}$2", _h)
_SKILL = r"(^|[^A-Za-z0-9_])SKILLS([^A-Za-z0-9_]|\z)"
EMBEDDED = [h for h in HEADERS if len(h) >= 5]


def merged_capitals(text: Column) -> Column:
    """Two capitalised words without a space: a line end after a state or a word of over four letters, else a space; name particles keep theirs."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), "([A-Z][a-z]+)([A-Z][a-z]+)", "\x01$1\x02$2\x01")
    first = lambda p: F.substring_index(p, "\x02", 1)

    def joined(p: Column) -> Column:
        long_ = first(p).isin(STATES) | ((F.length(first(p)) > 4) & ~first(p).isin("Senior", "Junior"))
        sign = F.when(F.replace(p, F.lit("\x02"), F.lit("")).rlike("Mc|Mac|Van|De|La"), F.lit("")).when(long_, F.lit("\n")).otherwise(F.lit(" "))
        return F.when(p.contains("\x02"), F.concat(first(p), sign, F.substring_index(p, "\x02", -1))).otherwise(p)

    return F.array_join(F.transform(F.split(marked, "\x01"), joined), "")


MERGED_SQL = (
    "array_to_string(list_transform(string_split(regexp_replace(translate({0}, '\x01\x02', ''), '([A-Z][a-z]+)([A-Z][a-z]+)', '\x01\\1\x02\\2\x01', 'g'), '\x01'), lambda p: CASE WHEN NOT contains(p, '\x02') THEN p ELSE "
    "concat(string_split(p, '\x02')[1], CASE WHEN regexp_matches(replace(p, '\x02', ''), 'Mc|Mac|Van|De|La') THEN '' WHEN list_contains([" + ", ".join(f"'{s}'" for s in STATES) + "], string_split(p, '\x02')[1]) "
    "OR (length(string_split(p, '\x02')[1]) > 4 AND string_split(p, '\x02')[1] NOT IN ('Senior', 'Junior')) THEN '\n' ELSE ' ' END, string_split(p, '\x02')[2]) END), '')"
)


def repeated_headers(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed: of lines that are a header which tends to repeat, the one with the longest content stays; the others go, qualified ones become a bullet with a colon.

    A line's content reaches to the next line that is any header.  Lines that hold
    such a header within other words are none.  Steps are columns of their own, so
    that no expression is written out twice.
    """
    df = df.withColumn("_l", F.split(text, "\n"))
    for header, kinds in REPEATING.items():
        bare, subtitle = rf"^\s*(?:(?i:{kinds})\s+)?(?i:{header})\s*:?\s*$", rf"(?i)^\s*(?:{kinds})\s+{header}"
        df = df.withColumn("_n", F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(bare).alias("own"))))
        df = df.withColumn("_ends", F.transform(F.filter("_n", lambda n: F.trim(n["x"]).isin(HEADERS)), lambda n: n["i"]))
        own = F.filter("_n", lambda n: n["own"])
        df = df.withColumn("_of", F.transform(own, lambda n: F.struct((n["i"] - F.coalesce(F.array_min(F.filter("_ends", lambda a: a > n["i"])), F.size("_l"))).alias("c"), n["i"].alias("i"))))
        df = df.withColumn("_main", F.array_min("_of")["i"])
        bullet = lambda x: F.when(x.rlike(subtitle), F.concat(F.lit("• "), F.trim(F.replace(x, F.lit(":"), F.lit(""))), F.lit(":")))  # noqa: B023, E731
        df = df.withColumn("_l", F.filter(F.transform("_n", lambda n: F.when(n["own"] & (n["i"] != F.col("_main")), bullet(n["x"])).otherwise(n["x"])), lambda x: x.isNotNull()))  # noqa: B023
    return df.withColumn(text, F.array_join("_l", "\n")).drop("_l", "_n", "_ends", "_of", "_main")


def _repeated_sql(text: str) -> str:
    names = ", ".join(f"'{h}'" for h in HEADERS)
    for header, kinds in REPEATING.items():
        bare, subtitle = rf"^\s*(?:(?i:{kinds})\s+)?(?i:{header})\s*:?\s*$", rf"(?i)^\s*(?:{kinds})\s+{header}"
        text = f"""(SELECT coalesce(string_agg(y, E'\\n' ORDER BY i), '') FROM (SELECT i, CASE WHEN NOT b OR i = m THEN x WHEN regexp_matches(x, '{subtitle}') THEN concat('• ', trim(replace(x, ':', '')), ':') END AS y
 FROM (SELECT *, first(CASE WHEN b THEN i END) OVER (ORDER BY CASE WHEN b THEN 0 ELSE 1 END, n - i DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m
  FROM (SELECT *, coalesce(min(CASE WHEN h THEN i END) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER ()) AS n
   FROM (SELECT i, x, regexp_matches(x, '{bare}') AS b, trim(x) IN ({names}) AS h FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT string_split({text}, E'\\n') AS l)))))) WHERE y IS NOT NULL)"""
    return text


def page_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed by the whole chain for a page: blanks, states, cities, headers, repeated headers, dates and titles, merged words."""
    first = F.col(text)
    for rules in (BLANKS, STATE_SPLIT, CITY_STATE, HEADER_GLUE, HEADER_ROOM):
        first = rules.apply(first)
    df = repeated_headers(df.withColumn(text, first), text)
    return df.withColumn(text, merged_capitals(PAGE_DATES.apply(F.col(text))))


def exchanged(text: Column, known: dict[str, str], pieces: list[str]) -> Column:
    """Whole words exchanged in one pass, however many there are: all are marked, and the marked pieces looked up.

    Every word holds one of the pieces; a text without any isn't searched.
    """
    assert all(any(x in w for x in pieces) for w in known)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])

    def done(t: Column) -> Column:
        marked = F.regexp_replace(F.translate(t, "\x01", ""), f"(?<![A-Za-z0-9_])({_longest(known)})(?![A-Za-z0-9_])", "\x01$1\x01")
        return F.array_join(F.transform(F.split(marked, "\x01"), lambda p: F.coalesce(F.try_element_at(table, p), p)), "")

    some = lambda t: reduce(lambda a, b: a | b, [t.contains(x) for x in pieces])
    return F.transform(F.array(text), lambda t: F.when(some(t), done(t)).otherwise(t))[0]


def patterns(text: Column) -> Column:
    """URLs, phones and split words by rules, then rn for m in known words of any case."""
    return exchanged(PATTERNS.apply(text), RN, _PIECES)


def corrected_text(text: Column) -> Column:
    """Known words, then URLs, phones, split words and rn for m; line ends stay."""
    return PATTERNS.apply(exchanged(text, RN | CORRECTIONS, _PIECES))


def _lines(df: DataFrame, text: str) -> DataFrame:
    """df with _l, the lines of text, and _z: each line (x) with the one before (p) and after (q), '' where there is none.

    Lines are columns of their own and neighbours are zipped on, so that nothing is
    evaluated for each line over the whole text.
    """
    df = df.withColumn("_l", F.split(text, "\n"))
    n = F.size("_l")
    before = F.concat(F.array(F.lit("")), F.slice("_l", F.lit(1), n - 1))
    after = F.concat(F.slice("_l", F.lit(2), n), F.array(F.lit("")))
    near = F.zip_with(before, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return df.withColumn("_z", F.zip_with("_l", near, lambda x, y: F.struct(x.alias("x"), y["p"].alias("p"), y["q"].alias("q"))))


def duplicate_skills(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed: lines with SKILLS after the first such line become bullets."""
    df = df.withColumn("_n", F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(_SKILL).alias("hit"))))
    df = df.withColumn("_first", F.array_min(F.transform(F.filter("_n", lambda n: n["hit"]), lambda n: n["i"])))
    paired = F.zip_with("_n", F.array_repeat("_first", F.size("_n")), lambda n, f: F.when(n["hit"] & (n["i"] > f), F.lit("• SKILLS:")).otherwise(n["x"]))
    return df.withColumn(text, F.array_join(paired, "\n")).drop("_n", "_first")


def final_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed by the library by categories (headers, dates, locations, contact), corrections, room around headers, no RESUME, one SKILLS, tidy lines."""
    done = corrected_text(LIBRARY.apply(F.col(text), ["headers", "dates", "locations", "contact"]))
    df = duplicate_skills(df.withColumn(text, RESUME.apply(HEADER_ROOM.apply(done))), text)
    return df.withColumn(text, TIDY.apply(F.col(text)))


def standardised(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed: synonyms of headers become the standard one, blank lines go, and one follows each header but a last one."""
    every = [n for names in STANDARD_HEADERS.values() for n in names]
    df = df.withColumn("_l", F.filter(F.transform(F.split(SYNONYMS.apply(F.col(text)), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    after = F.concat(F.slice("_l", F.lit(2), F.size("_l")), F.array(F.lit(None).cast("string")))
    spaced = F.zip_with("_l", after, lambda x, q: F.when(F.upper(x).isin(every) & q.isNotNull(), F.concat(x, F.lit("\n"))).otherwise(x))
    # zip_with ends the shorter side with nulls: nothing of nothing
    return df.withColumn(text, F.array_join(F.filter(spaced, lambda x: x.isNotNull()), "\n")).drop("_l")


_ROOMY = "|".join(["EDUCATION", "ACADEMIC", "EXPERIENCE", "EMPLOYMENT", r"WORK\s+HISTORY", "SKILLS", "EXPERTISE", "SUMMARY", "PROFILE", "OBJECTIVE", "PROJECTS", "CERTIFICATIONS", "CERTIFICATES", "CREDENTIALS", "AWARDS", "HONORS", "ACHIEVEMENTS", "PUBLICATIONS", "RESEARCH", "PAPERS", "VOLUNTEER", r"COMMUNITY\s+SERVICE", "LANGUAGES", r"LANGUAGE\s+PROFICIENCY", "INTERESTS", "HOBBIES", "ACTIVITIES", "REFERENCES", "RECOMMENDATIONS"])
_ROOMY = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{_ROOMY})(?:[^A-Za-z0-9_]|\z)"


def roomy_headers(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text changed: a blank line before and after each line that holds a header's word, unless there is one."""
    # a blank line that the header before has brought counts
    before = lambda z: F.when((F.trim(z["p"]) != "") & ~z["p"].rlike(_ROOMY), F.lit("\n")).otherwise(F.lit(""))
    after = lambda z: F.when(F.trim(z["q"]) != "", F.lit("\n")).otherwise(F.lit(""))
    done = F.transform("_z", lambda z: F.when(z["x"].rlike(_ROOMY), F.concat(before(z), F.trim(z["x"]), after(z))).otherwise(z["x"]))
    return _lines(df, text).withColumn(text, F.array_join(done, "\n")).drop("_l", "_z")


def split_embedded(text: Column) -> Column:
    """Headers inside a line get lines of their own, unless the line holds "with", "and" or "professional development"; bullets start lines."""
    inside = rf"([^a-zA-Z0-9\n])({_longest(EMBEDDED)})([^a-zA-Z0-9]|\z)"
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.lower(x).rlike("with|and|professional development"), x).otherwise(F.regexp_replace(x, inside, "$1\n\n$2\n$3")))
    glued = F.regexp_replace(F.array_join(lines, "\n"), f"({_longest(EMBEDDED)})([A-Z][a-z]+)", "\n\n$1\n$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(glued, r"\n{3,}", "\n\n"), "([^\n])•", "$1\n• "), r"^RESUME\s*\n+", "")


def noisy(text: Column, key: Column) -> Column:
    """One of five substitutions, chosen by the key, at its first place: deterministic noise for fixtures."""
    swaps = [("m", "rn"), (" ", ""), ("l", "1"), ("o", "0"), ("e", "c")]
    out = text
    for i, (a, b) in enumerate(swaps):
        at = F.instr(text, a)
        out = F.when((key % len(swaps) == i) & (at > 0), F.concat(F.left(text, at - 1), F.lit(b), F.substring(text, at + 1, F.length(text)))).otherwise(out)
    return out


def _over_frame(make) -> object:
    return lambda spark, sf_dir: make(damaged(spark, sf_dir)).select("doc_id", F.col("text").alias("repaired"))


def _over(make) -> object:
    return lambda spark, sf_dir: damaged(spark, sf_dir).select("doc_id", make(F.col("text")).alias("repaired"))


def rp1_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, name, n, docs: substitutions of each rule and of each category (name '')."""
    rules = LIBRARY.rules
    d = damaged(spark, sf_dir)
    hits = lambda r: F.when(F.col("text").contains(r.needs), F.regexp_count("text", F.lit(r.pattern))).otherwise(0).cast("long")
    d = d.select(*[hits(r).alias(f"h{i}") for i, r in enumerate(rules)])
    counts = d.agg(*[x for i in range(len(rules)) for x in (F.sum(f"h{i}").alias(f"n{i}"), F.sum((F.col(f"h{i}") > 0).cast("long")).alias(f"d{i}"))])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name"), F.coalesce(f"n{i}", F.lit(0)).alias("n"), F.coalesce(f"d{i}", F.lit(0)).alias("docs")) for i, r in enumerate(rules)])).alias("x")).select("x.*")
    return each.unionByName(each.groupBy("category").agg(F.lit("").alias("name"), F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def rp22_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(spark, sf_dir).select("doc_id", noisy(F.col("text"), F.col("doc_id")).alias("noisy"))


QUERIES = {
    "rp1_library": _over(LIBRARY.apply), "rp1_substitutions": rp1_substitutions, "rp2_page_text": _over_frame(page_text), "rp2a_states": _over(STATE_SPLIT.apply), "rp2b_cities": _over(CITY_STATE.apply),
    "rp2c_glue": _over(HEADER_GLUE.apply), "rp2d_room": _over(HEADER_ROOM.apply), "rp2e_repeated": _over_frame(repeated_headers), "rp2f_dates": _over(PAGE_DATES.apply), "rp2g_merged": _over(merged_capitals),
    "rp3_final": _over_frame(final_text), "rp4_corrections": _over(lambda t: WHITE.apply(corrected_text(t))), "rp5_standardised": _over_frame(standardised), "rp6_roomy": _over_frame(roomy_headers), "rp7_split": _over(split_embedded),
    "rp10_healed": _over(HEAL.apply), "rp13_patterns": _over(patterns), "rp19_ordered": _over(lambda t: LIBRARY.apply(t, ["dates", "locations", "contact", "headers"])), "rp22_noisy": rp22_noisy,
}


def _word_rules(known: dict[str, str]) -> RuleSet:
    """A rule for each word, twice: neighbours share a border."""
    rules = RuleSet()
    for wrong, right in [*known.items()] * 2:
        rules.add(wrong, "words", f"{_B}{wrong}{_E}", f"$1{right}$2")
    return rules


def patterns_sql(text: str) -> str:
    return _word_rules(RN).sql(PATTERNS.sql(text))


def corrected_sql(text: str) -> str:
    return patterns_sql(_word_rules(CORRECTIONS).sql(text))


def _sql(expression: str) -> str:
    return f"WITH {DAMAGED_SQL} SELECT doc_id, {expression} AS repaired FROM damaged"


def _page_sql(text: str) -> str:
    for rules in (BLANKS, STATE_SPLIT, CITY_STATE, HEADER_GLUE, HEADER_ROOM):
        text = rules.sql(text)
    return text


_EVERY = ", ".join(f"'{n}'" for names in STANDARD_HEADERS.values() for n in names)
_INSIDE = rf"([^a-zA-Z0-9\n])({_longest(EMBEDDED)})([^a-zA-Z0-9]|\z)"
_SUBS = " UNION ALL ".join(
    f"SELECT '{r.category}' AS category, '{r.name}' AS name, CAST(coalesce(sum(len(regexp_extract_all(text, '{r.pattern}'))), 0) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN regexp_matches(text, '{r.pattern}') THEN 1 ELSE 0 END), 0) AS BIGINT) AS docs FROM damaged" for r in LIBRARY.rules
)
ORACLE_SQL = {
    "rp1_library": _sql(LIBRARY.sql("text")), "rp2a_states": _sql(STATE_SPLIT.sql("text")), "rp2b_cities": _sql(CITY_STATE.sql("text")), "rp2c_glue": _sql(HEADER_GLUE.sql("text")), "rp2d_room": _sql(HEADER_ROOM.sql("text")),
    "rp2e_repeated": _sql(_repeated_sql("text")), "rp2f_dates": _sql(PAGE_DATES.sql("text")), "rp2g_merged": _sql(MERGED_SQL.replace("{0}", "text")),
    "rp2_page_text": f"WITH {DAMAGED_SQL}, a AS (SELECT doc_id, {_page_sql('text')} AS text FROM damaged), b AS (SELECT doc_id, {_repeated_sql('text')} AS text FROM a), c AS (SELECT doc_id, {PAGE_DATES.sql('text')} AS text FROM b) SELECT doc_id, {MERGED_SQL.replace('{0}', 'text')} AS repaired FROM c",
    "rp3_final": rf"""WITH {DAMAGED_SQL}, a AS (SELECT doc_id, {RESUME.sql(HEADER_ROOM.sql(corrected_sql(LIBRARY.sql('text', ['headers', 'dates', 'locations', 'contact']))))} AS text FROM damaged),
l AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM a)),
m AS (SELECT *, min(CASE WHEN regexp_matches(x, '{_SKILL}') THEN i END) OVER (PARTITION BY doc_id) AS first FROM l),
j AS (SELECT doc_id, string_agg(CASE WHEN i > first AND regexp_matches(x, '{_SKILL}') THEN '• SKILLS:' ELSE x END, E'\n' ORDER BY i) AS text FROM m GROUP BY doc_id) SELECT doc_id, {TIDY.sql('text')} AS repaired FROM j""",
    "rp4_corrections": _sql(WHITE.sql(corrected_sql("text"))), "rp13_patterns": _sql(patterns_sql("text")), "rp10_healed": _sql(HEAL.sql("text")),
    "rp5_standardised": rf"""WITH {DAMAGED_SQL}, a AS (SELECT doc_id, list_filter(list_transform(string_split({SYNONYMS.sql('text')}, E'\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM damaged),
e AS (SELECT doc_id, len(l) AS n, unnest(l) AS x, unnest(range(len(l))) AS i FROM a), s AS (SELECT doc_id, string_agg(CASE WHEN upper(x) IN ({_EVERY}) AND i < n - 1 THEN concat(x, E'\n') ELSE x END, E'\n' ORDER BY i) AS r FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(r, '') AS repaired FROM damaged LEFT JOIN s USING (doc_id)""",
    "rp6_roomy": rf"""WITH {DAMAGED_SQL}, e AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM damaged)),
h AS (SELECT *, regexp_matches(x, '{_ROOMY}') AS h, coalesce(lag(x) OVER w, '') AS p, coalesce(lead(x) OVER w, '') AS q FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, string_agg(CASE WHEN h THEN concat(CASE WHEN i > 0 AND trim(p, ' ') <> '' AND NOT regexp_matches(p, '{_ROOMY}') THEN E'\n' ELSE '' END, trim(x, ' '), CASE WHEN trim(q, ' ') <> '' THEN E'\n' ELSE '' END) ELSE x END, E'\n' ORDER BY i) AS repaired FROM h GROUP BY doc_id""",
    "rp7_split": _sql(rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, E'\n'), lambda x: CASE WHEN regexp_matches(lower(x), 'with|and|professional development') THEN x ELSE regexp_replace(x, '{_INSIDE}', E'\\1\n\n\\2\n\\3', 'g') END), E'\n'),
 '({_longest(EMBEDDED)})([A-Z][a-z]+)', E'\n\n\\1\n\\2', 'g'), '\n{{3,}}', E'\n\n', 'g'), E'([^\n])•', E'\\1\n• ', 'g'), '^RESUME\s*\n+', '', 'g')"""),
    "rp19_ordered": _sql(LIBRARY.sql("text", ["dates", "locations", "contact", "headers"])),
    "rp1_substitutions": f"WITH {DAMAGED_SQL}, s AS ({_SUBS}) SELECT * FROM s UNION ALL SELECT category, '' AS name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM s GROUP BY category",
    "rp22_noisy": f"WITH {DAMAGED_SQL} SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % 5 = {i} AND instr(text, '{a}') > 0 THEN concat(left(text, instr(text, '{a}') - 1), '{b}', substring(text, instr(text, '{a}') + 1))" for i, (a, b) in enumerate([("m", "rn"), (" ", ""), ("l", "1"), ("o", "0"), ("e", "c")])) + " ELSE text END AS noisy FROM damaged",
}
