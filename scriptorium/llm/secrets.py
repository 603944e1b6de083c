"""Secret scan: token-like candidates, and a random forest that removes false positives.

A candidate is a run of MIN_LENGTH or more characters of [A-Za-z0-9+/_-] (with
closing "="), or, whatever its length and characters, the quoted or unquoted
value after a KEYISH word and = or : on the same line, and after "Bearer".  An
unquoted value ends at white space or a quote, without closing , ; . and brackets.
A block of the kind -----BEGIN ... KEY----- up to its end is one candidate, and
nothing inside it is another.
Features: length; shares of digits, capitals and signs; entropy; character
transitions (changes of class, and doubled characters); share of the letters
covered by dictionary words; known prefixes; hints in the path (here the source)
and in the words next to it; whether it is quoted, assigned to a key, of several
words, a placeholder or expression, or a block that says it is private.  Short values without a key before them
are no candidates.  Secrets that overlap are reported as one.  The forest is
trained on labelled findings: a list of (text, start, end, path, is_secret).
labelled_findings() makes a seeded set of invented ones; any other can be given.

Nulls: a null text has no candidates; a null source is an empty path.  Repeated
rows get the same result.  Ties: a score of CUT counts as a secret.  Texts are
scanned whole, in slices of bytes; a very long one is a slice of its own.  Empty
tables give no rows.  Only doc_id, text and source are read (a table without
source has empty paths), so extra columns don't matter; redact() keeps all
columns.  The trained forest is some hundred kB, whatever the corpus.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import kept, lean, slices, table

MIN_LENGTH = 16
AROUND = 60
CUT = 0.5
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH)
#: Words next to a candidate that speak for a secret, and those that speak against one.
KEYISH = re.compile(r"(?i)token|secret|passw|passwd|pwd|api[_ -]?key|apikey|auth|bearer|credential|private|access[_ -]?key|session")
HARMLESS = re.compile(r"(?i)(?<![a-z])(?:sha-?\d|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|build|version|example|sample|dummy|placeholder|test|image|src=|href|url|http|isbn|order|invoice|call|phone)")
#: A block in armour: a key, or something public.
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:[\sA-Za-z0-9+/=:,.\-]*?-----END \1-----|[\sA-Za-z0-9+/=]*[A-Za-z0-9+/=])")
PRIVATE = re.compile(r"^-----BEGIN [A-Z0-9 ]*PRIVATE KEY")
#: A key up to its sign, the sign, and the value after it (quoted or not).
KEYED = re.compile(r"(?i)(?:%s)[\w.\-\[\]]*[\"'\])]*[ \t]*$" % KEYISH.pattern[4:])
STRONG = re.compile(r"(?i)(?:passw|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|private[_ -]?key|bearer)[\w.\-\[\]]*[\"'\])]*[ \t]*(?:[:=][:=>]*[ \t]*)?(?:(?:bearer|basic|token)[ \t]+)?[\"'`]?$")
SIGN = re.compile(r"[:=][:=>]*[ \t]*|\b[Bb](?:earer|EARER)[ \t]+")
VALUE = re.compile(r"""(?i:(?:bearer|basic|token)[ \t]+)?(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`|["'`]?([^\s"'`][^\s"`]*))""")
PLACEHOLDER = re.compile(r"(?i)^[$<%{\[(]|\(|\b(?:environ|getenv|none|null|nil|true|false|required|optional|string|str|int|bool|undefined)\b|your[_ -]|x{4}|\*{3}|\.{3}|://")
ASSIGNED = re.compile(r"[:=]\s*[\"']?$")
PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk_test_|rk_live_|AIza|eyJ|npm_|pypi-)")
HARMLESS_PATH = re.compile(r"(?i)test|example|sample|doc|fixture|mock|vendor|lock")
#: Common words for the coverage feature; any list can be given.
WORDS = """access account action active address admin agent alert api app archive array asset async audit auth
backup bar base batch block body book bool box buffer build button byte cache call card case cell change char check
child class click client clock close cloud code color column commit common config connect const content control cookie
copy core count create cross current data date debug default delete demo deploy detail device dict dir disk doc
document domain down draft drive driver edit email empty enable end engine entry env error event example exec
export factory fail field file filter find first flag float flow folder font foo form format frame from function
get global group guest handle hash header hello help hidden home host html http icon id image import index info
init input insert install int internal invoice item job join json key label language last layout length level library
license limit line link list load local lock log login logo long main make manager map mark master max media member
memory menu merge message meta method min mock mode model module month mouse move name native net network new next node
note null number object offset old open option order output owner package page panel param parent parse part password
patch path pattern pay phone photo pixel place plan play plugin point policy pool port post press price print private
process product profile project proxy public push put query queue quick random range rate read record red region
release remote remove render report request reset resource response result return role root route row rule run sample
save scale scan schema scope screen script search second secret section secure select send server service session set
shape share shell show side sign simple site size sleep slot small socket sort sound source space split stack stage
start state static status step stop storage store stream string style sub sum super support switch symbol sync system
tab table tag target task team temp template test text theme thread ticket time title token tool top total trace track
transfer tree trigger true type unit update upload url user util valid value vector vendor version video view visible
visit volume wait wall warning watch web week weight width window word work world write year your zone""".split()  # fmt: skip
NAMES = ("length", "digits", "capitals", "signs", "entropy", "transitions", "doubled", "coverage", "hex", "prefix", "keyish", "harmless", "assigned", "harmless_path", "distinct", "quoted", "strong", "blanks", "placeholder", "private", "block")


def coverage(text: str, words: frozenset, longest: int) -> float:
    """The share of letters that a greedy segmentation into dictionary words (3 letters or more) covers."""
    letters = covered = 0
    for run in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()):
        letters += len(run)
        i = 0
        while i < len(run):
            for n in range(min(longest, len(run) - i), 2, -1):
                if run[i : i + n] in words:
                    covered += n
                    i += n
                    break
            else:
                i += 1
    return covered / letters if letters else 0.0


def features(text: str, start: int, end: int, path: str, words: frozenset = frozenset(WORDS)) -> list[float]:
    own = text[start:end]
    n = len(own)
    codes = np.frombuffer(own.encode("latin-1", "replace"), np.uint8)
    counts = np.bincount(codes, minlength=128)
    share = counts[counts > 0] / n
    kind = np.select([(codes >= 48) & (codes <= 57), (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)], [0, 1, 2], 3)
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND // 2]
    near = " ".join(before.split()[-4:])
    return [
        n, float((kind == 0).mean()), float((kind == 1).mean()), float((kind == 3).mean()), float(-(share * np.log2(share)).sum()),
        float((np.diff(kind) != 0).mean()) if n > 1 else 0.0, float((np.diff(codes.astype(np.int16)) == 0).mean()) if n > 1 else 0.0,
        coverage(own, words, 12), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", own))), float(bool(PREFIX.match(own))),
        float(bool(KEYISH.search(near))), float(bool(HARMLESS.search(near + " " + " ".join(after.split()[:2])))), float(bool(ASSIGNED.search(before))),
        float(bool(HARMLESS_PATH.search(path))), len(share) / n,
        float(before[-1:] in ("'", '"', "`") and after[:1] == before[-1:]), float(bool(STRONG.search(before))), float(len(own.split()) - 1), float(bool(PLACEHOLDER.search(own))),
        float(bool(PRIVATE.match(own))), float(own.startswith("-----BEGIN ")),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of runs and of values assigned to keys, in order; they may overlap."""
    blocks = [m.span() for m in BLOCK.finditer(text)]
    found = {m.span() for m in CANDIDATE.finditer(text)}
    for sign in SIGN.finditer(text):
        at = sign.start()
        if text[at] in ":=" and not KEYED.search(text[max(0, at - AROUND) : at]):
            continue
        if value := VALUE.match(text, sign.end()):
            a, b = value.span(value.lastindex)
            if value.lastindex == 4:
                b = a + len(value[4].rstrip(",;.)]}>'") or value[4])
            found.add((a, b))
    if blocks:
        starts = [a for a, _ in blocks]
        within = lambda x: (i := bisect_right(starts, x[1] - 1) - 1) >= 0 and x[0] < blocks[i][1]
        found = {x for x in found if not within(x)} | set(blocks)
    return sorted(found)


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Invented findings, half of them secrets: (text, start, end, path, is_secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = lambda k: " ".join(chars("etaoinshrdlu", int(rng.integers(2, 9))) for _ in range(k))
    letters, signs = alnum[:52], "@!$%.:#&*?-_+~^"
    assigned = ["password = ", "password: ", "passwd=", "pwd: ", "DB_PASSWORD=", "\"password\": ", "secret: ", "client_secret=", "api_key = ", "token: ", "TOKEN=", "Authorization: Bearer "]

    def block(kind: str) -> str:
        lines = "\n".join(chars(alnum + "+/", 64) for _ in range(int(rng.integers(2, 7))))
        return f"-----BEGIN {kind}-----\n{lines}\n-----END {kind}-----"

    def short() -> str:
        """Passwords and the like: short, without digits, or with signs."""
        size = int(rng.integers(6, 16))
        return pick([
            lambda: chars(alnum, size), lambda: pick(WORDS) + str(int(rng.integers(10, 9999))) + chars(letters[26:], int(rng.integers(0, 4))), lambda: chars(letters[26:], size), lambda: chars(letters, size + 8),
            lambda: chars(alnum + signs * 2, size), lambda: chars(alnum, 5) + pick(signs) + chars(alnum + signs, size), lambda: pick(WORDS).title() + pick(signs[:4]) + str(int(rng.integers(9999))) + pick("!.$?"),
            lambda: pick(["-", "", "_", " "]).join(pick(WORDS) for _ in range(4)),
        ])()

    def harmless() -> tuple[str, str]:
        """Values after keys that are none: words of prose, types, placeholders, expressions, numbers."""
        word = lambda: pick([pick(WORDS), pick(WORDS), prose(1)])
        return pick([
            lambda: (pick([word(), word().title()]), pick(["author: ", "Author: ", "Authors: ", "session: ", "Session: ", "private: ", "auth: ", "credentials: "])),
            lambda: (pick(["required", "string", "None", "null", "true", "false", "optional", "str", "undefined"]), pick(assigned)),
            lambda: (pick(["${%s}", "<%s>", "{{ %s }}", "your_%s", "your-%s", "os.environ[%s]", "getenv(%s)", "get_%s()", "$%s", "%%%s%%", "config.get(%s)"]) % pick(["password", "token", "secret", "API_KEY", "DB_PASSWORD", pick(WORDS)]), pick(assigned)),
            lambda: (pick("*x.") * int(rng.integers(3, 12)), pick(assigned)), lambda: (str(int(rng.integers(0, 99))), pick(["session: ", "tokens: ", "max_tokens = ", "token: ", "auth: ", "Session "])),
            lambda: ("https://host.example/" + pick(WORDS), pick(["auth_url = ", "token: ", "session: "])), lambda: ("%d:%02d" % (rng.integers(24), rng.integers(60)), pick(["session: ", "Session: "])),
            lambda: (prose(int(rng.integers(2, 7))), pick(["author: ", "session: ", "private: ", "auth: "])),
        ])()

    def digit_free() -> tuple[str, str]:
        """Runs of MIN_LENGTH or more without digits in prose and code."""
        return pick([
            lambda: (pick("-_=+/") * int(rng.integers(16, 90)), ""), lambda: (pick("_-/").join(pick(WORDS) for _ in range(int(rng.integers(4, 7)))), pick(["", "see ", "path ", "key: ", "open "])),
            lambda: (chars("etaoinshrdlu", int(rng.integers(16, 30))), pick(["", "the ", "die "])), lambda: ("-".join(prose(1) for _ in range(5)), pick(["", "the ", "https://host.example/"])),
            lambda: ("".join(pick(WORDS).title() for _ in range(4)), pick(["class ", "call ", "", "new "])), lambda: ("_".join(pick(["API", "KEY", "TOKEN", "SECRET", pick(WORDS).upper()]) for _ in range(4)), ""),
        ])()

    out = []
    while len(out) < n:
        secret = len(out) % 2
        if secret:
            value = pick([
                lambda: chars(hexes, pick([32, 40, 40, 48, 64])), lambda: "AKIA" + chars(alnum[:26] + "0123456789", 16), lambda: "ghp_" + chars(alnum, 36),
                lambda: "sk_live_" + chars(alnum, 24), lambda: chars(alnum + "+/", 40), lambda: "AIza" + chars(alnum + "-_", 35), lambda: "xoxb-" + chars("0123456789", 11) + "-" + chars(alnum, 24),
                lambda: "eyJ" + base64.urlsafe_b64encode(prose(8).encode()).decode().strip("="), lambda: chars(alnum + "_-", int(rng.integers(18, 44))), *[short] * 6,
                *[lambda: block(pick(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]))] * 3,
            ])()
            # a short value, or one with signs or blanks, is a secret by its key only
            lead = pick(["", "", "see ", "cert: ", "key: ", "private_key = "] if value.startswith("-----") else assigned if not CANDIDATE.fullmatch(value) or not any(c.isdigit() for c in value) else ["token = ", "token: ", "api_key = ", "API_KEY=", "secret: ", "password = ", "Authorization: Bearer ", "access_key = ", "client_secret=", "auth ", "TOKEN = ", "apikey "])
            path = pick(["", "", "src/main.py", "config/settings.yml", "src7", "web", ".env", "tests/data"])
        else:
            value, lead = pick([
                lambda: (chars(hexes, 40), pick(["commit ", "revision ", "at commit ", "merged in "])), lambda: (chars(hexes, pick([32, 64])), pick(["md5: ", "sha256 ", "checksum = ", "digest: ", "etag "])),
                lambda: ("-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), pick(["uuid ", "id: ", "request ", "guid = "])),
                lambda: ("".join(w.title() for w in (pick(WORDS) for _ in range(int(rng.integers(3, 6))))) + str(int(rng.integers(99))), pick(["class ", "call ", "see ", "import "])),
                lambda: ("/".join(pick(WORDS) for _ in range(5)) + "/v" + str(int(rng.integers(9))), pick(["path = ", "open ", "https://host.example/"])),
                lambda: (chars("0123456789", int(rng.integers(16, 22))), pick(["", "order ", "card ", "invoice ", prose(1) + " "])), lambda: ("_".join(pick(WORDS) for _ in range(4)) + "_" + str(int(rng.integers(99))), pick(["", "token = ", "set ", "key: "])),
                lambda: (pick(["x", "0", "1", "a1"]) * 20 + "0", pick(["token = ", "key: ", "password = "])), lambda: ("your_api_key_here_" + str(int(rng.integers(99))), pick(["token = ", "api_key="])),
                lambda: (base64.b64encode(prose(12).encode()).decode().strip("=") + "1", pick(["image ", "src=data:image/png;base64,", "url("])),
                *[harmless, digit_free] * 4, *[lambda: (block(pick(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "PGP SIGNATURE"])), pick(["", "cert: ", "see "]))] * 3,
            ])()
            path = pick(["", "", "README.md", "docs/guide", "tests/data", "src3", "package-lock", "web"])
        quote = "" if value.startswith("-----") else pick(['"', '"', "'", ""]) if secret else pick(['"', "'", "", ""])
        if " " in value and not quote and not value.startswith("-----"):
            quote = '"'
        head = prose(int(rng.integers(0, 7))) + " " + lead + quote
        # every finding stays, whether or not candidates() sees it: what it misses counts as missed
        out.append((head + value + quote + " " + prose(int(rng.integers(0, 7))), len(head), len(head) + len(value), path, secret))
    return out


@dataclass
class Forest:
    """Trees in arrays: at each node a feature (-1: leaf), a threshold, two children and the share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = self.feature[t][at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[t][at]
                at = np.where(inner, np.where(go, self.left[t][at], self.right[t][at]), at)
            total += self.value[t][at]
        return total / len(self.feature)


def train(findings: list[tuple[str, int, int, str, int]], trees: int = 40, depth: int = 10, seed: int = 11) -> Forest:
    """A random forest: bootstrap rows, a random half of the features at each split, Gini impurity."""
    x = np.array([features(*f[:4]) for f in findings])
    y = np.array([f[4] for f in findings], np.float64)
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(trees):
        rows = rng.integers(len(x), size=len(x))
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, nodes: list = nodes) -> int:
            me, share = len(nodes), y[rows].mean()
            nodes.append([-1, 0.0, 0, 0, share])
            if level == depth or len(rows) < 6 or share in (0.0, 1.0):
                return me
            best = (1e-9, -1, 0.0)
            for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
                order = np.argsort(x[rows, f], kind="stable")
                v, z = x[rows, f][order], y[rows][order]
                ones, k = np.cumsum(z)[:-1], np.arange(1, len(v))
                p, q = ones / k, (z.sum() - ones) / (len(v) - k)
                gain = share * (1 - share) - (k * p * (1 - p) + (len(v) - k) * q * (1 - q)) / len(v)
                gain[(v[1:] == v[:-1]) | (k < 2) | (len(v) - k < 2)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    middle = (v[i] + v[i + 1]) / 2  # may round up to v[i + 1], which would leave one side empty
                    best = (gain[i], int(f), middle if middle < v[i + 1] else v[i])
            if best[1] < 0:
                return me
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(rows[low], level + 1)
            nodes[me][3] = grow(rows[~low], level + 1)
            return me

        grow(rows, 0)
        made.append(np.array(nodes))
    size = max(map(len, made))
    all_ = np.zeros((trees, size, 5))
    all_[:, :, 0] = -1
    for t, nodes in enumerate(made):
        all_[t, : len(nodes)] = nodes
    return Forest(all_[:, :, 0].astype(np.int16), all_[:, :, 1], all_[:, :, 2].astype(np.int32), all_[:, :, 3].astype(np.int32), all_[:, :, 4].astype(np.float32))


def judged(texts: list[str | None], paths: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of each text's candidates; secrets that overlap become one with the highest score."""
    spans = [candidates(t or "") for t in texts]
    x = [features(t, a, b, p or "") for t, p, own in zip(texts, paths, spans, strict=True) for a, b in own]
    score = iter(forest.predict(np.array(x)).tolist() if x else [])
    out = []
    for own in spans:
        merged: list[tuple[int, int, float]] = []
        rejected = []
        for a, b in own:
            s = next(score)
            if s < CUT:
                rejected.append((a, b, s))
            elif merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(s, merged[-1][2]))
            else:
                merged.append((a, b, s))
        out.append(sorted(merged + rejected))
    return out


def _shared(spark: SparkSession, forest: Forest):
    """The forest's arrays as a broadcast, of bounded size (trees * 2**depth nodes); executors need no class of ours to read it."""
    return spark.sparkContext.broadcast((forest.feature, forest.threshold, forest.left, forest.right, forest.value))


def _path(docs: DataFrame):
    return F.col("source").cast("string") if "source" in docs.columns else F.lit("")


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, findings array<struct<start, end, score, secret>>: spans of characters of all candidates of every document."""
    shared = _shared(docs.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("secret", pa.string())]))
        for big in batches:
            for b in slices(big):
                texts = b.column(1).to_pylist()
                found = judged(texts, b.column(2).to_pylist(), Forest(*shared.value))
                rows = [[{"start": a, "end": e, "score": s, "secret": t[a:e]} for a, e, s in own] for t, own in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "findings"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _path(docs)).mapInArrow(lean(run), "doc_id long, findings array<struct<start int, end int, score double, secret string>>")


def redact(docs: DataFrame, forest: Forest, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each secret in text replaced; all columns are kept, as they are."""
    shared = _shared(docs.sparkSession, forest)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    at, path = names.index("text"), names.index("source") if "source" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, at):
                texts = b.column(at).to_pylist()
                paths = b.column(path).cast(pa.string()).to_pylist() if path is not None else [""] * len(texts)
                for k, own in enumerate(judged(texts, paths, Forest(*shared.value))):
                    for a, e, s in reversed(own):
                        if s >= CUT:
                            texts[k] = texts[k][:a] + mark + texts[k][e:]
                columns = b.columns
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lean(run), docs.schema)


def default_forest() -> Forest:
    return kept("secret-forest", lambda: train(labelled_findings()))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's candidates and secrets; the digest is over start:end:secret of the secrets."""
    found = scan(table(spark, sf_dir, "documents"), default_forest())
    secrets = F.filter("findings", lambda f: f["score"] >= CUT)
    said = F.transform(secrets, lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"), f["secret"]))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(secrets).cast("long").alias("n_secrets"),
        F.sha2(F.concat_ws(",", said).cast("binary"), 256).alias("secrets_sha256"),
        F.transform(secrets, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))).alias("spans"),
    )


# A trained model has no SQL; tests hold it to held-out findings.
ORACLE_SQL: dict[str, str] = {}
