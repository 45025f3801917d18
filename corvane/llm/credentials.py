"""Credentials embedded in code, configuration and prose (problem 3).

A keyword automaton marks the lines that can hold one. On these, formats of known issuers are
matched with their structure checked, and values are read where a name, a header or a sentence says
that a credential follows. What is found can be replaced by a placeholder of the same length and
alphabet, so that the surrounding code keeps its form.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest_rows, spread

# What the automaton looks for, in lower case.
KEYWORDS = (
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "sk_live_", "rk_live_",
    "aiza", "npm_", "eyj", "pypi-", "sg.", "hf_", "dop_v1_", "shpat_", "private key", "://", "authorization", "bearer", "basic ",
    "password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "api_key", "apikey", "api-key", "api key", "access_key", "accesskey", "access key",
    "encryption_key", "encryptionkey", "encryption key", "signing_key", "signingkey", "signing key", "private_key", "privatekey", "auth_key", "authkey", "credential", "login", "log in", "pw ",
    "key ", "key:", "key=", "use this for", "sk-",
)

# Formats of issuers.
ISSUERS = (
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("git_token", r"(?<![A-Za-z0-9])gh[opusr]_[A-Za-z0-9]{36,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{40,}"),
    ("lab_token", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}"),
    ("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{12,}"),
    ("payment_key", r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}"),
    ("cloud_key", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9])"),
    ("package_token", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])|(?<![A-Za-z0-9])pypi-[A-Za-z0-9_-]{40,}"),
    ("mail_key", r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    ("model_token", r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}"),
    ("host_token", r"(?<![A-Za-z0-9])(?:dop_v1_[0-9a-f]{64}|shpat_[0-9a-f]{32})(?![A-Za-z0-9])"),
    ("model_key", r"(?<![A-Za-z0-9])sk-(?:[a-z]{2,8}\d{0,2}-)*[A-Za-z0-9_]{20,}(?![A-Za-z0-9])"),
    ("web_token", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{16,}"),
)
CHECKED = re.compile(r"(?:gh[opusr]|npm)_(?P<body>[A-Za-z0-9]{30})(?P<sum>[A-Za-z0-9]{6})")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
BLOCK_LINE = re.compile(r"\n[ \t\"'+#/*]*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]+={1,2})[ \t\"'+,;\\n]*(?=\n|\Z)")
ISSUED = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in ISSUERS))

NOUN = r"(?:password|passwd|passphrase|pwd|smtp_?pass|db_?pass|user_?pass|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|private[_-]?key|auth[_-]?key|credential)s?"
# A name is only tried at the start of its run of name characters, however long the run is.
NAME = rf"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*{NOUN}\d*"
#: A name, perhaps with a type, then an assigned string literal or (in configuration) a bare word.
ASSIGNED = re.compile(rf"(?i)({NAME})[\"']?\]?\s*(?::\s*[&'\w<>\[\]\. ]{{1,24}}?\s*=|:=|=>|={{1,3}}(?!=)|:(?!:)|\bis\b|\bwas\b)\s*(?:[rbuf]{{1,2}}(?=[\"'])|String::from\(|std::string\()?(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)")
BARE = re.compile(rf"(?i)({NAME})[\"']?\s*(?:=|:)\s*(?P<v>[^\s\"'`,;(){{}}\[\]<>]+)(?=\s*(?:$|[,;#\"'`}}\])&]|\s))")
PASSED = re.compile(rf"(?i)[\"'](?:{NAME})[\"']\s*,\s*(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)")
HEADER = re.compile(r"(?i)authorization[\"']?\s*(?:,|:|=|=>)\s*[\"'`]?\s*(?:bearer|basic|token|apikey)\s+(?P<v>[A-Za-z0-9+/=_.~-]{8,})|\bbearer\s+(?P<w>[A-Za-z0-9+/=_.~-]{16,})")
URL = re.compile(r"(?<![a-zA-Z0-9+.-])[a-zA-Z][a-zA-Z0-9+.-]{0,30}://[^\s/:@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@[^\s/\"'`<>]+")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Prose and comments that hand a credential over without a name before an equals sign.
SAID = re.compile(
    r"(?i)(?:\blog ?in with \S+ ?/ ?|\b(?:old|new|current|real|live|prod|staging)?\s*(?:key|token|password|secret|pw|pwd|login|credentials?|passphrase)\s*(?:was|is|=|:)?\s+|\buse this for \w+:?\s+)[\"'`]?(?P<v>[^\s\"'`,;<>]{8,})"
)
JOINED = re.compile(r"([\"'`])\s*(?:\+|\.\.?|<>|\s)\s*\1")
MASKED = re.compile(r"(?i)^(.)\1*$|^[*x.•#_-]+$")
PLACE = re.compile(r"(?i)^<.*>$|^\$|\{\{|^\$?\{|^%.*%$|^\[.*\]$|your[_-]?|redact|placeholder|change[_-]?me|replace[_-]?me|example|dummy|sample|insert|todo|fixme|^(?:none|null|nil|undefined|true|false|test|secret|password|token|string|str)$|^(?:os|process|env|std|system|config|settings)[.:]")
LABEL = re.compile(r"(?i)(?:label|hint|text|title|message|prompt|field|placeholder|error|name|path|file|url|uri|type|format|regex|pattern|length|count|limit|max|min|public|policy|rule|header|prefix|suffix|index|id|hash|digest|checksum)s?\d*$")
PUBLICISH = re.compile(r"(?i)^(?:sha\d+|md5)[:-]|^data:|^ssh-(?:rsa|ed25519)|-----BEGIN|^https?://|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word in KEYWORDS:
        words.add_word(word, word)
    words.make_automaton()
    return words


def entropy(value: str) -> float:
    """Bits per character of the value's own characters."""
    counts, n = Counter(value), len(value)
    return -sum(k / n * math.log2(k / n) for k in counts.values())


def _usable(value: str, bare: bool) -> bool:
    """Whether a value that stands where a credential stands can be one."""
    if len(value) < 6 or re.search(r"\s", value) or MASKED.search(value) or PLACE.search(value) or PUBLICISH.search(value):
        return False
    if bare and re.fullmatch(r"[A-Za-z_]\w*(?:(?:\.|::|->)\w+)+|[A-Za-z_]+|\d+(?:\.\d+)?|[A-Za-z_]\w*\(.*", value):
        return False
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    letters = re.sub(r"[^A-Za-z]", "", value)
    if re.search(r"[0-9]", value) and letters or kinds >= 3:
        return entropy(value) >= 2.3
    return len(value) >= 16 and kinds >= 2 and re.search(r"[a-z][A-Z]", value) is not None and entropy(value) >= 3.3 and not re.fullmatch(r"[A-Za-z][a-z]+(?:[A-Z_-][a-z]+)+", value)


def _random(value: str) -> bool:
    """Whether a bare word of a sentence is random enough to be a credential."""
    value = value.rstrip(".")
    if not _usable(value, True) or "/" in value and re.fullmatch(r"[\w./-]*\.[a-z]{1,4}|(?:[\w-]+/)+[\w-]+", value) and entropy(value) < 4:
        return False
    if re.fullmatch(r"[A-Za-z][a-z]+[!@#$%^&*?+=_.-]\w{5,}", value) and sum(c.isdigit() for c in value) >= 3 and not re.fullmatch(r"[a-z]+[_.-]\w+", value):
        return True
    digits = sum(c.isdigit() for c in value)
    if re.fullmatch(r"[0-9a-f]{32,}", value):
        return True
    return digits >= 1 and len(value) >= 12 and entropy(value) >= 3.2 and re.search(r"[A-Z]", value) is not None and re.search(r"[a-z]", value) is not None and "(" not in value


def _decodes(kind: str, value: str) -> bool:
    """The structure of a match, where its format has one that can be checked."""
    if kind == "web_token":
        head = value.split(".")[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except (ValueError, binascii.Error):
            return False
    body = re.sub(r"^[A-Za-z0-9]+[_-]", "", value)
    return not MASKED.search(body) and not re.search(r"(?i)example|xxxx|\*{3}", value) and entropy(body) >= 2.5


def checksum(kind: str, value: str) -> bool | None:
    """Whether the last six characters of an issuer's token are its checksum (CRC-32 of the part
    before them, in base 62); None where the format has none. It is reported and doesn't decide:
    a token copied with an error, or made up, still has to be redacted."""
    m = CHECKED.fullmatch(value) if kind in ("git_token", "package_token") else None
    if not m:
        return None
    left, digits = zlib.crc32(m["body"].encode()), ""
    while left:
        left, k = divmod(left, 62)
        digits = BASE62[k] + digits
    return digits.rjust(6, "0") == m["sum"]


def _unjoined(line: str) -> tuple[str, list[int]]:
    """The line with adjacent literals of a concatenation joined, and each character's place."""
    if not JOINED.search(line):
        return line, list(range(len(line)))
    out, at, last = [], [], 0
    for m in JOINED.finditer(line):
        if not re.search(r"[+.]|<>", m.group(0)) and not re.search(r"\w$", line[: m.start()]):
            continue
        out.append(line[last : m.start()])
        at += range(last, m.start())
        last = m.end()
    out.append(line[last:])
    at += range(last, len(line))
    return "".join(out), at


def in_line(line: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the credentials of one line, in order and without overlap."""
    text, at = _unjoined(line)
    found: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        if all(b <= c or a >= d for _, c, d in found):
            found.append((kind, a, b))

    if "-----BEGIN" in text:
        for m in PRIVATE.finditer(text):
            take("private_key", m.start(), m.end())
        if not found:
            return []
        return [(k, at[a], at[b - 1] + 1) for k, a, b in found]
    for m in ISSUED.finditer(text):
        if _decodes(m.lastgroup, m.group(0)):
            take(m.lastgroup, m.start(), m.end())
    for m in URL.finditer(text):
        if _usable(m["v"], False):
            take("url_login", m.start("v"), m.end("v"))
    for m in HEADER.finditer(text):
        g = "v" if m["v"] else "w"
        if _usable(m[g], False):
            take("header", m.start(g), m.end(g))
    for m in ASSIGNED.finditer(text):
        inner = re.fullmatch(rf"(?i){NAME}=(?P<v>\S+)", m["v"])
        if not LABEL.search(m[1]) and not inner and _usable(m["v"], False):
            take("assigned", m.start("v"), m.end("v"))
    for m in PASSED.finditer(text):
        if _usable(m["v"], False):
            take("passed", m.start("v"), m.end("v"))
    for m in BARE.finditer(text):
        if not LABEL.search(m[1]) and _usable(m["v"], text[m.start() - 1 : m.start()] not in ("'", '"', "`")):
            take("assigned", m.start("v"), m.end("v"))
    for m in SAID.finditer(text):
        if _random(m["v"]):
            take("said", m.start("v"), m.start("v") + len(m["v"].rstrip(".")))
    return sorted((k, at[a], at[b - 1] + 1) for k, a, b in found)


def find(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, line number from 1, start, end) of all credentials; start and end count characters of
    the text. A private key reaches to its END line or, without one, over its lines of base64."""
    marked: set[int] = set()
    last = -1
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for end, _ in _automaton().iter(lowered):
        if end >= last:
            a = text.rfind("\n", 0, end) + 1
            b = text.find("\n", end)
            last = len(text) if b < 0 else b
            marked.add(a)
    out = []
    for a in sorted(marked):
        b = text.find("\n", a)
        line = text[a : len(text) if b < 0 else b]
        found = in_line(line)
        if found:
            number = text.count("\n", 0, a) + 1
            for kind, s, e in found:
                start, stop = a + s, a + e
                if kind == "private_key":
                    close = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----").search(text, stop)
                    if close:
                        stop = close.end()
                    while not close and (m := BLOCK_LINE.match(text, stop)):
                        stop = m.end()
                out.append((kind, number, start, stop))
    return out


def placeholder(value: str, base64_only: bool = False) -> str:
    """Same length and alphabet: hexadecimal stays hexadecimal, base32 stays base32, else, and in key
    blocks, letters become x or X and digits 0; everything else stays. The lines around a key block
    stay too."""
    if value.startswith("-----BEGIN"):
        parts = re.split(r"(-----(?:BEGIN|END)[A-Z0-9 ]*-----|\\n)", value)
        return "".join(p if k % 2 else placeholder(p, True) for k, p in enumerate(parts))
    shown = re.sub(r"[^A-Za-z0-9]", "", value)
    lower, upper, digit = "x", "X", "0"
    if base64_only:
        pass
    elif re.fullmatch(r"[0-9a-fA-F]*", shown):
        lower, upper = "a", "A"
    elif re.fullmatch(r"[A-Z2-7]*", shown):
        digit = "2"
    return re.sub(r"[0-9]", digit, re.sub(r"[A-Z]", upper, re.sub(r"[a-z]", lower, value)))


def redact(text: str) -> str:
    """The text with only the credentials replaced."""
    out, last = [], 0
    for _, _, a, b in find(text):
        if a >= last:
            out += [text[last:a], placeholder(text[a:b])]
            last = b
    return "".join([*out, text[last:]])


def credentials(df: DataFrame, key: str, text: str, when: str | None = None) -> DataFrame:
    """(key, line_no, kind, start, end, checksum) of every credential in every text.

    Null keys and texts give no row, empty texts none either. A key that comes several times counts
    once, with its latest text. Other columns are ignored. Texts are scanned whole; only the places
    are shuffled, never the texts.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(when) if when else F.lit(None).cast("timestamp")).alias("at")).where("key is not null and text is not null")
    rows = spread(rows)
    key_type = rows.schema["key"].dataType.simpleString()
    place = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("checksum", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"line_no": n, "kind": k, "start": a, "end": b, "checksum": checksum(k, t[a:b])} for k, n, a, b in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, place)], ["key", "at", "found"])

    scanned = rows.mapInArrow(scan, f"key {key_type}, at timestamp, found array<struct<line_no:bigint,kind:string,start:int,end:int,checksum:boolean>>")
    # Texts without a credential take part too: a later delivery may have lost it.
    once = scanned.groupBy("key").agg(F.max_by("found", F.coalesce("at", F.lit("1900-01-01").cast("timestamp"))).alias("found"))
    return once.select(F.col("key").alias(key), F.inline("found"))


def redacted(df: DataFrame, key: str, text: str, when: str | None = None) -> DataFrame:
    """(key, text) of all rows, with credentials replaced; null texts stay null. With `when`, each key
    comes once, with its latest text, and null keys are left out; else every row comes out."""
    rows = (latest_rows(df, key, when) if when else df).select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if t is None else redact(t) for t in batch.column(1).to_pylist()], pa.string())], ["key", "text"])

    return rows.mapInArrow(scrub, f"key {key_type}, text string").toDF(key, text)
