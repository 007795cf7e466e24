"""Secrets in text: fixed patterns, and values in credential contexts that would take many guesses.

The number of guesses is that of the cheapest way to cut a value into dictionary words, dates, repeats, keyboard walks and
brute-force spans, found by dynamic programming over its places. Costs are logarithms to base 10 and add up.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from math import inf, log10

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .arrow import with_python_columns

# The base patterns, and the least length of what they must match (of the second group for ``assign``).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f] of 32 and more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Words before a value that make it a credential, where a colon or equals sign (or a scheme's name) stands between.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?[\x20\x09]*[:=]{1,2}[\x20\x09]*["']?|\bbearer\x20+|://[^\s:/@]+:(?=[^\s:/@]+@))([^\s"'<>]+)""",
    re.IGNORECASE | re.ASCII,
)
#: One of these is in every text that has a context or an assignment.
HINTS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "://")
#: Punctuation that ends a sentence rather than a value.
TRAILING = ".,;:!?)]}"
#: Values that take 10 to this power of guesses or more are secrets.
LEAST_LOG10 = 10.0

# Keys by row of a common keyboard.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# Passwords that are tried first, in that order.
COMMON = "password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein shadow master 696969 michael mustang 666666 qwertyuiop 123321 1234567890 superman 654321 trustno1 iloveyou welcome admin login changeme secret root guest default test hunter passw0rd".split()
# Letters as they are disguised.
DISGUISES = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
#: A repeated unit has up to so many characters, and a walk or run; longer ones are made of several.
LONGEST_UNIT, LONGEST_RUN = 8, 64
DATE = re.compile(r"(?:(?:19|20)\d\d)(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")
DIGIT, LETTER, SIGN = log10(10), log10(26), log10(33)
TWO = log10(2)


@lru_cache(maxsize=4)
def dictionary(path: str) -> dict[str, float]:
    """Words and the logarithms of their ranks: common passwords first, then whole words of a public tokenizer in the order of its ids."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>")]
    ranked = dict.fromkeys([*COMMON, *(w for w in words if len(w) > 2 and w.isalpha())])
    return {w: log10(i + 1) for i, w in enumerate(ranked)}


@lru_cache(maxsize=1)
def adjacent() -> dict[str, frozenset[str]]:
    """The keys beside each key: in its row, and in the rows above and below it."""
    place = {key: (row, at) for row, keys in enumerate(KEY_ROWS) for at, key in enumerate(keys)}
    return {k: frozenset(o for o, (r, a) in place.items() if o != k and abs(r - row) <= 1 and -1 <= (a - at) + (r - row) * 0.5 <= 1) for k, (row, at) in place.items()}


def character(c: str) -> float:
    return DIGIT if c.isdigit() else LETTER if c.isalpha() else SIGN


def words_at(value: str, plain: str, at: int, known: dict[str, float], longest: int):
    """(end, cost) of dictionary words that begin here, in any case and with disguised letters."""
    spelled, changed, capitals = "", 0, 0
    for end in range(at, min(len(value), at + longest)):
        letter = plain[end]
        changed += letter in DISGUISES
        capitals += value[end] != letter
        spelled += DISGUISES.get(letter, letter)
        whole = plain[at : end + 1]
        for word, extra in ((whole, 0.0), (spelled, changed * TWO)) if changed else ((whole, 0.0),):
            if word in known:
                upper = 0.0 if not capitals else TWO if capitals in (1, end + 1 - at) else capitals * TWO
                yield end + 1, known[word] + extra + upper


def walks_at(plain: str, at: int):
    """(end, turns) of runs of neighbouring keys that begin here, up to LONGEST_RUN of them."""
    beside, turns, last = adjacent(), 0, None
    for end in range(at + 1, min(len(plain), at + LONGEST_RUN)):
        here, there = plain[end - 1], plain[end]
        if there not in beside.get(here, ()):
            return
        way = next((row.index(there) - row.index(here) for row in KEY_ROWS if here in row and there in row), 0)
        turns, last = turns + (way != last), way
        yield end + 1, turns


def runs_at(plain: str, at: int):
    """Ends of runs of characters each one above (or each one below) the one before, up to LONGEST_RUN of them."""
    step = ord(plain[at + 1]) - ord(plain[at]) if at + 1 < len(plain) else 0
    if step in (1, -1):
        for end in range(at + 1, min(len(plain), at + LONGEST_RUN)):
            if ord(plain[end]) - ord(plain[end - 1]) != step:
                return
            yield end + 1


def log10_guesses(value: str, known: dict[str, float], longest: int | None = None) -> float:
    """The least sum of costs over all ways to cut the value into spans; 0 for an empty value.

    Every place is reached from every place before it by the cheapest span between them: a character tried by brute
    force, a word, a date, a run of neighbouring keys or of successive characters, or repeats of what stands before it.
    """
    longest = longest or max(map(len, known), default=0)
    plain = value.lower() if len(value.lower()) == len(value) else value
    n = len(value)
    best = [0.0] + [inf] * n

    def reach(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for at in range(n):
        here = best[at]
        reach(at + 1, here + character(value[at]))
        for end, cost in words_at(value, plain, at, known, longest):
            reach(end, here + cost)
        date = DATE.match(value, at)
        if date:
            for end in (at + 4, date.end()) if value[at : at + 2] in ("19", "20") else (date.end(),):
                size = end - at
                reach(end, here + log10(200 if size == 4 and value[at:end].isdigit() else 200 * 365) + (TWO * 2 if not value[at:end].isdigit() else 0.0))
        for end, turns in walks_at(plain, at):
            if end - at > 2:
                reach(end, here + log10(47) + log10(end - at) + turns * log10(4))
        for end in runs_at(plain, at):
            if end - at > 2:
                reach(end, here + log10(26) + log10(end - at) + TWO)
        for unit in range(1, min(LONGEST_UNIT, at) + 1):
            before = value[at - unit : at]
            if at >= 2 * unit and value.startswith(before, at - 2 * unit):
                continue  # within repeats that began further left, which is never dearer
            times, end = 1, at
            while value.startswith(before, end):
                times, end = times + 1, end + unit
                reach(end, here + log10(times))
    return best[n]


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("log10_guesses", DoubleType())])
KINDS = ("assign", "access", "hex", "guess")


def base_spans(text: str, hinted: bool) -> list[tuple[str, int, int, float | None]]:
    """What the three patterns find, each from the left without overlaps; matches that are too short count for nothing but their place."""
    found = []
    if hinted:
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]


def credential_values(text: str) -> list[tuple[int, int]]:
    """Where values in credential contexts lie, without what ends a sentence behind them."""
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        if m[0].startswith("://"):
            end = text.index("@", start)
        while end > start and text[end - 1] in TRAILING:
            end -= 1
        if end > start:
            found.append((start, end))
    return found


def spans_of(text: str, known: dict[str, float], longest: int, least: float) -> list[dict]:
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    found = base_spans(text, hinted)
    if hinted:
        for start, end in credential_values(text):
            cost = log10_guesses(text[start:end], known, longest)
            if cost >= least:
                found.append(("guess", start, end, cost))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [dict(zip(SPAN.names, s, strict=True)) for s in found]


def find_secrets(docs: DataFrame, column: str = "text", vocabulary: str | None = None, least: float = LEAST_LOG10) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end, log10_guesses) by start and then kind; places are code points, ends exclusive.

    Kinds are ``assign``, ``access`` and ``hex`` of the fixed patterns, and ``guess`` for a value in a credential context
    that takes 10 to the power ``least`` of guesses or more, also where a pattern has found it. Null and empty texts have
    none. Repeated rows are scanned alike. A column named ``secrets`` is replaced, all others are kept. ``vocabulary`` is
    a tokenizer file whose whole words are the dictionary; executors must have it at the same path.
    """
    if vocabulary is None:
        from public_tokenizers import path

        vocabulary = path("word_bpe_49k.json")

    def make(texts: list[str | None]) -> list[list]:
        known = dictionary(vocabulary)
        longest = max(map(len, known))
        return [[spans_of(t or "", known, longest, least) for t in texts]]

    return with_python_columns(docs, [column], StructType([StructField("secrets", ArrayType(SPAN))]), make)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document as counts, a digest of the fixed patterns' spans and the list of all spans; nulls and empty texts have none."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(of("guess")).cast("long").alias("n_guess"),
        F.array_max(F.transform("secrets", lambda s: s["log10_guesses"])).alias("most_log10_guesses"),
    )
