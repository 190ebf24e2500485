"""Secrets found by an assignment-aware lexer, beside three plain patterns.

The lexer reads source and configuration syntax: a name (bare, quoted or with
dots and dashes), an operator (``=``, ``:``, ``:=``, ``=>``) and a value. Values
are string literals, literals joined by ``+``, bare words, and references to
names (``name``, ``$name``, ``${name}``). References carry the literals last
assigned to that name in the text, so ``k = "..."; password = k`` marks the
literal of the first line. A literal is scored by the most sensitive name that
it reaches and by its own shape (length, kinds of characters, entropy,
placeholders); those at or above THRESHOLD, and random ones under weak names, are spans of kind ``lexed`` unless
a plain span holds them already.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import free, mapped

# The plain patterns, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "lexed")

#: Parts of names that tell how sensitive a value is.
STRONG = {"password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "bearer"}
WEAK = {"key", "auth", "pass", "private", "signature", "session", "cookie", "pin", "salt", "login"}
#: Parts beside which ``pass`` is a password.
USERS = set(
    "user username usr account admin root login db database sql mysql mariadb postgres postgresql pg pgsql oracle mssql jdbc mongo mongodb redis rabbitmq amqp kafka elastic "
    "smtp imap pop mail email ftp sftp ssh ldap http https proxy vpn wifi api aws s3 git docker registry basic service server host client app keystore truststore key store".split()
)
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|change.?me|your.*|example.*|placeholder|todo|none|null|true|false|test|dummy|redacted|<.*>|\$\{.*\}|%\(.*\)s)$")
THRESHOLD = 0.75

_OPERATOR = re.compile(r":=|=>|[:=]")
_STRING = re.compile(r""" *[rbuf]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""", re.IGNORECASE)
_JOIN = re.compile(r"[ \t]*[+.]?[ \t]*(?=[\"'`])")
_REFERENCE = re.compile(r"[ \t]*(?:\$\{([A-Za-z_][\w.]*)\}|\$?([A-Za-z_][\w.]*))[ \t]*(?=$|[\s;,)#}])")
_BARE = re.compile(r"[ \t]*([^\s\"'`,;{}()\[\]<>#$]+)")
_CASES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, leftmost and not overlapping within a kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _name_before(text: str, at: int) -> str:
    """The name that ends before an operator, '' if there is none."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    quote = text[i - 1] if i and text[i - 1] in "\"'" else ""
    i -= len(quote)
    end = i
    while i and text[i - 1] in _NAME:
        i -= 1
    if quote and (not i or text[i - 1] != quote):
        return ""
    return text[i:end].strip(".-")


def sensitivity(name: str) -> float:
    """1 for names of secrets, 0.5 for names that secrets often have, else 0."""
    own = [p.lower() for p in _CASES.findall(name)]
    both = {*own, *(a + b for a, b in zip(own, own[1:]))}
    return 1.0 if both & STRONG or "pass" in own and both & USERS else 0.5 if both & WEAK else 0.0


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    if len(value) < 8 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4) * (0.55 + 0.15 * kinds) if kinds > 1 or n >= 20 else 0.3


def is_random(value: str) -> bool:
    """Whether a literal of two or more kinds of characters is random rather than worded: its characters hardly repeat and their kinds alternate."""
    n = len(value)
    if n < 12 or not literal_score(value):
        return False
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in value]
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return len(set(kinds)) > 1 and entropy >= min(3.5, 0.9 * math.log2(n)) and 4 * sum(a != b for a, b in zip(kinds, kinds[1:])) >= n


def is_secret(weight: float, value: str) -> bool:
    """Under a strong name by the score of the literal, under a weak one by a full score or a random literal."""
    return len(value) >= 8 and (0.5 * weight + 0.5 * literal_score(value) >= THRESHOLD or weight > 0 and is_random(value))


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of literals that reach a sensitive name."""
    known: dict[str, list[tuple[int, int]]] = {}
    reached: dict[tuple[int, int], float] = {}
    for m in _OPERATOR.finditer(text):
        name = _name_before(text, m.start())
        if not name:
            continue
        at, literals = m.end(), []
        while s := _STRING.match(text, at):
            k = s.lastindex
            literals.append((s.start(k), s.end(k)))
            at = j.end() if (j := _JOIN.match(text, s.end())) else s.end()
            if not j:
                break
        if not literals:
            if (r := _REFERENCE.match(text, at)) and (r[1] or r[2]) in known:
                literals = known[r[1] or r[2]]
            elif b := _BARE.match(text, at):
                literals = [(b.start(1), b.end(1))]
        known[name] = literals
        weight = sensitivity(name)
        for span in literals if weight else []:
            reached[span] = max(weight, reached.get(span, 0.0))
    return sorted((a, 3, b) for (a, b), weight in reached.items() if is_secret(weight, text[a:b]))


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """All (start, kind number, end) of a text in code points, by start and kind."""
    if not text:
        return []
    base = plain_spans(text)
    if "=" not in text and ":" not in text:
        return base
    more, i, reach = [], 0, -1  # reach: the furthest end of a plain span that starts no later
    for span in lexed_spans(text):
        while i < len(base) and base[i][0] <= span[0]:
            reach = max(reach, base[i][2])
            i += 1
        if span[2] > reach:
            more.append(span)
    return sorted(base + more)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """Add an array of (kind, start, end) of each whole text; null and empty texts have none.

    Texts are scanned one by one, without a shuffle; repeated rows are scanned
    alike. A column named ``into`` is replaced.
    """

    def make(texts: list) -> list:
        return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts]]

    return mapped(df, text_col, [T.StructField(into, SPAN)], make)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every span of each text, overlapping ones together, by ``mask``; other columns stay."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in spans(text):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return text if not out else "".join(out) + text[at:]

    (into,) = free(df.columns, "_redacted")
    made = mapped(df, text_col, [T.StructField(into, T.StringType())], lambda texts: [[clean(t) for t in texts]])
    return made.select(*(F.col(into).alias(c) if c == text_col else F.col(c) for c in df.columns))


def joined(secrets: str = "secrets", kinds: tuple[str, ...] = KINDS):
    """Column of kind:start:end of the spans of some kinds, comma-joined."""
    held = F.filter(F.col(secrets), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: str, secrets: str = "secrets"):
    return F.size(F.filter(F.col(secrets), lambda s: s["kind"] == kind)).cast("long")
