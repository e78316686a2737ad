"""Secret scans by multipart credential linking.

Strong findings stand alone: assignments to a password-like name, access
identifiers, long hexadecimal runs.  Weak candidates - a bare 40-character key,
a user or client identifier, an endpoint - are parts; an interval join of the
parts of a document within a scope (a block without an empty line, and at most
``reach`` characters between them) reports a part only when what complements it is
near: a bare key beside an identifier, an identifier beside a secret, an
endpoint beside both.  The join walks sorted positions, so a text with many
parts costs no pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
IDENTITY = re.compile(
    r"""\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.ASCII)
BREAK = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "linked_secret", "linked_identity", "linked_endpoint")
ASSIGN_NAMES = ("passw", "secret", "token", "api")
IDENTITY_NAMES = ("user", "login", "client", "account", "access")


def strong(text: str) -> list[tuple[str, int, int]]:
    """The findings that need no other part, for each kind leftmost without overlaps."""
    low = text.lower()
    found = []
    if any(n in low for n in ASSIGN_NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Near:
    """Spans, asked whether one lies at most ``reach`` characters from a span, before or after it, inside its scope.

    Spans hold no line end, so none reaches over a scope's edge: of those that
    begin early enough, the largest end tells.
    """

    def __init__(self, spans: list[tuple[int, int]], reach: int):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.largest_end = list(accumulate((e for _, e in ordered), max))
        self.reach = reach

    def any(self, span: tuple[int, int], scope: tuple[int, int]) -> bool:
        n = bisect_right(self.starts, min(scope[1], span[1] + self.reach))
        return n > 0 and self.largest_end[n - 1] >= max(scope[0] + 1, span[0] - self.reach)


def linked(text: str, found: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """The weak parts that complementary parts in their scope confirm."""
    low = text.lower()
    covered = sorted((s, e) for _, s, e in found)
    begins = [s for s, _ in covered]

    def free(m: re.Match) -> bool:
        i = bisect_left(begins, m.end())
        return not (i and covered[i - 1][1] > m.start())

    keys = [m.span() for m in BARE_KEY.finditer(text) if free(m) and varied(m.group())]
    names = [m.span() for m in IDENTITY.finditer(text) if free(m)] if any(n in low for n in IDENTITY_NAMES) else []
    access = [(s, e) for k, s, e in found if k == "access"]
    secrets = [(s, e) for k, s, e in found if k != "access"]
    if not ((names or access) and (keys or secrets)):
        return []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    breaks = [m.start() for m in BREAK.finditer(text)]

    def scope(span: tuple[int, int]) -> tuple[int, int]:
        i = bisect_right(breaks, span[0])
        return (breaks[i - 1] if i else 0, breaks[i] if i < len(breaks) else len(text))

    identity, secret = Near(names + access, reach), Near(keys + secrets, reach)
    out = [("linked_secret", *x) for x in keys if identity.any(x, scope(x))]
    out += [("linked_identity", *x) for x in names if secret.any(x, scope(x))]
    out += [("linked_endpoint", *x) for x in ends if identity.any(x, y := scope(x)) and secret.any(x, y)]
    return out


def varied(key: str) -> bool:
    """Upper and lower case letters and digits, as a random key has."""
    return bool(re.search("[a-z]", key) and re.search("[A-Z]", key) and re.search("[0-9]", key))


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(text: str | None, reach: int) -> list[dict]:
    if not text:
        return []
    base = strong(text)
    spans = base + linked(text, base, reach)
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def secret_spans(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """docs with ``secrets``: an array of (kind, start, end), code points, end exclusive.

    The spans are ordered by start, then by kind in the order of KINDS.  Null
    and empty texts have an empty array, an empty table gives an empty one.  An old column named secrets is
    replaced; repeated rows stay; whole texts of any length are scanned in
    one pass without a shuffle.
    """

    def compute(texts: list) -> list[pa.Array]:
        return [pa.array([scan(t, reach) for t in texts], ARROW_SPANS)]

    return with_columns(docs, text_col, [T.StructField("secrets", T.ArrayType(SPAN))], compute)


def redact_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by ``mark`` (overlapping spans by one).

    Null and empty texts stay as they are, as do all other columns and their
    order; repeated rows stay repeated; an empty table stays empty, and a text
    of any length is scanned whole, in one task.
    """
    columns = docs.columns

    def compute(texts: list) -> list[pa.Array]:
        out = []
        for text in texts:
            spans = [(x["start"], x["end"]) for x in scan(text, reach)]
            if not spans:
                out.append(text)
                continue
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join(parts) + text[at:])
        return [pa.array(out, pa.string())]

    clean = with_columns(docs, text_col, [T.StructField("__clean_text", T.StringType())], compute)
    return clean.select(*[F.col("__clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])


def span_text(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
