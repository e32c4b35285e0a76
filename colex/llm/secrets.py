"""Secret scans with multipart credential linking.

Strong patterns (the base) stand alone.  Weak parts (endpoints, account names, opaque
tokens) mean little by themselves and are reported only when parts that complement
each other lie in one scope: a token beside an access id; an endpoint or account beside a
secret; or an account, an endpoint and a token (a hex run counts as one) all together.  That
is an interval join of the parts of a document on [start - scope, end + scope].  All parts of
a document are in its row, so the join is a binary search over the document's parts in order
and needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# The base patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# maximal runs of 24 or more: the same matches as runs of any length, filtered
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ASSIGN_KEYS = ("passw", "secret", "token", "apikey", "api_key")

# Weak parts.  Each becomes a report only with a complement in scope.
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?:\:\d{1,5})?(?![\d.]))")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ACCOUNT_KEYS = ("user", "login", "account")
#: Characters around a part in which its complements lie.
SCOPE = 200

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "linked_endpoint", "linked_account", "linked_secret")
BASE = 3
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping per kind, in code points."""
    found: list[Span] = []
    low = text.lower()
    if any(key in low for key in ASSIGN_KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Parts:
    """Spans (start, end) of one sort, in order, to be joined with intervals."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        #: The greatest end of the spans up to each: whether any of them reaches a place is one look.
        self.reach = list(accumulate((e for _, e in self.spans), max))

    def meet(self, start: int, end: int) -> bool:
        """Whether one of them has a character in common with [start, end], or touches it."""
        i = bisect_right(self.spans, end, key=itemgetter(0))
        return i > 0 and self.reach[i - 1] >= start

    def near(self, others: Parts, scope: int) -> Parts:
        """Those with one of the others in scope."""
        return Parts([(s, e) for s, e in self.spans if others.meet(s - scope, e + scope)] if others.spans else [])


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that have their complements in scope; a part inside a base span is no extra find."""
    low = text.lower()
    assign, access, runs = (Parts([(s, e) for s, k, e in base if k == kind]) for kind in range(BASE))
    named = any(key in low for key in ACCOUNT_KEYS)
    if not (assign.spans or access.spans or named):
        return []
    covered = Parts([(s, e) for s, _, e in base])
    found = lambda pattern: Parts([m.span() for m in pattern.finditer(text) if not covered.meet(m.start() + 1, m.end() - 1)])
    accounts = found(ACCOUNT) if named else Parts([])
    if not (assign.spans or access.spans or accounts.spans):
        return []
    endpoints = found(ENDPOINT)
    tokens = found(OPAQUE) if access.spans or (accounts.spans and endpoints.spans) else Parts([])
    beside = tokens.near(access, scope)
    # three weak parts: the token must be none of the other two
    apart = Parts([(s, e) for s, e in tokens.spans if not (endpoints.meet(s, e) or accounts.meet(s, e))] + runs.spans)
    whole = apart.near(accounts, scope).near(endpoints, scope)
    # an access id alone doesn't make an endpoint a credential; with a secret beside it, it does
    secret = Parts([*assign.spans, *beside.spans, *whole.spans])
    kinds = {
        "linked_endpoint": endpoints.near(secret, scope).spans,
        "linked_account": accounts.near(Parts(assign.spans + whole.spans), scope).spans,
        "linked_secret": {*beside.spans, *whole.spans} - {*runs.spans},
    }
    return [(s, KINDS.index(kind), e) for kind, spans in kinds.items() for s, e in spans]


def spans_of(text: str | None, scope: int = SCOPE) -> list[Span]:
    """All spans of a text, by start, then kind as listed; null is empty."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, scope))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, mask: str = "[SECRET]", scope: int = SCOPE) -> str | None:
    """The text with every span (overlapping ones joined) replaced by a mask."""
    if text is None:
        return None
    out, at = [], 0
    for start, _, end in spans_of(text, scope):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and spans for every row of (doc_id, text).

    One pass without a shuffle, in time linear in a text's length; memory follows one Arrow
    batch.  Null and empty texts have no spans (the SHA-256 is that of the empty string);
    repeated rows give repeated rows, an empty table an empty one.  Spans that start together
    come in the order of KINDS.  Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = spans_of(value.as_py(), scope)
                counts = [sum(k == i for _, k, _ in spans) for i in range(BASE)]
                digest = hashlib.sha256(listed([s for s in spans if s[1] < BASE]).encode()).hexdigest()
                rows.append((*counts, digest, listed(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole documents table."""
    return scan(table(spark, sf_dir, "documents"))
