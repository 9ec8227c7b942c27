"""Secret scan: single patterns and linked parts of multipart credentials.

Base kinds are patterns that stand on their own: ``assign`` (a named assignment),
``access`` (an access identifier of known shape) and ``hex`` (a long hexadecimal run).

Linked kinds are weak alone: ``id`` (an identifier-like name with a value), ``key`` (a
long value of high entropy) and ``host`` (a database or service address). A text is
cut into scopes at blank lines; within a scope the intervals of identifiers, keys and
endpoints are joined when the gap between them is at most ``REACH`` code points, named
assignments in between not counted, so that the parts of a block of settings belong
together however long it is. A weak candidate is reported only when a part of a complementary role lies within reach: a key
needs an identifier or an endpoint, an endpoint or identifier needs a key. Base findings
play their role too (``access`` as an identifier, ``assign`` and ``hex`` as keys).

The join sweeps both sides in order of position, so it is linear in the parts of a text
however many there are, and no pairs are listed.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

#: Kinds in the order of the digest: base ones first.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "id", "key", "host")
#: Code points between the parts of one credential, at most; assignments don't count.
REACH = 200
#: Bits a character that a weak key has at least.
ENTROPY = 3.5

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run shorter than 24 fails as a whole, so asking for 24 finds the same runs.
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID = re.compile(r"""\b(?:client_?id|account_?id|access_?key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,64})""", re.I | re.A)
# An equals sign may stand before a value; behind one it is padding. Possessive: a run is read once.
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
# A name of labels is tried at its start alone and taken whole, so that a text is read once.
_HOST = re.compile(
    r"\b(?:https?|jdbc:[a-z]{1,20}|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp)://[^\s\"'<>]+"
    r"|(?<![\w-])(?<![\w-]\.)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:\d{2,5}\b",
    re.A,
)
_SETTING = re.compile(r"""(?<![\w.-])[\w.-]++["']?[\x20\t]*+[:=][\x20\t]*+(?:"[^"\n]*+"|'[^'\n]*+'|[^\s,;&"']++)[\s,;&"'{}\[\]]*+""", re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The findings of the base kinds, in order of start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _weak_keys(text: str) -> list[Span]:
    out = []
    for m in _KEY.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= ENTROPY:
            out.append(("key", m.start(), m.end()))
    return out


class _Counted:
    """Code points before a place that count as distance: all but those of settings."""

    def __init__(self, text: str):
        self.starts, self.ends, self.before = [], [], [0]
        for m in _SETTING.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.before.append(self.before[-1] + m.end() - m.start())

    def __call__(self, at: int) -> int:
        k = bisect.bisect_right(self.starts, at)  # settings that start before
        return at - self.before[k] + (max(0, self.ends[k - 1] - at) if k else 0)


def _near(spans: list[Span], others: list[Span], scope_of, counted) -> list[Span]:
    """Those of ``spans`` with one of ``others`` in the same scope within reach."""
    by_scope: dict[int, tuple[list[int], list[int]]] = {}
    for _, s, e in sorted(others, key=lambda x: x[1]):
        starts, ends = by_scope.setdefault(scope_of(s), ([], []))
        starts.append(counted(s))
        ends.append(max(counted(e), ends[-1]) if ends else counted(e))  # the farthest end so far
    kept = []
    for kind, s, e in spans:
        starts, ends = by_scope.get(scope_of(s), ((), ()))
        last = bisect.bisect_right(starts, counted(e) + REACH) - 1  # of those that start in reach, the farthest end
        if last >= 0 and ends[last] >= counted(s) - REACH:
            kept.append((kind, s, e))
    return kept


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts co-occur."""
    overlaps = _Covered(base)
    hosts = [("host", m.start(), m.end()) for m in _HOST.finditer(text)] if ":" in text else []
    ids = [("id", m.start(), m.end()) for m in _ID.finditer(text)] if ":" in text or "=" in text else []
    keys = [k for k in _weak_keys(text) if not overlaps(k)] if ids or hosts or any(b[0] == "access" for b in base) else []
    ids = [i for i in ids if not overlaps(i)]
    hosts = [h for h in hosts if not overlaps(h)]
    if not (ids or hosts or keys):
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scope_of = lambda at: bisect.bisect_right(cuts, at)
    strong_keys = [b for b in base if b[0] in ("assign", "hex")]
    as_ids = ids + [b for b in base if b[0] == "access"]
    counted = _Counted(text)
    found = _near(keys, as_ids + hosts, scope_of, counted)
    found += _near(ids + hosts, keys + strong_keys, scope_of, counted)
    return in_order(found)


class _Covered:
    """Whether a span overlaps one of the given."""

    def __init__(self, spans: list[Span]):
        of = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in of]
        self.farthest = list(accumulate((e for _, e in of), max))  # end of the spans up to here

    def __call__(self, span: Span) -> bool:
        at = bisect.bisect_left(self.starts, span[2])
        return at > 0 and self.farthest[at - 1] > span[1]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of overlapping ones, replaced by ``[secret]``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for t in f["text"]:
            base = base_spans(t) if t else []
            every = in_order(base + linked_spans(t, base)) if t else []
            kinds = Counter(s[0] for s in base)
            rows.append((*(kinds[k] for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), redact(t, every) if every else t))
        made = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"], index=f.index)
        yield pd.concat([f.drop(columns=made.columns, errors="ignore"), made], axis=1)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with n_assign, n_access, n_hex, base_sha256, spans and redacted.

    Offsets are code points, ends exclusive. ``redacted`` is the text with every finding
    replaced. Null and empty texts have no findings: counts 0, the hash of the empty
    string, spans ''; a null text stays null. Texts are read whole, in time proportional to
    their length. Repeated rows are scanned alike, an empty table gives an empty result, and
    other columns are carried along; ones named like a result are replaced.
    """
    made = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    kept = docs.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), made])
    return kept.mapInPandas(scan_frames, schema)
