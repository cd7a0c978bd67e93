"""Secrets by regular expressions behind a trigram index.

From each rule's syntax tree follows a Boolean query: trigrams that every match must contain, joined by AND
along a sequence and by OR over alternatives. Every segment of documents (a bounded slice of a task's input)
gets an inverted index of the trigrams that occur in some rule; a rule's query intersects and unites posting
lists, and only the documents left are matched. A rule without mandatory trigrams has every document as a
candidate. Index and search see A-Z as a-z, so a query never excludes a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from monthloom.llm.common import ship, slices, utf8_view

#: Literal strings a part of a rule may stand for, before only its query is kept.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0        # the part whose length counts
    at_least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: Rules that every scan reports, in the order of their kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further public token formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("payment", r"(?:sk|rk)_live_[A-Za-z0-9]+", 0, 24),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]+", 0, 39),
)


# ---- Boolean trigram queries --------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).

def _join(kind: str, parts) -> object:
    flat = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in strings])


def trigram_query(pattern: str) -> object:
    """What the lower-cased text of any match must contain; True if nothing is mandatory."""
    return _Query(pattern).query


class _Query:
    def __init__(self, pattern: str):
        exact, query = self.sequence(_parser.parse(pattern, re.ASCII))
        self.query = query if exact is None else _join("and", [query, _of_strings(exact)])

    def sequence(self, tree) -> tuple[set[str] | None, object]:
        run, query, whole = {""}, True, True
        for kind, value in tree:
            strings, own = self.part(kind, value)
            query = _join("and", [query, own])
            if strings is None or len(run) * len(strings) > MOST_STRINGS:
                query = _join("and", [query, _of_strings(run)])
                run, whole = strings or {""}, False
            else:
                run = {a + b for a in run for b in strings}
        return (run, query) if whole else (None, _join("and", [query, _of_strings(run)]))

    def part(self, kind, value) -> tuple[set[str] | None, object]:
        """All strings a part can be (None: too many), and what every match of it must contain besides."""
        if kind is op.LITERAL:
            return ({chr(value).lower()} if value < 128 else None), True
        if kind is op.IN and all(k is op.LITERAL and v < 128 for k, v in value):
            return {chr(v).lower() for _, v in value}, True
        if kind is op.AT:
            return {""}, True
        if kind is op.SUBPATTERN:
            return self.sequence(value[3])
        if kind is op.BRANCH:
            sides = [self.sequence(side) for side in value[1]]
            if all(s is not None for s, _ in sides):
                return set().union(*[s for s, _ in sides]), True
            return None, _join("or", [q if s is None else _join("and", [q, _of_strings(s)]) for s, q in sides])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            strings, own = self.sequence(inner)
            if low == 0:
                return (strings | {""} if high == 1 and strings is not None else None), True
            if (low, high) == (1, 1):
                return strings, own
            return None, own if strings is None else _join("and", [own, _of_strings(strings)])
        return None, True


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(q) for q in query[1]])


# ---- index of a segment ---------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class TrigramIndex:
    """Postings (ascending document numbers) of the given trigrams in one segment."""

    def __init__(self, trigrams: list[str]):
        self.trigrams = trigrams
        self.number = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
        for i, t in enumerate(trigrams):
            a, b, c = t.encode()
            self.number[a << 16 | b << 8 | c] = i + 1

    def build(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        low = _LOWER[data].astype(np.int32)
        found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, np.uint8)
        at = np.flatnonzero(found)
        document = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[document + 1]
        number, document = found[at][inside].astype(np.int64) - 1, document[inside]
        keys = np.unique(number * len(offsets) + document)
        number, document = keys // len(offsets), keys % len(offsets)
        ends = np.searchsorted(number, np.arange(len(self.trigrams) + 1))
        return {t: document[a:b] for t, a, b in zip(self.trigrams, ends[:-1], ends[1:])}


def candidates(query: object, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    lists = [candidates(q, postings, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    found = lists[0]
    for other in lists[1:]:
        found = np.intersect1d(found, other, assume_unique=True)
    return found


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        patterns = [r.compiled() for r in rules]
        index = TrigramIndex(sorted(set().union(*map(trigrams_of, queries))))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("")
                postings = index.build(*utf8_view(texts))
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for order, (rule, query, pattern) in enumerate(zip(rules, queries, patterns)):
                    for i in candidates(query, postings, part.num_rows).tolist():
                        for m in pattern.finditer(texts[i].as_py()):
                            if len(m[rule.group]) >= rule.at_least:
                                spans[i].append((m.start(), order, m.end()))
                rows = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(found)] for found in spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                keep = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(rows, kind)], [*keep, "secrets"])
    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with ``secrets`` in place of ``text``: every rule's leftmost non-overlapping matches in the
    whole text whose counted part is long enough, by start and then in the order of the rules.

    Offsets are code points, end exclusive. A null or empty text has none. A ``secrets`` column of the input
    is replaced, others pass through; repeated rows are each scanned.
    """
    ship(docs.sparkSession)
    rest = docs.select(*[c for c in docs.columns if c not in ("text", "secrets")], "text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields[:-1])
    return rest.mapInArrow(_scan(rules), fields + "secrets array<struct<kind: string, start: long, end: long>>")
