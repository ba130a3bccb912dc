"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed, and a Boolean query over trigrams (of ASCII lower case) is derived from the
tree: parts that match few strings are spelled out and joined with their neighbours, each spelled string asks for all
its trigrams, sequences ask for all of their parts and branches for one. Every text with a match answers it. Every Arrow batch of documents is one index segment, as in code search: one
pass over its bytes builds the postings of the needed trigrams (their number is fixed by the rules),
intersections and unions of postings answer the queries, and only the candidates are run through the regular
expression. A rule without a mandatory trigram scans every text.

Nothing is shuffled; a segment's memory is its texts and their postings. Defined cases: null or empty text has
no spans; repeated rows are scanned each for itself; a text of any length is one document of its segment;
other columns are ignored by `secret_report` and kept by `redact_secrets`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants, _parser  # the standard library's own reading of a pattern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import Batches, as_bytes, carried, retexted, rows_to_batch, slices, texts_in, texts_of


@dataclass(frozen=True)
class Rule:
    """kind, pattern; least: characters of `group`; find: a faster way to the spans of the pattern's matches."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    find: Callable[[str], list[tuple[int, int]]] | None = None


_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++")


def web_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of three parts between dots, the first two from `eyJ` on, each of 8 characters or more (after it).

    The plain pattern scans the rest of a run again at each `eyJ` in it, the square of a long run. Here a maximal run is
    found once and split at its dots: only the first `eyJ` of a part can start its leftmost match.
    """
    found = []
    for run in _DOTTED.finditer(text):
        parts, at, i = run.group().split("."), run.start(), 0
        while i < len(parts) - 2:
            first, second, third = parts[i : i + 3]
            place = first.find("eyJ")
            if 0 <= place <= len(first) - 11 and second.startswith("eyJ") and len(second) >= 11 and len(third) >= 8:
                end = at + len(first) + len(second) + len(third) + 2
                found.append((at + place, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(first) + 1, i + 1
    return found


#: Fixed values of the base kinds, in the order that their spans are listed at one start.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Publicly documented shapes of further credentials.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("model", r"sk-[A-Za-z0-9_-]{32,}"),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", find=web_spans),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


def trigrams(literal: str) -> frozenset[bytes]:
    raw = literal.encode("utf-8", "surrogatepass").lower()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


#: A query is None (every text answers), a set of trigrams (all of them), or ("all" | "any", queries).
Query = frozenset | tuple | None
SPELLED = 64  #: strings that a part of a pattern is spelled out to at most


def all_of(*queries: Query) -> Query:
    own = [q for q in queries if q is not None]
    return None if not own else own[0] if len(own) == 1 else ("all", tuple(own))


def any_of(*queries: Query) -> Query:
    """Alternatives that ask for more than another one add nothing."""
    if None in queries:
        return None
    own = [q for q in dict.fromkeys(queries) if not (isinstance(q, frozenset) and any(isinstance(o, frozenset) and o < q for o in queries))]
    return own[0] if len(own) == 1 else ("any", tuple(own))


def holding(strings: set[str]) -> Query:
    """The query of texts that hold one of the strings; one under three bytes asks for nothing."""
    return any_of(*(trigrams(s) or None for s in sorted(strings)))


def _spelled_class(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is _constants.LITERAL:
            out.add(chr(value))
        elif kind is _constants.RANGE and value[1] - value[0] < SPELLED:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:  # negated, or a category
            return None
    return out if len(out) <= SPELLED else None


def _of_node(kind, value) -> tuple[set[str] | None, Query]:
    """The strings that a node of a parsed pattern matches, if they are few, and else the query of texts with a match."""
    if kind is _constants.LITERAL:
        return {chr(value)}, None
    if kind is _constants.IN:
        return _spelled_class(value), None
    if kind in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):  # no width; asks for nothing
        return {""}, None
    if kind is _constants.SUBPATTERN:
        return _of_sequence(value[-1])
    if kind is _constants.ATOMIC_GROUP:
        return _of_sequence(value)
    if kind is _constants.BRANCH:
        found = [_of_sequence(x) for x in value[1]]
        spelled = set().union(*(x for x, _ in found if x is not None))
        if len(spelled) <= SPELLED and all(x is not None for x, _ in found):
            return spelled, None
        return None, any_of(*(q if x is None else holding(x) for x, q in found))
    if kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT):
        low, high, inner = value
        own, query = _of_sequence(inner)
        if own is not None and high <= SPELLED and sum(len(own) ** k for k in range(low, high + 1)) <= SPELLED:
            return {"".join(x) for k in range(low, high + 1) for x in product(own, repeat=k)}, None
        return None, None if not low else query if own is None else holding(own)
    return None, None


def _of_sequence(nodes) -> tuple[set[str] | None, Query]:
    """As `_of_node`, for nodes in a row: spelled neighbours are joined, so that trigrams run across them."""
    strings, query, whole = {""}, None, True
    for kind, value in nodes:
        own, needed = _of_node(kind, value)
        if own is not None and len(strings) * len(own) <= SPELLED:
            strings = {a + b for a in strings for b in own}
            continue
        query, whole = all_of(query, holding(strings), needed), False
        strings = {""} if own is None else own
    return (strings, None) if whole else (None, all_of(query, holding(strings)))


def query_of(rule: Rule) -> Query:
    """The query that every text with a match of the rule answers; None: the rule scans fully."""
    strings, query = _of_sequence(_parser.parse(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)))
    return query if strings is None else holding(strings)


def asked_trigrams(query: Query) -> frozenset[bytes]:
    if query is None:
        return frozenset()
    return query if isinstance(query, frozenset) else frozenset().union(*map(asked_trigrams, query[1]))


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]):
    """Patterns, queries, and a table from a trigram's 24 bits to its number (from 1)."""
    queries = [query_of(r) for r in rules]
    needed = sorted(frozenset().union(*map(asked_trigrams, queries)))
    number = np.zeros(1 << 24, dtype=np.uint8 if len(needed) < 255 else np.uint16)
    for k, t in enumerate(needed, 1):
        number[int.from_bytes(t, "big")] = k
    patterns = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
    return patterns, queries, number, {t: k for k, t in enumerate(needed, 1)}


def postings(raw: np.ndarray, at: np.ndarray, number: np.ndarray) -> dict[int, np.ndarray]:
    """Trigram number -> sorted rows that hold it. Trigrams do not cross rows."""
    if len(raw) < 3:
        return {}
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    hit = number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    where = np.flatnonzero(hit)
    rows = np.searchsorted(at, where, side="right") - 1
    inside = where + 3 <= at[rows + 1]
    pairs = np.unique(hit[where[inside]].astype(np.int64) * (1 << 32) + rows[inside])
    kinds = pairs >> 32
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    return {int(k[0]): r for k, r in zip(np.split(kinds, cuts), np.split(pairs & 0xFFFFFFFF, cuts), strict=True) if len(k)}


def candidates(query: frozenset | tuple, lists: dict[int, np.ndarray], numbers: dict[bytes, int]) -> np.ndarray:
    """Rows that answer the query: unions and intersections of postings, shortest list first."""
    none = np.empty(0, np.int64)
    if isinstance(query, frozenset):
        own = [lists.get(numbers[t], none) for t in query]
    else:
        own = [candidates(q, lists, numbers) for q in query[1]]
        if query[0] == "any":
            return np.unique(np.concatenate(own))
    own.sort(key=len)
    rows = own[0]
    for other in own[1:]:
        if not len(rows):
            break
        rows = np.intersect1d(rows, other, assume_unique=True)
    return rows


def spans_of(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, less those whose group is too short."""
    if rule.find is not None:
        return rule.find(text)
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def segment_spans(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each row of a segment (start, place of the rule in rules, end), sorted."""
    patterns, queries, number, numbers = _compiled(rules)
    texts = texts_of(column)
    lists = postings(*as_bytes(column), number)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
        for i in range(len(texts)) if query is None else candidates(query, lists, numbers).tolist():
            found[i] += [(a, k, b) for a, b in spans_of(rule, pattern, texts[i])]
    for x in found:
        x.sort()
    return found


def join_spans(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _report(batches: Batches) -> Batches:
    n = len(BASE_RULES)
    for b in slices(batches):
        found = segment_spans(b.column("text"))
        counts = [[sum(k == kind for _, k, _ in x) for x in found] for kind in range(n)]
        base = [hashlib.sha256(join_spans([s for s in x if s[1] < n], RULES).encode()).hexdigest() for x in found]
        yield rows_to_batch(_REPORT, [b.column("doc_id").cast(pa.int64()), *counts, base, [join_spans(x, RULES) for x in found]])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of docs."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """Each maximal run of overlapping spans becomes the marker of its first kind."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"[{rules[k].kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets of every text replaced by markers, and n_chars (where it is a column) made to fit; null stays null."""

    def clean(batches: Batches) -> Batches:
        for b in slices(batches):
            column = texts_in(b)
            yield retexted(b, [t and redact(t, x) for t, x in zip(column.to_pylist(), segment_spans(column), strict=True)])

    return carried(docs).mapInArrow(clean, docs.schema)
