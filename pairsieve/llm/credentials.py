"""Secret scans: rules as regular expressions, found through a trigram inverted index over segments of documents."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import column_of, keyed_text, map_texts, pieces_of


class Rule(NamedTuple):
    """A kind of secret. Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` go.

    Letters match in either case with ``any_case`` (A-Z only). ``base`` marks the kinds of the base list.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = False


#: Fixed values of the base list. A run of one class is matched from its length on; shorter runs would be dropped anyway.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        any_case=True,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", least=16, base=True),
)
#: Further kinds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -----------------------------------------------------------------------------------------

#: A query is True (every text may match), a trigram, or ("and" | "or", parts). Trigrams have A-Z in lower case.
Query = bool | str | tuple

#: Alternatives that are spelled out before a part of a pattern counts as anything.
SPELLED = 64


def _and(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def _or(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _trigrams(text: str) -> Query:
    data = text.encode()
    return _and(data[i : i + 3].decode("latin-1") for i in range(len(data) - 2))


def _spelled(texts: set[str]) -> Query:
    return _or(map(_trigrams, sorted(texts)))


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _sequence(items, any_case: bool) -> tuple[set[str] | None, Query]:
    """What a pattern must contain: either all its texts, if few, or a query over what its parts must contain."""
    texts: set[str] = {""}
    asked: list[Query] = []
    whole = True
    for item in items:
        more, query = _item(item, any_case)
        if more is not None and len(texts) * len(more) <= SPELLED:
            texts = {a + b for a, b in itertools.product(texts, more)}
            continue
        asked.append(_spelled(texts))
        whole = False
        if more is not None:
            texts = more
        else:
            asked.append(query)
            texts = {""}
    return (texts, True) if whole else (None, _and([*asked, _spelled(texts)]))


def _item(item, any_case: bool) -> tuple[set[str] | None, Query]:
    kind, value = item
    if kind is op.LITERAL:
        return {_lower(chr(value))}, True
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return {_lower(chr(v)) for _, v in value}, True
    if kind is op.SUBPATTERN:
        return _sequence(value[3], any_case)
    if kind is op.BRANCH:
        found = [_sequence(branch, any_case) for branch in value[1]]
        if all(t is not None for t, _ in found):
            texts = set().union(*(t for t, _ in found))
            if len(texts) <= SPELLED:
                return texts, True
        return None, _or(_spelled(t) if t is not None else q for t, q in found)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = value
        texts, query = _sequence(body, any_case)
        if least == 0:
            return ({"", *texts}, True) if most == 1 and texts is not None and len(texts) < SPELLED else (None, True)
        if texts is not None and least == most == 1:
            return texts, True
        return None, _spelled(texts) if texts is not None else query
    if kind is op.AT:
        return {""}, True
    return None, True


@lru_cache(maxsize=256)
def trigram_query(pattern: str, any_case: bool = False) -> Query:
    """What a text must contain, as a Boolean query over trigrams of its bytes with A-Z in lower case."""
    texts, query = _sequence(parser.parse(pattern), any_case)
    return _spelled(texts) if texts is not None else query


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams_of, query[1:])) if isinstance(query, tuple) else set()


# --- The index of one segment -----------------------------------------------------------------------------------------

#: Bytes of a segment that are coded at once.
BLOCK = 1 << 20


class SegmentIndex:
    """Postings of a segment of documents: for each trigram that some rule asks for, which documents contain it."""

    def __init__(self, texts: list[str], trigrams: Sequence[str]):
        self.size = len(texts)
        place = _places(tuple(trigrams))
        raw = [t.encode().lower() for t in texts]  # bytes.lower changes A-Z only
        ends = np.cumsum([len(r) + 3 for r in raw])
        data = b"\0\0\0".join(raw) + b"\0\0\0" if raw else b""
        codes = np.frombuffer(data, np.uint8)
        found = []
        for begin in range(0, max(0, len(codes) - 2), BLOCK):
            block = codes[begin : begin + BLOCK + 2].astype(np.int32)
            hit = place[(block[:-2] << 16) | (block[1:-1] << 8) | block[2:]]
            at = np.flatnonzero(hit)
            if len(at):
                found.append(hit[at].astype(np.int64) * self.size + np.searchsorted(ends, at + begin, side="right"))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        ids, documents = np.divmod(pairs, max(1, self.size))
        bounds = np.searchsorted(ids, np.arange(1, len(trigrams) + 2))
        self.postings = {t: documents[bounds[i] : bounds[i + 1]] for i, t in enumerate(trigrams)}

    def documents(self, query: Query) -> np.ndarray:
        """The documents that satisfy the query: postings intersected for "and", united for "or"."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.documents(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


@lru_cache(maxsize=4)
def _places(trigrams: tuple[str, ...]) -> np.ndarray:
    """By the 24 bits of a trigram: its number from 1 on, 0 for those that no rule asks for."""
    if len(trigrams) > 60_000:
        raise ValueError("too many trigrams for one scan; split the rules")
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(trigrams, 1):
        a, b, c = t.encode("latin-1")
        table[(a << 16) | (b << 8) | c] = i
    return table


def segment_spans(texts: list[str], rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """Spans ``(start, rule number, end)`` of every text, in order, in code points."""
    queries = [trigram_query(r.pattern, r.any_case) for r in rules]
    index = SegmentIndex(texts, sorted(set().union(*map(trigrams_of, queries))))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(zip(rules, queries)):
        search = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)).finditer
        for document in index.documents(query):
            for m in search(texts[document]):
                if len(m[rule.group]) >= rule.least:
                    spans[document].append((m.start(), number, m.end()))
    for found in spans:
        found.sort()
    return spans


# --- Spark -------------------------------------------------------------------------------------------------------------


def _said(spans, rules: Sequence[Rule], base: bool = False) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans if rules[k].base or not base)


def find_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` of every row (code points, end exclusive, by start, then kind).

    The rows of a task are taken in segments of bounded text. A segment gets an inverted index of the trigrams that the
    rules' Boolean queries name; postings are intersected and united; only the candidates meet the regular expression. A
    rule without mandatory trigrams scans every text. Index and texts lie in the same task, so nothing is shuffled.

    NULL and empty texts have no spans. Repeated rows and NULL keys are scanned one by one; an empty table gives an empty
    result; other columns are not read. A single very long text is a segment of its own.
    """
    rules = list(rules)

    def work(part, texts):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        found = segment_spans(texts, rules)
        said = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in found]
        yield [part.column(0), pa.array(said, kind)]

    source = keyed_text(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, work, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digests(df: DataFrame, rules: Sequence[Rule] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_<base kind>…, base_sha256, spans``: counts and a digest of the base spans, and all spans as a string.

    A span reads ``kind:start:end``; spans are joined by commas. Cases as in ``find_secrets``.
    """
    rules = list(rules)
    base = [i for i, r in enumerate(rules) if r.base]

    def work(part, texts):
        found = segment_spans(texts, rules)
        counts = [[sum(k == i for _, k, _ in spans) for spans in found] for i in base]
        digests = [hashlib.sha256(_said(spans, rules, True).encode()).hexdigest() for spans in found]
        yield [part.column(0), *counts, digests, [_said(spans, rules) for spans in found]]

    source = keyed_text(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{rules[i].kind} long" for i in base)
    return map_texts(source, work, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(df: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret span of ``text`` replaced by ``marker``; overlapping spans by one.

    A NULL text stays NULL; texts without secrets, empty ones among them, are unchanged. Repeated rows and NULL keys are
    treated row by row; an empty table gives an empty one. No shuffle.
    """
    rules = list(rules)
    at = column_of(df, text)

    def run(batches):
        for batch in batches:
            for part, texts in pieces_of(batch, at):
                plain = [t or "" for t in texts]
                changed = list(texts)
                for i, spans in enumerate(segment_spans(plain, rules)):
                    if spans:
                        changed[i] = _without(plain[i], spans, marker)
                arrays = list(part.columns)
                arrays[at] = pa.array(changed, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def _without(text: str, spans: list[tuple[int, int, int]], marker: str) -> str:
    out, end = [], 0
    reach = -1
    for start, _, stop in spans:
        if start < reach:
            reach = max(reach, stop)
            end = reach
            continue
        out.extend((text[end:start], marker))
        end = reach = stop
    return "".join([*out, text[end:]])
