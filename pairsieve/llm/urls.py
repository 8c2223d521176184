"""URL rules as glob patterns, all simulated at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import quoted


class Glob(NamedTuple):
    """A pattern over ``host/path``: ``**`` any run, ``*`` any run without ``/``, ``?`` one character but ``/``."""

    pattern: str
    verdict: str


class DomainRule(NamedTuple):
    """Fits ``host`` and its subdomains if the URL's path starts with ``path``; the longest that fits decides."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[Glob]:
        if set("*?") & set(self.name):
            raise ValueError("a domain rule has no wildcards")
        return [Glob(f"{self.name}**", self.verdict), Glob(f"*.{self.name}**", self.verdict)]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    place = F.locate("://", url)
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise(F.lit(""))


class ShiftAnd:
    """Shift-And over several machine words for many glob patterns at once.

    Each pattern has a start bit and a bit for each literal byte or ``?``. A byte moves every active bit one place up, if
    the next place accepts the byte; a bit before a wildcard also stays, as long as the wildcard accepts the byte.
    Patterns lie one after another over as many 64-bit words as they need; the top bit of a word carries into the next.
    """

    def __init__(self, patterns: Sequence[str]):
        places: list[tuple[set[int] | None, str, bool]] = []  # accepted bytes (None: a start), wildcard after it, end
        for pattern in patterns:
            first = len(places)
            places.append((None, "", False))
            i = 0
            while i < len(pattern):
                if pattern[i] == "*":
                    deep = pattern.startswith("**", i)
                    accepted, loop, _ = places[-1]
                    places[-1] = (accepted, "**" if deep or loop == "**" else "*", False)
                    i += 1 + deep
                    continue
                if pattern[i] == "?":  # one code point: a leading byte, then any continuation bytes
                    places.append(({b for b in range(256) if b != 0x2F and not 0x80 <= b < 0xC0}, "?", False))
                else:
                    places.extend(({b}, "", False) for b in pattern[i].encode())
                i += 1
            places[-1] = (*places[-1][:2], True)
            assert len(places) > first
        self.patterns = list(patterns)
        self.words = max(1, -(-len(places) // 64))
        self.accept = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        loops = {"": set(), "?": set(range(0x80, 0xC0)), "*": set(range(256)) - {0x2F}, "**": set(range(256))}
        for at, (accepted, loop, end) in enumerate(places):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            if accepted is None:
                self.start[word] |= bit
            for b in accepted or ():
                self.accept[b, word] |= bit
            for b in loops[loop]:
                self.stay[b, word] |= bit
            if end:
                self.final.append((word, bit))

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which pattern (column) fits which whole text (row). The texts advance together, longest first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.asarray([len(texts[i]) for i in order])
        state = np.tile(self.start, (len(texts), 1))
        codes = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.cumsum(sizes) - sizes
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than step
            now = state[:live]
            byte = codes[begin[:live] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.accept[byte]) | (now & self.stay[byte])
        found = np.empty((len(texts), len(self.final)), bool)
        for column, (word, bit) in enumerate(self.final):
            found[order, column] = (state[:, word] & bit) != 0
        return found


def filter_urls(
    df: DataFrame,
    rules: Sequence[DomainRule],
    globs: Sequence[Glob],
    *,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``key, host, path, rule, verdict, pattern`` of every row: one scan that reads the key and the URL, no shuffle.

    Domain rules and globs become patterns of one automaton over the canonical URL (host in lower case, path without query
    and fragment). The longest domain rule that fits decides; else the first glob that fits (then ``pattern``); else
    ``default``. Equally long domain rules: the earlier one.

    A NULL URL, or one without ``://``, has an empty host and path, and is judged as such. Repeated rows are judged one by
    one; an empty table gives an empty result; other columns are not read. The rule list is a parameter: the executors get
    its bit masks with the task.
    """
    rules, globs = list(rules), list(globs)
    patterns = [(g.pattern, i, -1) for i, r in enumerate(rules) for g in r.globs()]
    patterns += [(g.pattern, -1, i) for i, g in enumerate(globs)]
    automaton = ShiftAnd([p for p, _, _ in patterns])
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    columns = {i: [c for c, (_, r, _) in enumerate(patterns) if r == i] for i in rank}

    text = F.col(quoted(url))
    source = df.select(F.col(quoted(key)).alias("key"), host_of(text).alias("host"), path_of(text).alias("path"))
    source = source.fillna("", ["host", "path"])

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                texts = [(h + p).encode() for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                found = automaton.match(texts)
                rule, verdict, pattern = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                for row, hits in enumerate(found):
                    domain = next((i for i in rank if hits[columns[i]].any()), None)
                    if domain is not None:
                        rule[row], verdict[row] = rules[domain].name, rules[domain].verdict
                        continue
                    glob = next((g for (_, _, g), hit in zip(patterns, hits) if hit and g >= 0), None)
                    if glob is not None:
                        pattern[row], verdict[row] = globs[glob]
                    else:
                        verdict[row] = default
                strings = [pa.array(x, pa.string()) for x in (rule, verdict, pattern)]
                names = ["key", "host", "path", "rule", "verdict", "pattern"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *strings], names=names)

    kind = source.schema["key"].dataType.simpleString()
    judged = source.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, pattern string")
    return judged.withColumnRenamed("key", key)
