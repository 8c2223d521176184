"""What the two SentencePiece operators need of a merge-type model: its pieces, their merge order, safe places to cut.

A model file is read once on the driver and its bytes (a vocabulary file, fixed in size) go to the executors as a
broadcast variable, so no executor needs the path. Each Python worker keeps what it built from the last few models.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Callable
from typing import Any

import sentencepiece

SPACE = "▁"
#: A run of spaces with what follows it, or what stands before the first space.
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(rf"{SPACE}?[^\W\d_]+")

_built: dict[tuple[str, str], Any] = {}


def built(kind: str, data: bytes, make: Callable[[bytes], Any]) -> Any:
    """``make(data)``, kept in this Python process for later tasks, until something else is built: nothing stays of stages that ended."""
    key = (kind, hashlib.sha256(data).hexdigest())
    if key not in _built:
        _built.clear()
        _built[key] = make(data)
    return _built[key]


class PieceModel:
    """Pieces of a merge-type SentencePiece model with byte fallback.

    Merges join two neighbours whose concatenation is a piece; the piece with the highest score goes first, the leftmost
    of equals before the others. Control, unknown and byte pieces never take part.
    """

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = len(self.library)
        self.id_of: dict[str, int] = {}
        score: dict[str, float] = {}
        self.byte_ids: list[int] = [0] * 256
        self._halves: dict[str, tuple] = {}
        n_bytes = 0
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                n_bytes += 1
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                if self.library.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                self.id_of.setdefault(piece, i)
                score.setdefault(piece, self.library.get_score(i))
        if n_bytes != 256:
            raise ValueError("a model with byte fallback is needed")
        rank_of = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: rank_of[x] for p, x in score.items()}
        #: Neighbours inside some piece. Between any other two characters no merge can ever reach across.
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cut_at_spaces = not any(p[i] != SPACE and p[i + 1] == SPACE for p in self.id_of for i in range(len(p) - 1))
        self.cut = self._cut() if self.cut_at_spaces else None

    def _cut(self) -> re.Pattern:
        """Chunks also end where a word does: words are the same whatever punctuation follows them.

        A word's letters are those of the vocabulary; one that some piece has beside another character than a letter or a
        space counts as other characters do, and so do the letters beside it, so that no piece reaches over the end of a word.
        """
        pairs = [pair for pair in self.inside if SPACE not in pair]
        letters = {c for c in self.id_of if len(c) == 1 and LETTER.match(c)}
        while more := {c for pair in pairs if (pair[0] in letters) != (pair[1] in letters) for c in pair} & letters:
            letters -= more
        if not letters:
            return CHUNK
        plain = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{SPACE}*(?:[{plain}]+|[^{plain}{SPACE}]+)|{SPACE}+")

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut before spaces, and where words end, if no piece of the model reaches over such a place."""
        normalised = self.library.normalize(text)
        return self.cut.findall(normalised) if self.cut else [normalised] if normalised else []

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut where no merge can reach across; one plain word is left whole."""
        if WORD.fullmatch(chunk):
            return [chunk]
        inside, out, begin = self.inside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in inside:
                out.append(chunk[begin:i])
                begin = i
        out.append(chunk[begin:])
        return out

    def known_runs(self, chunk: str) -> list[str]:
        """The chunk cut around characters outside the vocabulary, which never merge."""
        out: list[str] = []
        for known, run in itertools.groupby(chunk, self.id_of.__contains__):
            out.extend(["".join(run)] if known else run)
        return out

    def merged(self, text: str) -> list[str]:
        """The merges of a short string, one after the other; for the pair tests, whose strings are two pieces long."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece of several characters joins; None if merging makes something else."""
        found = self._halves.get(piece)
        if found is None:
            symbols, before = list(piece), None
            while len(symbols) > 1:
                ranks = [self.rank.get(a + b, math.inf) for a, b in itertools.pairwise(symbols)]
                at = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[at] == math.inf:
                    break
                before = symbols[at], symbols[at + 1]
                symbols[at : at + 2] = [before[0] + before[1]]
            found = self._halves[piece] = before if len(symbols) == 1 and before else ()
        return found or None

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the text of two pieces is encoded as these two.

        Their merges are undone, the latest first, down to the characters on either side. If at any point a merge across the
        middle would have come before the one undone last (or with it, from the left), the two do not stay apart.
        """
        if not left.strip(SPACE) or not right.strip(SPACE):  # runs of spaces share one rank, which the undoing needs to differ
            return self.merged(left + right) == [left, right]
        rank, limit = self.rank, math.inf
        late = (rank[left] if len(left) > 1 else -1), (rank[right] if len(right) > 1 else -1)
        while True:
            if rank.get(left + right, math.inf) < limit:
                return False
            if late == (-1, -1):
                return True
            if late[0] > late[1]:
                parts = self.halves(left)
                if parts is None:
                    return False
                limit, left = late[0], parts[1]
                late = (rank[left] if len(left) > 1 else -1), late[1]
            else:
                parts = self.halves(right)
                if parts is None:
                    return False
                limit, right = late[1] + 1, parts[0]
                late = late[0], (rank[right] if len(right) > 1 else -1)

    def count_merges(self, text: str) -> int:
        """How many merges the string takes: neighbours wait in a heap by merge order, symbols form a linked list.

        A popped entry is skipped if what now stands at its place would merge at another rank. O(n log n), for strings of any length.
        """
        n = len(text)
        get = self.rank.get
        symbol: list[str | None] = list(text)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]  # by rank, then from the left
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, left = divmod(heapq.heappop(heap), n)
            right = after[left]
            if symbol[left] is None or right == n:
                continue
            pair = symbol[left] + symbol[right]
            if get(pair) != rank:
                continue
            symbol[left], symbol[right] = pair, None
            merges += 1
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                r = get(pair + symbol[right])
                if r is not None:
                    heapq.heappush(heap, r * n + left)
            left = before[left]
            if left >= 0:
                r = get(symbol[left] + pair)
                if r is not None:
                    heapq.heappush(heap, r * n + left)
        return merges
