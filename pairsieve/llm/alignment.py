"""Token alignment across two tokenizers, by skipping along diagonals, and how often token pairs are linked corpus-wide."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .bytelevel import ByteTokens
from .pieces import SPACE, built
from .rows import keyed_text, pieces_of

#: A piece of documents that is aligned at once ends after about so many characters.
PIECE_CHARS = 2_000_000
#: Groups with more links than this are counted by their distinct ids.
LARGE_GROUP = 4096


class PieceTokens:
    """Tokens of a SentencePiece model, and the bytes of each."""

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = []
        for i in range(len(self.library)):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.library.encode_as_ids(text)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


# --- Groups ------------------------------------------------------------------------------------------------------------


def groups(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side in each group, from the byte offsets at which tokens end; both lists end at the same offset.

    Where token ``i`` of one side ends with token ``i + shift`` of the other, the next ones mostly do too. So a stretch
    of one-to-one tokens is found by comparing slices of the two lists at this shift, each twice as long as the one before, and
    halving the slice in which they part. The tokens after it are walked one by one to the next common end; that group
    gives the new shift.
    """
    i = j = 0
    n, m = len(a), len(b)
    runs, left, right = [], [], []
    while i < n and j < m:
        begin, step = i, 4
        while i < n and a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
            step *= 2
        if i >= n:
            runs.append(n - begin)
            left.append(0)
            right.append(0)
            break
        while step > 1:  # the lists part within the next `step` tokens
            step //= 2
            if a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        runs.append(i - begin)
        x, y = i, j
        while a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        left.append(x + 1 - i)
        right.append(y + 1 - j)
        i, j = x + 1, y + 1
    stretch = np.asarray(runs, np.int64)
    at = np.cumsum(stretch + 1) - 1
    sizes = []
    for odd in (left, right):
        size = np.ones(len(stretch) + int(stretch.sum()), np.int64)
        size[at] = odd
        sizes.append(size)
    real = sizes[0] > 0
    return sizes[0][real], sizes[1][real]


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``group, a id, b id, times`` of all links: every token of a group's one side with every one of its other side.

    Large groups give a row per pair of different ids, ``times`` as often as both occur.
    """
    begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    many = size_a * size_b
    large = np.flatnonzero(many > LARGE_GROUP)
    many[large] = 0
    group = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    width = size_b[group]
    found = [(group, a[begin_a[group] + place // width], b[begin_b[group] + place % width], np.ones(len(group), np.int64))]
    for g in large:
        one, n = np.unique(a[begin_a[g] : begin_a[g] + size_a[g]], return_counts=True)
        two, k = np.unique(b[begin_b[g] : begin_b[g] + size_b[g]], return_counts=True)
        found.append((np.full(len(one) * len(two), g), np.repeat(one, len(two)), np.tile(two, len(one)), np.outer(n, k).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def _said(ids: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], words: list[str]) -> list[str]:
    """All tokens group by group, one side before the other, as decimal ids with the mark that follows; ``words`` by 3·id + mark."""
    a, b = sizes
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    marks = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    at_a = np.arange(len(ids[0])) + np.repeat(ends_b - b, a)
    at_b = np.arange(len(ids[1])) + np.repeat(ends_a, b)
    marks[at_a], marks[at_b] = 3 * ids[0], 3 * ids[1]
    marks[ends_a + ends_b - b - 1] += 1
    marks[ends_a + ends_b - 1] += 2
    return list(map(words.__getitem__, marks.tolist()))


# --- Pieces of documents -----------------------------------------------------------------------------------------------


class Aligner:
    """Both tokenizers with what is looked up by id."""

    def __init__(self, first: bytes, second: bytes):
        self.sides = (ByteTokens(first, special_is_text=True), PieceTokens(second))
        self.lengths = [np.asarray([len(x) for x in side.bytes], np.int64) for side in self.sides]
        self.width = len(self.lengths[1])
        self.words = [f"{i}{mark}" for i in range(max(map(len, self.lengths))) for mark in ",|;"]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of either side; none where their bytes are not those of a space and the text."""
        if not text:
            return [], []
        ids = self.sides[0].encode(" " + text), self.sides[1].encode(text)
        wanted = (" " + text).encode()
        same = all(side.joined(own) == wanted for side, own in zip(self.sides, ids))
        return ids if same else ([], [])

    def piece(self, texts: list[str]) -> dict:
        """What a piece of documents gives: by document its numbers and digest, and its different pairs of ids.

        Documents are laid end to end, so one walk aligns them all: they end together on both sides.
        """
        ids = [self.tokens(t) for t in texts]
        counts = np.asarray([(len(x), len(y)) for x, y in ids], np.int64).reshape(-1, 2)
        a, b = (np.fromiter(itertools.chain.from_iterable(x[s] for x in ids), np.int64, int(counts[:, s].sum())) for s in (0, 1))
        ends_a, ends_b = (np.cumsum(length[x]) for length, x in zip(self.lengths, (a, b)))
        size_a, size_b = groups(ends_a.tolist(), ends_b.tolist())
        # The document of each group is that of its first token.
        owner = np.repeat(np.arange(len(texts)), counts[:, 0])[np.cumsum(size_a) - size_a]
        n_groups = np.bincount(owner, minlength=len(texts))
        group, one, two, times = links(a, b, size_a, size_b)
        pair = one * self.width + two
        doc = owner[group]
        n_links = np.bincount(doc, weights=times, minlength=len(texts)).astype(np.int64)

        if times.max(initial=1) > 1:
            order = np.lexsort((pair, doc))
            doc, pair, times = doc[order], pair[order], times[order]
        else:  # one sort of both in one number; ids of two vocabularies take 40 bits at most, documents of a piece the rest
            both = np.sort(doc << 40 | pair)
            doc, pair = both >> 40, both & ((1 << 40) - 1)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        times = np.add.reduceat(times, first) if len(first) else times
        doc, pair = doc[first], pair[first]
        pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)

        words = _said((a, b), (size_a, size_b), self.words)
        cuts = np.r_[0, np.cumsum(counts.sum(1))].tolist()
        said = ["".join(words[x:y])[:-1] for x, y in itertools.pairwise(cuts)]
        return {
            "n_a": counts[:, 0],
            "n_b": counts[:, 1],
            "n_groups": n_groups,
            "n_links": n_links,
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said],
            "n_pairs": np.bincount(doc, minlength=len(texts)),
            "pairs": pairs,
            "held": held,
            "places": place,
            "times": times,
        }


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, compressed by byte planes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align(
    df: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row: two tokenizers' tokens compared.

    A is the byte-level file ``first`` on a space and the text, B the SentencePiece model ``second`` on the text (which adds
    the space itself); special tokens are neither added nor recognised. Byte offsets where tokens of both end cut a text into
    groups; every A token of a group is linked with every B token of it. The count of a pair of ids is the number of rows of the
    whole table that hold it linked; ``count_sum`` adds it up over a row's links, ``n_best`` counts the links whose pair has
    its A id's highest count (ties included). The digest is that of ``a1,a2|b1;a3|b2,b3``, the ids group by group.

    Groups are found by diagonal run skipping (``groups``). Texts are read and tokenized once, in pieces of documents, each
    written as one row: its documents' numbers, its distinct pairs, and where each document has them. So a pair costs a row
    per piece, not one per document or link. Rows of distinct pairs are counted with partial sums, joined with the counts by pair,
    and brought back by piece: no key has more rows than there are pieces, none is collected beyond a piece's own pairs.

    NULL and empty texts, and texts whose tokens' bytes differ from the space and the text (normalised ones, for example),
    have no tokens: zeros and an empty digest. Repeated rows and NULL keys count row by row; an empty table gives an empty
    result; other columns are not read. The files are read on the driver.
    """
    spark = df.sparkSession
    with open(first, "rb") as f, open(second, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    source = keyed_text(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    width = len(PieceTokens(files.value[1]).bytes)
    numbers = ", ".join(f"{n}: array<long>" for n in (*COUNTS, "n_pairs"))
    shape = f"piece long, doc_id array<{kind}>, docs struct<{numbers}, groups_sha256: array<string>>, pairs array<long>, held array<long>, places binary, times binary"
    shape = spark.createDataFrame([], shape).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = built("align", files.value[0] + files.value[1], lambda _: Aligner(*files.value))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in pieces_of(batch, 1, piece_chars):
                made = aligner.piece(texts)
                docs = pa.StructArray.from_arrays(
                    [*[_one(pa.array(made[n], pa.int64())) for n in (*COUNTS, "n_pairs")], _one(pa.array(made["groups_sha256"], pa.string()))],
                    names=[*COUNTS, "n_pairs", "groups_sha256"],
                )
                # Places rise within a document: their differences are small, and 1 is added so that none is negative.
                steps = np.diff(made["places"], prepend=0)
                begins = np.cumsum(made["n_pairs"])[:-1]
                begins = begins[begins < len(steps)]
                steps[begins] = made["places"][begins]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        _one(part.column(0)),
                        docs,
                        _one(pa.array(made["pairs"], pa.int64())),
                        _one(pa.array(made["held"], pa.int64())),
                        pa.array([_packed(steps)], pa.binary()),
                        pa.array([_packed(made["times"])], pa.binary()),
                    ],
                    names=shape.names,
                )
                number += 1

    pieces = materialise(source.mapInArrow(work, shape), "pieces")
    rows = pieces.select("piece", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "own"))
    rows = rows.select("piece", "at", F.col("own.pairs").alias("pair"), F.col("own.held").alias("held"))
    counts = rows.groupBy("pair").agg(F.sum("held").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.expr(f"pair div {width}")))
    counts = counts.withColumn("best", F.col("n") == highest)
    back = rows.select("piece", "at", "pair").join(counts, "pair").groupBy("piece").agg(F.collect_list(F.struct("at", "n", "best")).alias("facts"))

    out = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, docs, places, times, facts = (batch.column(c)[i] for c in range(5))
                fields = {n: docs[n].values for n in (*COUNTS, "n_pairs", "groups_sha256")}
                n_pairs = fields["n_pairs"].to_numpy()
                total = int(n_pairs.sum())
                sums = np.zeros((2, len(n_pairs)), np.int64)
                if total:
                    own = facts.values
                    at = own.field("at").to_numpy()
                    count, best = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                    count[at] = own.field("n").to_numpy()
                    best[at] = own.field("best").to_numpy(zero_copy_only=False)
                    steps, times = _unpacked(places.as_py(), total), _unpacked(times.as_py(), total)
                    # Places start anew with each document.
                    ends = np.cumsum(n_pairs)
                    run = np.cumsum(steps)
                    place = run - np.repeat(np.r_[0, run][ends - n_pairs], n_pairs)
                    doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
                    np.add.at(sums[0], doc, times * best[place])
                    np.add.at(sums[1], doc, times * count[place])
                yield pa.RecordBatch.from_arrays(
                    [keys.values, *[fields[n] for n in COUNTS], pa.array(sums[0]), pa.array(sums[1]), fields["groups_sha256"]],
                    names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"],
                )

    joined = pieces.select("piece", "doc_id", "docs", "places", "times").join(back, "piece", "left")
    return joined.select("doc_id", "docs", "places", "times", "facts").mapInArrow(finish, out)


def _one(values: pa.Array) -> pa.Array:
    """An array as the only element of a list array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
