"""Substring deduplication: words covered by a window that an earlier document has too are removed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import keyed_text, pieces_of

#: Words are runs of anything but space and the control characters 9 to 13.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A piece of documents whose repeats are settled at once ends after about so many characters.
PIECE_CHARS = 4_000_000
#: Odd multipliers of the two rolling hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` word hashes, modulo 2^64, with its bits spread."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * base + hashes[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def sampling(window: int) -> tuple[int, int]:
    """Words of a gram, and grams in a window (a power of two, about half the window)."""
    grams = 1 << max(0, ((window + 1) // 2).bit_length())
    while grams > max(1, window - 1):
        grams //= 2
    return window - grams + 1, grams


def lowest_grams(hashes: np.ndarray, window: int) -> np.ndarray:
    """For the window that starts at each word, the lowest hash among its grams. Equal windows have equal ones."""
    gram, grams = sampling(window)
    low, step = rolling(hashes, gram, BASES[0]), 1
    while step < grams:
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        step *= 2
    return low


class Piece:
    """The words of some documents, one after another, and where windows start that lie within one document."""

    def __init__(self, texts: list[str], window: int):
        words = [t.encode().split() for t in texts]  # bytes.split() splits at exactly the characters of WORDS
        self.sizes = np.asarray([len(w) for w in words], np.int64)
        self.words = [x for w in words for x in w]
        ends = np.cumsum(self.sizes)
        self.begins = ends - self.sizes
        self.document = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(self.words))
        self.starts = at[at + window <= ends[self.document]] if len(at) else at


def _ranks(keys: list) -> np.ndarray:
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.asarray([order[k] for k in keys], np.int64)


def _shared_grams(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, gram, known``: the lowest grams of every document. A gram that several documents of the piece have is known
    to be shared: each of them gets a row that says so, and one row stands for all of them elsewhere."""
    for batch in batches:
        for part, texts in pieces_of(batch, 1, most):
            piece = Piece(texts, window)
            if not len(piece.starts):
                continue
            low = lowest_grams(word_hashes(piece.words, 0), window)[piece.starts]
            owner = piece.document[piece.starts]
            new = _changes(low, owner)
            low, owner = low[new], owner[new]
            order = np.lexsort((owner, low))
            low, owner = low[order], owner[order]
            new = _changes(low, owner)
            low, owner = low[new], owner[new]
            first = np.r_[True, low[1:] != low[:-1]]
            size = np.diff(np.r_[np.flatnonzero(first), len(low)])
            shared = np.repeat(size > 1, size)
            rows = np.r_[owner[first], owner[shared]]
            grams = np.r_[low[first], low[shared]].view(np.int64)
            known = np.r_[np.zeros(first.sum(), bool), np.ones(shared.sum(), bool)]
            order = np.argsort(rows, kind="stable")
            keys = part.column(0).take(pa.array(rows[order]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(grams[order]), pa.array(known[order])], names=["doc_id", "gram", "known"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before them."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _runs(starts: np.ndarray, window: int) -> bytes:
    """Ascending window starts as the intervals of words that they cover, merged: pairs of 32-bit numbers."""
    new = np.r_[True, starts[1:] > starts[:-1] + window]
    last = np.r_[new[1:], True]
    return np.stack([starts[new], starts[last] + window], 1).astype("<i4").tobytes()


def _repeated_windows(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, text_key, first, second, cuts, known`` of the windows with a shared gram.

    A copy of an earlier text goes whole, in one known row; its windows need no counting, the earlier one has them all. Within the piece, windows that a smaller ``doc_id`` has too go at once: one known row per document holds them. For each
    remaining window sequence its smallest document gets a row with both rolling hashes; others decide its fate.
    """
    names = ["doc_id", "text_key", "first", "second", "cuts", "known"]
    for batch in batches:
        chosen = batch.filter(pa.compute.and_(batch.column(3).is_valid(), batch.column(0).is_valid()))  # rows that met the join
        for part, texts in pieces_of(chosen, 1, most):
            piece = Piece(texts, window)
            if not len(piece.starts):
                continue
            hashes = word_hashes(piece.words, 0)
            low = lowest_grams(hashes, window)[piece.starts]
            owner = piece.document[piece.starts]
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            wanted = np.zeros(len(owner), bool)
            rows, cuts = [], []
            for i, (text_key, grams, copied) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))):
                if text_key in copied:
                    if bounds[i] < bounds[i + 1]:
                        rows.append(i)
                        cuts.append(np.asarray([0, piece.sizes[i]], "<i4").tobytes())
                else:
                    own = np.asarray(grams, np.int64).view(np.uint64)
                    wanted[bounds[i] : bounds[i + 1]] = np.isin(low[bounds[i] : bounds[i + 1]], own)
            starts, owner = piece.starts[wanted], owner[wanted]
            first = rolling(hashes, window, BASES[0])[starts]
            second = rolling(word_hashes(piece.words, 1), window, BASES[1])[starts].astype(np.uint32)
            rank = _ranks(part.column(0).to_pylist())[owner]
            order = np.lexsort((starts, owner, rank, second, first))
            starts, owner, first, second, rank = (x[order] for x in (starts, owner, first, second, rank))
            new = _changes(first, second)
            lowest = rank[np.flatnonzero(new)][np.cumsum(new) - 1] if len(rank) else rank
            gone = rank > lowest
            place = starts - piece.begins[owner]

            order = np.lexsort((place[gone], owner[gone]))
            going, at = owner[gone][order], place[gone][order]
            for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(going)) + 1) if len(at) else ():
                rows.append(going[own[0]])
                cuts.append(_runs(at[own], window))
            one, two, known = [0] * len(rows), [0] * len(rows), [True] * len(rows)

            order = np.flatnonzero(~gone)
            order = order[np.lexsort((place[order], second[order], first[order], owner[order]))]  # rows of a document together
            owner, first, second, place = (x[order] for x in (owner, first, second, place))
            begin = np.flatnonzero(_changes(owner, first, second))
            end = np.r_[begin[1:], len(owner)]
            single = np.stack([place, place + window], 1).astype("<i4").tobytes()
            cuts.extend(single[8 * b : 8 * e] if e - b == 1 else _runs(place[b:e], window) for b, e in zip(begin, end))
            rows.extend(owner[begin])
            one.extend(first[begin].view(np.int64).tolist())
            two.extend(second[begin].view(np.int32).tolist())
            known.extend([False] * len(begin))
            if not rows:
                continue
            at = pa.array(np.asarray(rows, np.int64))
            own = part.column(0).take(at), part.column(2).take(at)
            hashes = pa.array(one, pa.int64()), pa.array(two, pa.int32())
            yield pa.RecordBatch.from_arrays([*own, *hashes, pa.array(cuts, pa.binary()), pa.array(known)], names=names)


def _covered(size: int, text_key: int, cuts: list | None) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    for cut in cuts or ():
        if cut["text_key"] == text_key:
            pairs = np.frombuffer(cut["cuts"], "<i4").reshape(-1, 2)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change)[:size] > 0


def _with_cuts(df: DataFrame, key: str, text: str, window: int, most: int) -> DataFrame:
    """``doc_id, text, text_key, cuts``: each row with the intervals of words that go."""
    if window < 2:
        raise ValueError("a window has two words at least")
    source = keyed_text(df, key, text)
    source = source.withColumn("text_key", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    # 1. Which lowest grams occur in two documents? A window whose gram does not is no repeat.
    grams = (
        source.where(F.col("doc_id").isNotNull())
        .select("doc_id", "text")
        .mapInArrow(lambda batches: _shared_grams(batches, window, most), f"doc_id {kind}, gram long, known boolean")
    )
    alike = Window.partitionBy("gram", "own")
    shared = (
        grams.withColumn("own", F.when(F.col("known"), F.col("doc_id")))
        .withColumn("n", F.count(F.lit(1)).over(alike))
        .where(F.col("known") | (F.col("n") > 1))
        .select("doc_id", "gram", F.lit(None).cast("long").alias("copied"))
    )
    # Which texts are copies of an earlier one as they stand? Two hashes decide; the smallest key of each is the earlier.
    texts = source.where(F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("other_key"))
    originals = texts.groupBy("text_key", "other_key").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last"))
    originals = originals.where("original < last").drop("last")
    copies = texts.join(originals, ["text_key", "other_key"]).where("doc_id > original")
    copies = copies.select("doc_id", F.lit(None).cast("long").alias("gram"), F.col("text_key").alias("copied"))
    facts = shared.union(copies).groupBy("doc_id").agg(F.collect_set("gram").alias("grams"), F.collect_set("copied").alias("copied"))

    # 2. The windows with such a gram, by both hashes: those that a smaller document has go.
    looked = source.join(facts, "doc_id", "left").select("doc_id", "text", "text_key", "grams", "copied")
    windows = looked.mapInArrow(
        lambda batches: _repeated_windows(batches, window, most),
        f"doc_id {kind}, text_key long, first long, second int, cuts binary, known boolean",
    )
    same = Window.partitionBy("first", "second", "own")
    cuts = (
        windows.withColumn("own", F.when(F.col("known"), F.col("doc_id")))
        .withColumn("smallest", F.min("doc_id").over(same))
        .where(F.col("known") | (F.col("doc_id") > F.col("smallest")))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("text_key", "cuts")).alias("cuts"))
    )

    # 3. Each text meets its intervals; the shuffle of the texts is the one of step 2.
    return source.join(cuts, "doc_id", "left").select("doc_id", "text", "text_key", "cuts")


def remove_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 13, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of every row: its words but those that a repeated window covers.

    A window is ``window`` consecutive words of one row. It is repeated if the same words in sequence also start in a row
    with a smaller key. All windows are judged on the input; overlapping ones merge into maximal intervals, whose words go.
    The words that stay are joined by one space.

    Each window has Rabin-Karp hashes over word hashes. So that not every window has to travel, each is first represented by
    the lowest of the hashes of the shorter grams inside it; equal windows have equal lowest grams, and about a fifth as
    many distinct ones are counted. Windows whose gram occurs in one document only are no repeats. The others are
    shuffled by two rolling hashes, 96 bits in all (equal hashes count as equal words), and the smallest key of each is found.
    Before either shuffle a task keeps one row per hash for a piece of documents and settles the others at once, so a
    passage that a third of all rows share costs a row per piece, not per document. A text that equals an earlier one as it
    stands goes whole, by a 128-bit hash; its windows are not counted again. Intervals then meet the texts by key.

    NULL and empty texts have no words. Rows with a NULL key lose nothing and take nothing from others. Rows with equal keys
    take nothing from each other. An empty table gives an empty result; other columns are not read.
    """

    def kept(batches):
        for part, sizes, gone, texts in _applied(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(gone), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    joined = _with_cuts(df, key, text, window, piece_chars)
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, text string")


def remove_repeats_digests(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 13, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Like ``remove_repeats`` with ``kept_sha256``, the lowercase hex SHA-256 of the text that stays, in place of it."""

    def digests(batches):
        for part, sizes, gone, texts in _applied(batches):
            hashed = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(gone), pa.array(hashed, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _with_cuts(df, key, text, window, piece_chars)
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(digests, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[str]]]:
    for batch in batches:
        for part, texts in pieces_of(batch, 1):
            sizes, gone, kept = [], [], []
            for i, t in enumerate(texts):
                words = WORDS.findall(t)
                sizes.append(len(words))
                cuts = part.column(3)[i].as_py()
                if cuts:
                    covered = _covered(len(words), part.column(2)[i].as_py(), cuts)
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                gone.append(sizes[-1] - len(words))
                kept.append(" ".join(words))
            yield part, sizes, gone, kept
