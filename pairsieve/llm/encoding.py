"""SentencePiece encoding by a table of last tokens, and decoding."""

from __future__ import annotations

import hashlib
import itertools
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import PieceModel, built
from .rows import Memo, keyed_text, map_texts


class PrefixTableEncoder:
    """Encodes through the last token of every prefix.

    For merge-type vocabularies a sequence of pieces is the encoding of its text exactly if every two neighbours are: so
    each prefix has one last token only, the one piece ending there that is compatible with the last token of what stands
    before it. An Aho-Corasick automaton lists the pieces that end at each place; the pair test undoes the two pieces' merges
    and looks for one across the middle that would have come first. The ids are then read from the table backwards.
    """

    def __init__(self, proto: bytes):
        self.model = PieceModel(proto)
        self.size = len(self.model.library)
        self.text_of = {i: p for p, i in self.model.id_of.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.model.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.alphabet = frozenset(p for p in self.model.id_of if len(p) == 1)
        self.compatible = Memo(self._compatible, 1_000_000)
        self.chunk = Memo(self._encode_chunk, 600_000)

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, self.size + 1)
        a = self.text_of[left] if left < self.size else ""  # size: nothing, or a character outside the vocabulary
        b = self.text_of[right]
        if not a:
            return len(b) == 1 or self.model.halves(b) is not None
        return self.model.neighbours(a, b)

    def _encode_part(self, part: str) -> tuple[int, ...]:
        """The ids of a string of which no character, or the only one, is outside the vocabulary."""
        n, none = len(part), self.size
        if n == 1:
            i = self.model.id_of.get(part)
            return (i,) if i is not None else tuple(self.model.byte_ids[b] for b in part.encode())
        last = [-1] * n + [none]  # last[-1] is the empty prefix
        length = [1] * n
        compatible, known = self.compatible, self.compatible.young.get
        for end, (i, size) in self.automaton.iter(part):
            if last[end] < 0:
                left = last[end - size]
                if left >= 0:
                    pair = left * (none + 1) + i
                    fits = known(pair)
                    if fits is None:
                        fits = compatible(pair)
                        known = compatible.young.get
                    if fits:
                        last[end], length[end] = i, size
        at, back = n - 1, []
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"no encoding of {part!r}")
            back.append(last[at])
            at -= length[at]
        return tuple(reversed(back))

    def _encode_chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        parts = self.model.parts(chunk)
        if len(parts) > 1:
            ids = tuple(i for p in parts for i in self.chunk(p)[0])
        elif len(chunk) > 1 and not self.alphabet.issuperset(chunk):
            ids = tuple(i for p in self.model.known_runs(chunk) for i in self._encode_part(p))
        else:
            ids = self._encode_part(chunk)
        return ids, " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], list[str]]:
        """The ids, and the same in decimal, joined by spaces within each chunk."""
        hits = self.chunk.many(self.model.chunks(text))
        return list(itertools.chain.from_iterable(map(itemgetter(0), hits))), list(map(itemgetter(1), hits))


def encode_pieces(df: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", end_id: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` of every row as the library encodes it (no sampling, no begin id); a scan, no shuffle.

    ``model`` is the path of a merge-type SentencePiece model with byte fallback, read on the driver. NULL or empty text
    gives the end id alone (nothing without ``end_id``). Repeated rows and keys are encoded one by one; an empty table
    gives an empty result; other columns are not read.
    """
    proto = _shared(df, model)

    def work(part, texts):
        encoder = built("encode", proto.value, PrefixTableEncoder)
        tail = [encoder.model.library.eos_id()] if end_id else []
        yield [part.column(0), pa.array([encoder.encode(t)[0] + tail for t in texts], pa.list_(pa.int32()))]

    source = keyed_text(df, key, text)
    return map_texts(source, work, f"doc_id {_kind(source)}, ids array<int>")


def decode_pieces(df: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids, by the library's decoder. NULL and empty ids give an empty text."""
    from pyspark.sql import functions as F

    proto = _shared(df, model)
    source = df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        library = built("encode", proto.value, PrefixTableEncoder).model.library
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [library.decode(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {_kind(source)}, text string")


def round_trip(df: DataFrame, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded with an end id, decoded again, in one scan.

    The digests are those of the decimal ids joined by one space and of the decoded text in UTF-8. NULL counts as empty.
    """
    proto = _shared(df, model)

    def work(part, texts):
        encoder = built("encode", proto.value, PrefixTableEncoder)
        library = encoder.model.library
        end = library.eos_id()
        counts, digests, decoded = [], [], []
        for t in texts:
            ids, said = encoder.encode(t)
            ids.append(end)
            said.append(str(end))
            counts.append(len(ids))
            digests.append(hashlib.sha256(" ".join(said).encode()).hexdigest())
            decoded.append(hashlib.sha256(library.decode(ids).encode()).hexdigest())
        yield [part.column(0), counts, digests, decoded]

    source = keyed_text(df, key, text)
    return map_texts(source, work, f"doc_id {_kind(source)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
