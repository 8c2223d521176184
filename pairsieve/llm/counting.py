"""Token counts of a merge-type SentencePiece model: initial symbols minus merges, without making any identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceModel, built
from .rows import Memo, keyed_text, map_texts


class TokenCounter:
    """Counts by chunk; a chunk that came before is looked up."""

    def __init__(self, proto: bytes):
        self.model = PieceModel(proto)
        self.chunk = Memo(self._count_chunk, 800_000)

    def _count_chunk(self, chunk: str) -> int:
        parts = self.model.parts(chunk)
        if len(parts) > 1:
            return sum(map(self.chunk, parts))
        if len(chunk) == 1:  # an unknown character becomes its bytes
            return 1 if chunk in self.model.id_of else len(chunk.encode())
        unknown = sum(len(c.encode()) - 1 for c in chunk if c not in self.model.id_of)
        return len(chunk) + unknown - self.model.count_merges(chunk)

    def count(self, text: str) -> int:
        return sum(self.chunk.many(self.model.chunks(text)))


def token_counts(df: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: a scan, no shuffle.

    Heap-and-linked-list byte-pair merging: each character is a symbol, the neighbouring pair that merges first is popped
    again and again, and the count is symbols minus merges; characters outside the vocabulary count their UTF-8 bytes.
    ``model`` is the path of a SentencePiece model on the driver. Begin, end and other special tokens are not added; their
    strings inside a text are ordinary text.

    NULL or empty text: 0 bytes, 0 tokens. Rows with NULL or repeated keys are counted one by one; an empty table gives
    an empty result; other columns are not read.
    """
    with open(model, "rb") as f:
        proto = df.sparkSession.sparkContext.broadcast(f.read())

    def work(part, texts):
        counter = built("count", proto.value, TokenCounter)
        yield [part.column(0), part.column(2), [counter.count(t) for t in texts]]

    source = keyed_text(df, key, text)
    source = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = map_texts(source, work, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
