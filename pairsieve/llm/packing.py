"""Packing token streams into fixed windows: concatenate everything, then cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .bytelevel import ByteTokens
from .pieces import built
from .rows import keyed_text, pieces_of

#: Texts whose ids are held and sent on at once end after about so many characters.
PIECE_CHARS = 1_000_000


def pack(
    df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0
) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens: every sequence but the last is full.

    Returns ``doc_id, start, length, ids (array<int>), ids_crc32, doc_tokens, sequence_id, offset``; the CRC-32 is that of
    the ids as little-endian unsigned 32-bit numbers. A document is its ids and then ``end_id``. One scan tokenizes into a table in the shared folder; each row carries its partition and the number of
    tokens before it there. A sum per partition gives the offset of each partition (as many numbers as there are
    partitions, and no data, reach the driver). A second scan cuts each document at the multiples of ``window`` that it
    crosses; a document on a boundary gives a piece on either side. No shuffle of rows, whatever their lengths.

    Documents follow each other as the first scan met them, which the written table fixes. NULL or empty text gives the end
    id alone. Repeated rows and NULL keys are packed one by one; an empty table gives no piece; other columns are not read.
    """
    return _cut(df, tokenizer, key, text, window, end_id)


def packed_digests(
    df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0
) -> DataFrame:
    """Like ``pack`` without ``ids``."""
    return _cut(df, tokenizer, key, text, window, end_id, with_ids=False)


def _cut(
    df: DataFrame, tokenizer: str, key: str, text: str, window: int, end_id: int, with_ids: bool = True
) -> DataFrame:
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    source = keyed_text(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    size = 2 if len(ByteTokens(data.value, False).bytes) <= 1 << 16 else 4

    def tokenize(batches):
        coder = built("tokens", data.value, lambda file: ByteTokens(file, special_is_text=False))
        before = 0  # tokens that this task has met so far
        for batch in batches:
            for part, texts in pieces_of(batch, 1, PIECE_CHARS):
                ids = [np.asarray([*coder.encode(t), end_id], f"<u{size}").tobytes() for t in texts]
                counts = np.asarray([len(x) // size for x in ids], np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                arrays = [part.column(0), pa.array(ids, pa.binary()), pa.array(counts), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "doc_tokens", "before"])

    tokens = source.mapInArrow(tokenize, f"doc_id {kind}, ids binary, doc_tokens long, before long")
    table = materialise(tokens.withColumn("part", F.spark_partition_id()), "tokens")
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(totals):
        first[part] = total
        total += totals[part]
    offsets = spark.sparkContext.broadcast(first)

    kinds = {"doc_id": kind, "start": "long", "length": "long", "ids": "array<int>", "ids_crc32": "long"}
    kinds |= dict.fromkeys(("doc_tokens", "sequence_id", "offset"), "long")
    if not with_ids:
        del kinds["ids"]

    def cut(batches):
        for batch in batches:
            out, held = {name: [] for name in kinds}, 0
            columns = [batch.column(i) for i in range(5)]
            for row in range(batch.num_rows):
                doc, raw, n, before, part = (c[row].as_py() for c in columns)
                place, begin = offsets.value[part] + before, 0
                while begin < n:
                    offset = (place + begin) % window
                    length = min(window - offset, n - begin)
                    ids = np.frombuffer(raw, f"<u{size}", length, begin * size).astype("<i4")
                    values = (doc, begin, length, *[ids] * with_ids, zlib.crc32(ids.tobytes()), n)
                    for column, x in zip(out.values(), (*values, (place + begin) // window, offset)):
                        column.append(x)
                    begin += length
                    held += length if with_ids else 20
                    if held >= 1_000_000:
                        yield _pieces(out, batch.schema.field(0).type)
                        out, held = {name: [] for name in kinds}, 0
            if held:
                yield _pieces(out, batch.schema.field(0).type)

    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return table.select("doc_id", "ids", "doc_tokens", "before", "part").mapInArrow(cut, schema)


def _pieces(columns: dict[str, list], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": key, "ids": pa.list_(pa.int32())}
    arrays = [pa.array(c, kinds.get(n, pa.int64())) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
