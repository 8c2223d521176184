"""Small helpers that the operators share: choosing columns, walking Arrow batches, bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A piece of a batch that is worked on at once ends after about so many characters (or one row, if that is longer).
PIECE_CHARS = 4_000_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_of(df: DataFrame, name: str) -> int:
    """The place of a column, found as Spark finds it: by its exact name, else without regard to case where the session does."""
    if name in df.columns or df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true":
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keyed_text(df: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """Only ``key`` as ``doc_id`` and ``text`` (NULL read as empty): other columns, whatever their names, stay out of the job."""
    return df.select(
        F.col(quoted(key)).alias("doc_id"),
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
        *[c.alias(n) for n, c in more.items()],
    )


def pieces_of(batch: pa.RecordBatch, text: int, most: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in pieces of bounded text, each with its texts as Python strings."""
    lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > most:
            part = batch.slice(begin, i - begin)
            yield part, part.column(text).to_pylist()
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        part = batch.slice(begin)
        yield part, part.column(text).to_pylist()


def map_texts(
    df: DataFrame, work: Callable[[pa.RecordBatch, list[str]], Iterable[list[Any]]], schema: str, text: str = "text"
) -> DataFrame:
    """``mapInArrow`` over pieces of bounded text; ``work`` yields lists of arrays in the order of ``schema``."""
    at = df.columns.index(text)
    kinds = df.sparkSession.createDataFrame([], schema).schema
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, at):
                for arrays in work(part, texts):
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)

    return df.mapInArrow(run, kinds)


class Memo:
    """Results by key, of at most twice ``limit`` entries: when the young half is full, the old half goes."""

    def __init__(self, make: Callable[[Any], Any], limit: int = 300_000):
        self.make, self.limit = make, limit
        self.young: dict[Hashable, Any] = {}
        self.old: dict[Hashable, Any] = {}

    def __call__(self, key: Any) -> Any:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def many(self, keys: list) -> list:
        """The results of all keys; what is in the young half costs one look each."""
        out = list(map(self.young.get, keys))
        if None in out:
            for i in [i for i, x in enumerate(out) if x is None]:
                out[i] = self(keys[i])
        return out
