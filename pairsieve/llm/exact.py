"""Exact deduplication with the frequent texts split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .rows import free_name, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. For texts of one byte a character ``lower`` does the same, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case, as lowercase hex; NULL counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def duplicate_groups(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", frequent: int = 1024, tracked: int = 8192
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows with equal texts (up to A-Z case) form a group; the row with the largest key stays. Heavy-hitter split, in
    DataFrame functions only:

    1. Digests go to a table in the shared folder, so texts are read once and no text is shuffled.
    2. ``approx_top_k``, a Misra-Gries summary that keeps ``tracked`` counters per task and merges them, names at most
       ``frequent`` digests that may be frequent. Every digest with more than about ``rows / tracked`` rows is among them.
    3. Their exact sizes and winners are computed (partial sums per task, one row each in the end) and broadcast: at most
       ``frequent`` rows whatever the size of the data. The members of these groups are finished without a shuffle.
    4. The remaining digests are grouped by an ordinary shuffle; none of them is frequent. What the summary misses or
       names without need only changes which of the two ways a group takes.

    NULL text counts as empty. Of rows that repeat key and text exactly one stays. A NULL key is smaller than any other: a
    group of NULL keys keeps one of its rows, with a NULL ``keep_id``. An empty table gives an empty result; other columns
    are not read.
    """
    row = df.select(
        F.col(quoted(key)).alias("doc_id"), digest(F.col(quoted(text))).alias("text_sha256")
    ).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(row, "digests")
    return _groups(rows, frequent, tracked).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _groups(rows: DataFrame, frequent: int, tracked: int) -> DataFrame:
    """``doc_id, text_sha256, row`` with ``keep_id, group_size, kept``; ``rows`` is a stored table."""
    best, size = F.max(F.struct("doc_id", "row")), F.count(F.lit(1))
    top = rows.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    candidates = top.where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    members = rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
    winners = materialise(members.groupBy("text_sha256").agg(best.alias("best"), size.alias("group_size")), "winners")

    heavy = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = (
        rows.join(F.broadcast(winners), "text_sha256", "left_anti")
        .withColumn("best", best.over(group))
        .withColumn("group_size", size.over(group))
    )
    return heavy.unionByName(light).select(
        "doc_id",
        "text_sha256",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", frequent: int = 1024, tracked: int = 8192) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; which ones as in ``duplicate_groups``.

    Texts are shuffled once: a row carries its digest and key as one string, by which it meets the list of kept ones, and rows
    equal in it, which are then in one place, become one. Of rows that repeat key and text any one stays. NULL text
    counts as empty and stays NULL. Column names may be anything: the one helper column gets a name that ``df`` does not have.
    """
    groups = duplicate_groups(df, key=key, text=text, frequent=frequent, tracked=tracked)
    mark = free_name(df, "row_mark")
    kept = groups.where("kept").select(_mark(F.col("text_sha256"), F.col("doc_id")).alias(mark))
    marked = df.withColumn(mark, _mark(digest(F.col(quoted(text))), F.col(quoted(key))))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)


def _mark(digest: Column, key: Column) -> Column:
    """Digest and key as one string that is never NULL; a NULL key differs from any other."""
    return F.concat(digest, F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("")))
