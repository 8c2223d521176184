"""SimHash near-duplicates: fingerprints within a few bits meet at a variant halfway between them."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .components import connected_components
from .rows import free_name, keyed_text, map_texts, quoted

SEED = 42
A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Tells the variants under different masks apart.
TAG = 0x9E3779B97F4A7C15
#: Variants that a task emits at most.
EMITTED = 4_000_000
#: Hashes that are counted at once.
BLOCK = 1 << 16


def simhash(text: str, shingle: int = 3) -> int:
    """64 bits: a bit is set if it is set in over half of the XXH64 of all word shingles (repeats count). No words: 0."""
    words = text.encode().translate(A_TO_Z).split()  # splits at space and the control characters 9 to 13
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    total, count = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    while block := [digest(joined[b:e], SEED) for b, e in itertools.islice(spans, BLOCK)]:
        bits = np.unpackbits(np.asarray(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, print`` of every row: the SimHash as a signed 64-bit number. NULL and empty texts have 0. A scan."""

    def work(part, texts):
        yield [part.column(0), pa.array(np.asarray([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))]

    source = keyed_text(df, key, text)
    return map_texts(source, work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, print long")


# --- Meeting in the middle ---------------------------------------------------------------------------------------------


def screen_masks(distance: int, near: int) -> list[int]:
    """Masks that each forget one block of bits. Of ``distance`` different bits, some block holds ``distance - 2·near``."""
    forget = distance - 2 * near
    if not forget:
        return [(1 << 64) - 1]
    blocks = [((1 << 16) - 1) << (16 * i) for i in range(4)]
    return [((1 << 64) - 1) ^ sum(c) for c in itertools.combinations(blocks, forget)]


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most ``most`` of the bits."""
    return np.asarray(
        [sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(bits, n)], np.uint64
    )


def _far(distance: int) -> np.ndarray:
    """Masks of the far half of the way. Three different bits have two in one half of the word; so pairs within a half do."""
    far = distance - distance // 2
    if distance == 3:
        low, high = flips(list(range(32)), 2), flips(list(range(32, 64)), 2)
        return np.unique(np.concatenate([low, high]))
    return flips(list(range(64)), far)


def _emit(prints: DataFrame, sets: list[tuple[int, int, np.ndarray]], near: np.ndarray | None = None) -> DataFrame:
    """``variant, print`` (and ``near``): every print with every flip of every set ``(tag, kept bits, flips)``.

    The tag keeps the sets apart; where it does not, prints meet without need, which the later steps find out.
    """
    names = ["variant", "print"] + ["near"] * (near is not None)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(begin, 256).to_numpy().view(np.uint64)
                for tag, mask, flipped in sets:
                    keys = ((own & np.uint64(mask))[:, None] ^ flipped[None, :] ^ np.uint64(tag * TAG % (1 << 64))).ravel()
                    columns = [keys.view(np.int64), np.repeat(own, len(flipped)).view(np.int64)]
                    if near is not None:
                        columns.append(np.tile(near, len(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    # So many tasks that none emits more than EMITTED rows, however few files the prints lie in.
    tasks = -(-prints.count() * sum(len(f) for _, _, f in sets) // EMITTED)
    spread = prints.select("print").repartition(tasks) if tasks > 1 else prints.select("print")
    return spread.mapInArrow(run, "variant long, print long" + ", near boolean" * (near is not None))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``a, b``: links between distinct prints (column ``print``) within ``distance`` bits, enough to connect all that are.

    Meet-in-the-middle ball hashing. Two prints within ``distance`` bits have a variant between them: at most
    ``near = distance // 2`` bits from one, the rest from the other. Each print emits its variants, the variants are the
    shuffle key, and prints that meet are linked.

    *Screen.* Most prints have no neighbour, so a smaller ball finds those that may have one: under each of some masks that
    forget one block of 16 bits, a print emits the variants within ``near`` bits. For an odd distance the bit left over lies
    in some block; forgetting it, what remains is met half way from both sides. A print alone at all its variants has
    no neighbour. (49 variants under each of 4 masks for 3 bits, against 1,057 below.)

    *Ball.* The others emit every variant within ``near`` bits and within the rest of the way. Where a print within ``near``
    of a variant meets others within the rest, each is within ``distance`` of it by the triangle inequality: they
    are linked to the smallest such print, one link each, never all pairs. Links are verified by counting bits before they
    are returned.
    """
    near = distance // 2
    screen = []
    for tag, mask in enumerate(screen_masks(distance, near)):
        screen.append((tag, mask, flips([b for b in range(64) if mask >> b & 1], near)))
    at = Window.partitionBy("variant")
    met = _emit(prints, screen).withColumn("low", F.min("print").over(at)).withColumn("high", F.max("print").over(at))
    crowded = materialise(met.where("low <> high").select("print").distinct(), "crowded")

    close = flips(list(range(64)), near)
    wide = np.union1d(close, _far(distance))
    ball = _emit(crowded, [(0, (1 << 64) - 1, wide)], np.isin(wide, close))
    hubs = ball.withColumn("hub", F.min(F.when(F.col("near"), F.col("print"))).over(at)).where("print <> hub")
    found = hubs.select(F.col("hub").alias("a"), F.col("print").alias("b")).distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


# --- Groups ------------------------------------------------------------------------------------------------------------

#: A print with more than one row in so many is frequent; there are fewer such prints than this number.
FREQUENT = 1000


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """``rows`` (a stored table with ``doc_id, print``) with ``root``, the smallest print of its component."""
    prints = materialise(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "prints")
    total = prints.agg(F.sum("n")).first()[0] or 0
    roots = connected_components(links(prints, distance))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = materialise(rooted.select("print", "n", F.coalesce("root", "print").alias("root")), "roots")
    # Rows of frequent prints, fewer than FREQUENT of them, meet a broadcast; no other print has many rows.
    frequent = rooted.where(F.col("n") * FREQUENT > total).select("print", "root")
    other = rooted.where(F.col("n") * FREQUENT <= total).select("print", "root")
    plain = rows.join(F.broadcast(frequent.select("print")), "print", "left_anti")
    return rows.join(F.broadcast(frequent), "print").unionByName(plain.join(other, "print"))


def _with_winner(rooted: DataFrame, best: Column) -> DataFrame:
    """``rooted`` with ``best`` over each root: a broadcast where a root has many rows, a shuffle where it does not."""
    roots = materialise(rooted.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("n")), "winners")
    total = roots.agg(F.sum("n")).first()[0] or 0
    frequent, other = (
        roots.where(c).select("root", "best") for c in (F.col("n") * FREQUENT > total, F.col("n") * FREQUENT <= total)
    )
    plain = rooted.join(F.broadcast(frequent.select("root")), "root", "left_anti")
    return rooted.join(F.broadcast(frequent), "root").unionByName(plain.join(other, "root"))


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lowercase hex digits. Rows whose fingerprints differ in at most ``distance`` bits (up to 4) are
    linked; ``component_id`` is the smallest key that links lead to, the row itself included. Texts are read once, for the
    fingerprints, which are stored; everything after works on distinct fingerprints, so copies cost one row each.

    NULL and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Fewer words than a
    shingle count as one. NULL keys are ignored as component ids (NULL if a component has no other). Repeated rows get
    a row each; an empty table gives an empty result; other columns are not read.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distances from 0 to 4 bits are supported: beyond that the balls get too large")
    rows = materialise(fingerprints(df, key=key, text=text, shingle=shingle), "fingerprints")
    found = _with_winner(_components(rows, distance), F.min("doc_id"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("best").alias("component_id"))


def drop_near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``df``: the one with the smallest key.

    A row is known by its key and a hash of its text; NULL keys come last, of equal keys the smaller hash stays, and of rows
    equal in both any one. NULL text counts as empty and stays NULL. Texts are shuffled once, by a string of both.
    """
    mark = free_name(df, "row_mark")
    hashed = F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit("")))
    source = keyed_text(df, key, text, text_key=hashed)
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(part, texts):
        prints = np.asarray([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
        yield [part.column(0), part.column(2), pa.array(prints)]

    rows = materialise(map_texts(source, work, f"doc_id {kind}, text_key long, print long"), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    winners = _components(rows, distance).groupBy("root").agg(best.alias("best"))
    kept = winners.select(_mark(F.col("best.text_key"), F.col("best.doc_id")).alias(mark))
    marked = df.withColumn(mark, _mark(hashed, F.col(quoted(key))))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)


def _mark(text_key: Column, key: Column) -> Column:
    return F.concat(text_key.cast("string"), F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("")))
