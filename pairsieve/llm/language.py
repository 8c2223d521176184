"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .rows import column_of, keyed_text, map_texts, pieces_of, quoted

UNKNOWN = "und"
#: Buckets into which n-grams of one to three letters are hashed (a power of two), and letters counted at once.
BUCKETS, BLOCK = 1 << 12, 1 << 19
#: Lengths at which likeness is judged go up to 4 to this power, likenesses in this many steps.
LONGEST, STEPS = 8, 4000
_FACTORS = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: a letter in lower case, or a space for anything else."""
    return np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """How often the n-grams of one to three letters (a space at either end of a word) fall into each bucket; None: no letter."""
    total, tail, shift = None, np.asarray([32], np.uint32), np.uint32(32 - BUCKETS.bit_length() + 1)
    for begin in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[begin : begin + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate([tail, _letters()[codes], [32] if begin + BLOCK >= len(text) else []]).astype(np.uint32)
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        tail = codes[-2:]
        if len(codes) < 3:
            continue
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        one, two = b * _FACTORS[0], a * _FACTORS[1] + b * _FACTORS[2]
        three = two * _FACTORS[0] + c * _FACTORS[1] + np.uint32(1)
        for hashed in (one[b != 32], two, three):
            counts = np.bincount(((hashed ^ (hashed >> np.uint32(15))) * _FACTORS[2]) >> shift, minlength=BUCKETS)
            total = counts if total is None else total + counts
    return total


@dataclass
class LanguageModel:
    """Centroids of normalised TF-IDF vectors, several per language, and the least likeness a language accepts at a length."""

    names: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: By language: logarithms of numbers of grams, ascending, and the least likeness at each.
    sizes: list[np.ndarray] = field(default_factory=list)
    least: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, likeness (0 to 1) and whether it is rejected, for each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for begin in range(0, len(texts), 512):
            counts = [gram_counts(t) for t in texts[begin : begin + 512]]
            known = [i for i, c in enumerate(counts) if c is not None]
            if not known:
                continue
            if not self.names:
                rejected[begin + np.asarray(known)] = False
                continue
            grams = np.asarray([counts[i] for i in known])
            alike = vectors(grams, self.idf) @ self.centroids.T
            best = alike.argmax(1)
            for i, k, score, size in zip(known, best, alike[np.arange(len(known)), best], np.log2(grams.sum(1))):
                owner = self.owner[k]
                names[begin + i] = self.names[owner]
                scores[begin + i] = min(1.0, max(0.0, float(score)))
                rejected[begin + i] = score < np.interp(size, self.sizes[owner], self.least[owner])
        return names, scores, rejected


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic term frequency, each row of length 1."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clusters(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the first centre is the row nearest to the mean, each further one the row least like those before."""
    centres = [rows[(rows @ rows.mean(0)).argmax()]]
    for _ in range(min(k, len(rows)) - 1):
        centres.append(rows[(rows @ np.asarray(centres).T).max(1).argmin()])
    centres = np.asarray(centres)
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(1)
        sums = np.asarray([rows[nearest == c].sum(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC-32 of the key as text leaves that remainder; false for a NULL key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_languages(
    df: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    sample: int = 1000,
    centroids: int = 4,
    quantile: float = 0.001,
    most: float = 0.005,
    slack: float = 0.4,
    labels: int = 1000,
) -> LanguageModel:
    """A model from the rows of ``df`` whose ``lang`` is not NULL and whose text has letters.

    Document frequencies come from all of them: each task sends one sum per bucket. Centroids come from the ``sample``
    distinct texts of each language with the smallest hashes, or all if there are fewer (so the choice does not depend on keys,
    order or copies, and every language whose texts have letters has centroids). Each language is clustered in a task of its
    own, over its sample. What a language accepts is calibrated on all its rows (``calibrate``). What reaches the driver is
    ``BUCKETS`` sums, a few more hashes than ``sample``, ``centroids`` vectors and at most ``(LONGEST + 1) * (STEPS + 1)`` counts
    per language, whatever the size of the table. More than ``labels`` different values of ``lang`` are an error that counts
    them: such a column names something else, and all of this would grow with it.
    """
    spark = df.sparkSession
    source = df.select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"), F.col(quoted(lang)).cast("string").alias("lang"))
    source = source.where(F.col("lang").isNotNull())
    place = F.xxhash64(F.lit(11), "text")

    def count(batches):
        documents, sums = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, texts in pieces_of(batch, 0):
                seen = {}
                for t, name, at in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
                    counts = gram_counts(t)
                    if counts is not None:
                        documents += 1
                        sums[np.flatnonzero(counts)] += 1
                        seen[name, at] = None
                if seen:
                    yield _batch([n for n, _ in seen], [at for _, at in seen], [None] * len(seen))
        yield _batch([None], [None], [[*sums.tolist(), documents]])

    source = source.withColumn("place", place)
    counted = materialise(source.mapInArrow(count, "lang string, place long, counts array<long>"), "counts")
    frequency = np.zeros(BUCKETS + 1)
    summed = counted.where("lang is null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        frequency[r.bucket] = r.n
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)
    limits = smallest_places(counted.where("lang is not null").select("lang", "place").distinct(), sample, labels)
    if not limits:
        return LanguageModel()

    def grams(batches):
        done = set()
        for batch in batches:
            for part, texts in pieces_of(batch, 0):
                rows = []
                for t, name, at in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if (name, at) not in done and (counts := gram_counts(t)) is not None:
                        done.add((name, at))
                        rows.append((name, at, np.stack([np.flatnonzero(counts), counts[np.flatnonzero(counts)]]).ravel()))
                if rows:
                    yield _batch(*map(list, zip(*rows)))

    bounds = F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, limit long"))
    few = source.join(bounds, "lang").where("place <= limit").select("text", "lang", "place")
    few = materialise(few.mapInArrow(grams, "lang string, place long, counts array<long>"), "grams").dropDuplicates(["lang", "place"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(group), BUCKETS), np.float32)
        for i, both in enumerate(group.sort_values("place")["counts"]):
            there, n = np.asarray(both).reshape(2, -1)
            counts[i, there] = n
        centres = clusters(vectors(counts, idf), centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.astype(float) for c in centres]})

    fitted = few.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>")
    found = sorted(fitted.collect(), key=lambda r: r.lang)
    names = sorted({r.lang for r in found})
    model = LanguageModel(
        names,
        idf,
        np.asarray([r.centre for r in found], np.float32).reshape(-1, BUCKETS),
        np.asarray([names.index(r.lang) for r in found], np.int64),
    )
    return calibrate(source.select("text", "lang"), model, quantile, most, slack)


def _batch(langs: list, places: list, counts: list) -> pa.RecordBatch:
    arrays = [pa.array(langs, pa.string()), pa.array(places, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "place", "counts"])


def smallest_places(distinct: DataFrame, sample: int, labels: int = 1000) -> dict[str, int]:
    """The ``sample``-th smallest ``place`` (or the largest) of each ``lang``, from distinct uniform rows ``lang, place``.

    Places below a bound that leaves a few more than ``sample`` reach the driver; where it left too few it is doubled.
    """
    counted = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.limit(labels + 1).collect()}
    if len(sizes) > labels:
        raise ValueError(f"{counted.count()} different labels; {labels} are allowed")
    limits, shares = {}, {name: (sample + 8 * sample**0.5 + 32) / n for name, n in sizes.items()}
    while shares:
        bounds = [(name, min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))) for name, share in shares.items()]
        bounds = F.broadcast(distinct.sparkSession.createDataFrame(bounds, "lang string, bound long"))
        found: dict[str, list[int]] = {}
        for r in distinct.join(bounds, "lang").where("place <= bound").select("lang", "place").collect():
            found.setdefault(r.lang, []).append(r.place)
        for name in list(shares):
            places = sorted(found.get(name, []))
            if len(places) >= min(sample, sizes[name]):
                limits[name] = places[: sample][-1]
                del shares[name]
            else:
                shares[name] *= 2
    return limits


def size_class(counts: np.ndarray) -> np.ndarray:
    """About the power of 4 that a text of as many grams has as its number of characters, from 0 to ``LONGEST``."""
    return np.clip(np.rint(np.log2(counts.sum(1) / 3.4) / 2), 0, LONGEST).astype(int)


def noise(k: int, n: int = 32) -> list[str]:
    """Texts of ``4 ** k`` random characters: half of Latin letters and spaces, half as in base64."""
    random, letters = np.random.default_rng(k), "abcdefghijklmnopqrstuvwxyz"
    kinds = (np.asarray([*letters, *"    "]), np.asarray([*letters, *letters.upper(), *"0123456789+/"]))
    return ["".join(random.choice(kinds[i % 2], 4**k)) for i in range(n)]


def calibrate(source: DataFrame, model: LanguageModel, quantile: float, most: float, slack: float) -> LanguageModel:
    """Sets the least likeness by language and length, from all rows ``text, lang`` and their first 4, 16, 64 … characters.

    A short text is less like its language than a long one, and so is noise; both are judged at their own length. The
    limit lies a tenth above the likeness of noise, but not below the ``quantile`` of the labelled texts of that
    length and not above their quantile ``most``. Quantiles of fewer rows than they need are lowered, down to ``slack`` times.
    A scan: tasks send counts by language, length and likeness in steps of 1 / ``STEPS``.
    """
    shared = source.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model, sums, waiting = shared.value, {}, []

        def judge():
            counts = np.asarray([c for _, c in waiting])
            alike, ks, sizes = vectors(counts, model.idf) @ model.centroids.T, size_class(counts), np.log2(counts.sum(1))
            for (name, _), row, k, size in zip(waiting, alike, ks, sizes):
                step = int(np.clip(row[model.owner == model.names.index(name)].max(), 0, 1) * STEPS)
                n, total = sums.get((name, k, step), (0, 0.0))
                sums[name, k, step] = n + 1, total + size
            waiting.clear()

        for batch in batches:
            for part, texts in pieces_of(batch, 0):
                for t, name in zip(texts, part.column(1).to_pylist()):
                    for cut in [4**k for k in range(1, LONGEST + 1) if 4**k < len(t)] + [len(t)]:
                        counts = gram_counts(t[:cut])
                        if counts is not None:
                            waiting.append((name, counts))
                    if len(waiting) >= 512:
                        judge()
        if waiting:
            judge()
        kinds = {"lang": pa.string(), "k": pa.int32(), "step": pa.int32(), "n": pa.int64(), "size": pa.float64()}
        rows = [(name, k, step, n, total) for (name, k, step), (n, total) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    counted = source.mapInArrow(work, "lang string, k int, step int, n long, size double")
    seen: dict[tuple[str, int], list] = {}
    for r in counted.groupBy("lang", "k", "step").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect():
        seen.setdefault((r.lang, r.k), []).append((r.step, r.n, r["size"]))

    grams = {k: np.asarray([c for t in noise(k) if (c := gram_counts(t)) is not None]) for k in {k for _, k in seen}}
    heard = {k: (vectors(c, model.idf) @ model.centroids.T).max(0) if len(c) else np.zeros(len(model.owner)) for k, c in grams.items()}
    for i, name in enumerate(model.names):
        points = []
        for k in sorted(k for n, k in seen if n == name):
            steps, n, total = map(np.asarray, zip(*sorted(seen[name, k])))
            whole = n.sum()
            low, high = (
                steps[np.searchsorted(np.cumsum(n), q * whole)] / STEPS * slack ** (1 - min(1.0, q * whole)) for q in (quantile, most)
            )
            points.append((total.sum() / whole, max(low, min(high, 1.1 * heard[k][model.owner == i].max()))))
        model.sizes.append(np.asarray([p[0] for p in points]))
        model.least.append(np.asarray([p[1] for p in points]))
    return model


def predict_languages(df: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row: a scan.

    ``lang_pred`` is the language of the most similar centroid (of equals, the first by name) and ``score`` the cosine; a text
    less like it than its language accepts at that length is ``rejected``. NULL texts and texts without a letter are ``und``, score 0,
    rejected. A model without languages says ``und`` and rejects nothing that has a letter. Repeated rows are judged one by
    one; an empty table gives an empty result; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(part, texts):
        yield [part.column(0), *shared.value.predict(texts)]

    source = keyed_text(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, work, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``: fitted on the rows that are not held out, predicted for all."""
    learn = F.col(quoted(key)).isNotNull() & ~held_out(F.col(quoted(key)))
    model = fit_languages(df.where(learn), text=text, lang=lang, **fit)
    found = predict_languages(df, model, key=key, text=text)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_accepted(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """The rows of ``df``, with all columns, that the model fitted on its labelled rows accepts. No shuffle of rows.

    NULL texts, empty ones and those without a letter go. Without any labelled row nothing else does. Rows are judged one by one,
    so repeated rows share their fate; rows with a NULL key are judged but not learned from. An empty table gives an empty one.
    """
    learn = F.col(quoted(key)).isNotNull() & ~held_out(F.col(quoted(key)))
    model = df.sparkSession.sparkContext.broadcast(fit_languages(df.where(learn), text=text, lang=lang, **fit))
    at = column_of(df, text)

    def run(batches):
        for batch in batches:
            for part, texts in pieces_of(batch, at):
                rejected = model.value.predict([t or "" for t in texts])[2]
                yield part.filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)
