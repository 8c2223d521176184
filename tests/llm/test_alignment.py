import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairsieve.llm import alignment as A
from pairsieve.llm.bytelevel import byte_of

from .conftest import rows_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(rows, libraries):
    """By row ``(id, text)``: all columns, from sets of ends and a counter."""
    t, sp = libraries
    as_byte = byte_of()
    of_a = {i: bytes(as_byte[c] for c in token) for token, i in t.get_vocab(False).items() if not token.startswith("<|end")}
    of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(len(sp)))]
    documents, held = [], collections.Counter()
    for key, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        wanted = (" " + (text or "")).encode()
        if b"".join(of_a[i] for i in a) != wanted or b"".join(of_b[i] for i in b) != wanted:
            a, b = [], []
        ends = [np.cumsum([len(x[i]) for i in ids], dtype=int).tolist() for x, ids in ((of_a, a), (of_b, b))]
        both, cut, begin = set(ends[0]) & set(ends[1]), [], 0
        for end in sorted(both):
            cut.append(tuple([i for i, e in zip(ids, own) if begin < e <= end] for ids, own in zip((a, b), ends)))
            begin = end
        documents.append((key, a, b, cut))
        held.update({(x, y) for g in cut for x in g[0] for y in g[1]})
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for key, a, b, cut in documents:
        links = [(x, y) for g in cut for x in g[0] for y in g[1]]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in cut)
        best, total = sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links)
        out.append((key, len(a), len(b), len(cut), len(links), best, total, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), max_size=60), st.lists(st.integers(1, 3), max_size=40), st.data())
@settings(max_examples=200, deadline=None)
def test_groups_are_those_of_common_ends(odd, run, data):
    """Stretches of one-to-one tokens between irregular groups, and ends that have nothing to do with each other."""
    a, b, at = [], [], 0
    for i, (x, y) in enumerate(odd):
        at += 10
        a += [at - 2 * k for k in range(x)][::-1]
        b += [at] if y == 1 else [at - 2 * k - 1 for k in range(1, y)][::-1] + [at]
        for _ in range(run[i] if i < len(run) else data.draw(st.integers(0, 30))):
            at += 3
            a.append(at)
            b.append(at)
    size_a, size_b = A.groups(a, b)
    both = sorted(set(a) & set(b))
    assert np.cumsum(size_a).tolist() == [a.index(e) + 1 for e in both]
    assert np.cumsum(size_b).tolist() == [b.index(e) + 1 for e in both]


def test_links_of_large_groups_are_counted_by_id(monkeypatch):
    rng = np.random.default_rng(1)
    size_a, size_b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    a, b = rng.integers(0, 4, size_a.sum()), rng.integers(0, 4, size_b.sum())

    def total():
        found = collections.Counter()
        for g, x, y, n in zip(*A.links(a, b, size_a, size_b)):
            found[g, x, y] += n
        return found

    whole = total()
    monkeypatch.setattr(A, "LARGE_GROUP", 5)
    assert total() == whole and sum(whole.values()) == int((size_a * size_b).sum())


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_libraries(libraries, text):
    aligner = _aligner()
    assert aligner.sides[0].fast is not None
    assert aligner.sides[0].encode(text) == libraries[0].encode(text, add_special_tokens=False).ids


_held = []


def _aligner():
    if not _held:
        _held.append(A.Aligner(open(BYTES, "rb").read(), open(PIECES, "rb").read()))
    return _held[0]


@pytest.mark.parametrize("piece", [1, 30_000, 10**9])
def test_equals_a_plain_version_whatever_the_pieces(spark, small, libraries, piece):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(map(tuple, A.align(df, BYTES, PIECES, piece_chars=piece).collect()), key=repr) == plain(rows_of(df), libraries)


def test_awkward_rows(spark, awkward, nothing, libraries):
    more = [(20, "<|endoftext|> in a text </s> <unk>", None), (21, "a▁b", None), (22, "ﬁ ligature and", None), (22, "é", None)]
    more += [(23, "  two  spaces ", None), (24, "\r\n\t", None), (25, "\U0001d4d0" * 3000, None), (26, " " * 40_000, None)]
    df = awkward.select("doc_id", "text", "ids").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, ids string"))
    got = A.align(df, BYTES, PIECES)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows_of(df), libraries)
    assert got.where("doc_id = 21").first().n_a == 0
    assert A.align(nothing, BYTES, PIECES).count() == 0
    assert A.align(awkward, BYTES, PIECES).count() == awkward.count()
