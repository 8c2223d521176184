import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from .plain import crc
from tokenizers import Tokenizer

from pairsieve.llm import counting, encoding, packing
from pairsieve.llm.bytelevel import ByteTokens
from pairsieve.llm.queries import BYTES, PIECES

from .conftest import rows_of

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PROTO = open(PIECES, "rb").read()
ENCODER, COUNTER = encoding.PrefixTableEncoder(PROTO), counting.TokenCounter(PROTO)
TOKENS = ByteTokens(open(BYTES, "rb").read(), special_is_text=False)
MIXED = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "<s>", "</s>", "▁", "12", ".", "...", "==", "\x00", "<0x0A>", "'s"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(MIXED), max_size=60).map("".join), st.text("abel ▁", max_size=80)))
def test_any_text_is_encoded_and_counted_as_the_library_does(text):
    want = LIBRARY.encode(text)
    assert ENCODER.encode(text)[0] == want
    assert " ".join(s for s in ENCODER.encode(text)[1]) == " ".join(map(str, want))
    assert COUNTER.count(text) == len(want)


@pytest.mark.parametrize("text", ["x" * 20_000, " " * 5_000, "abc " * 5_000, "\n" * 3_000, "aé" * 4_000])
def test_long_runs(text):
    assert ENCODER.encode(text)[0] == LIBRARY.encode(text)
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_pair_test_agrees_with_merging():
    model, rng = ENCODER.model, random.Random(9)
    pieces = sorted(model.id_of)
    short = [p for p in pieces if len(p) < 4]
    for _ in range(30_000):
        a, b = rng.choice(short if rng.random() < 0.5 else pieces), rng.choice(short if rng.random() < 0.5 else pieces)
        assert model.neighbours(a, b) == (model.merged(a + b) == [a, b]), (a, b)


def test_chunks_end_where_words_do():
    """One entry per word, whatever punctuation follows; letters that pieces join with other characters are no word's end."""
    model = ENCODER.model
    said = ["word word, word. word\nword%% (word) word3word", "²a ².", "²..a", "aé.漢1_b▁▁ c", "a  b,c", "é²."]
    for text in said:
        assert "".join(model.chunks(text)) == LIBRARY.normalize(text)
        assert ENCODER.encode(text)[0] == LIBRARY.encode(text) and COUNTER.count(text) == len(LIBRARY.encode(text))
    assert {c.strip("▁") for c in model.chunks(said[0]) if "word" in c} == {"word"}
    for pair in model.inside:  # no piece reaches over a place where a text is cut
        if "▁" not in pair:
            assert len(model.cut.findall(pair)) == 1, pair


def test_memo_is_bounded():
    memo = counting.Memo(len, 10)
    assert [memo("x" * i) for i in range(100)] == list(range(100))
    assert len(memo.young) + len(memo.old) <= 20


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*MIXED, "<|endoftext|>", "\x1c", "\x85"]), max_size=60).map("".join)))
def test_word_ids_are_those_of_the_whole_text(text):
    assert TOKENS.encode(text) == TOKENS.library.encode(text, add_special_tokens=False).ids


def test_round_trip(awkward, nothing):
    want = []
    for key, text in rows_of(awkward):
        ids = LIBRARY.encode(text or "") + [LIBRARY.eos_id()]
        decoded = LIBRARY.decode(ids)
        want.append((key, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
    got = encoding.round_trip(awkward, PIECES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert encoding.round_trip(nothing, PIECES).count() == 0


def test_encode_then_decode(awkward, nothing):
    coded = encoding.encode_pieces(awkward, PIECES)
    back = encoding.decode_pieces(coded, PIECES)
    want = [(k, LIBRARY.decode(LIBRARY.encode(t or "") + [2])) for k, t in rows_of(awkward)]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, want))
    assert encoding.decode_pieces(encoding.encode_pieces(nothing, PIECES), PIECES).count() == 0


def test_counts(awkward, nothing):
    got = counting.token_counts(awkward, PIECES, limit=100).collect()
    want = [(k, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 100) for k, t in rows_of(awkward)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert counting.token_counts(nothing, PIECES).count() == 0


@pytest.mark.parametrize("window", [1, 64, 1024])
def test_pieces_cover_every_id_once(awkward, nothing, window):
    df = awkward.repartition(3) if window > 1 else awkward.where("length(text) < 1000 or text is null")
    pieces = packing.pack(df, BYTES, window=window).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    documents, sequences = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == crc(p.ids) and 0 < p.length <= window
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    assert sorted(sequences) == list(range(len(sequences)))
    for number, held in sequences.items():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end == window or number == len(sequences) - 1
    whole = sorted(i for held in documents.values() for _, ids in held for i in ids)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows_of(df)]
    assert whole == sorted(i for ids in want for i in ids)
    single = [(k, ids) for (k, _), ids in zip(rows_of(df), want) if k not in (1, 10, None)]
    for key, ids in single:
        parts = sorted(documents[(key, len(ids))])
        assert [i for _, part in parts for i in part] == ids
        assert [start for start, _ in parts] == [sum(len(p) for _, p in parts[:j]) for j in range(len(parts))]
    assert packing.pack(nothing, BYTES).count() == 0


def test_digests_are_those_of_the_pieces(awkward):
    drop = packing.pack(awkward, BYTES).drop("ids")
    same = packing.packed_digests(awkward, BYTES)
    assert drop.columns == same.columns
    assert sorted(map(repr, drop.collect())) == sorted(map(repr, same.collect()))


def test_long_chunks_are_as_fast_as_they_are_long():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert COUNTER.count(text) == len(LIBRARY.encode(text))
