"""Ids of byte-level merge files, as their own library gives them."""

from __future__ import annotations

import json

import tiktoken
from tokenizers import Tokenizer

#: Words as a byte-level file with its default split makes them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level file stands for: its own where it can be seen, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Tokens of a byte-level merge file, and the bytes of each. No tokens are added around a text.

    Where the file merges by ascending id, ids come from the same merges by rank, which takes a third of the time and keeps
    nothing between texts; for any other file, where a text is refused, and where it holds a special token's string that is to be
    recognised, the file's library is asked.
    """

    def __init__(self, data: bytes, special_is_text: bool):
        spec = json.loads(data)
        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = special_is_text
        added = spec.get("added_tokens", [])
        self.special = [] if special_is_text else [t["content"] for t in added]
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.bytes: list[bytes] = [b""] * self.library.get_vocab_size()
        self.fast = None
        if plain and spec.get("normalizer") is None and spec["model"].get("type") == "BPE":
            known, as_byte = {t["id"] for t in added}, byte_of()
            vocabulary = {token: i for token, i in spec["model"]["vocab"].items() if i not in known}
            for token, i in vocabulary.items():
                self.bytes[i] = bytes(as_byte[c] for c in token)
            made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
            if made == sorted(made) and not spec["model"].get("ignore_merges"):
                ranks = {b: i for i, b in enumerate(self.bytes) if b}
                self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # its split gives up on very long runs
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def joined(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids) if self.fast is not None else b"".join(map(self.bytes.__getitem__, ids))
