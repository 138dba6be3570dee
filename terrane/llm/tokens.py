"""Token ids inside tasks. A vocabulary is a file, given by its path; nothing is trained or copied."""

from __future__ import annotations

import base64
import json
import struct
from functools import lru_cache

import numpy as np
import regex

#: Characters on which lower-casing, composition and classes are the same everywhere.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_MEMO = 500_000


class _Words(dict):
    """Ids of words between blanks, worked out when a word is first met."""

    def __init__(self, tokenizer, pieces, letters):
        super().__init__()
        self.model, self.pieces, self.letters = tokenizer.model, pieces, letters

    def __missing__(self, word: str) -> bytes:
        pieces = (word,) if word.isalpha() else self.pieces.findall(word)
        found = [t.id for p in pieces for t in self.model.tokenize(p if p.isascii() else p.translate(self.letters))]
        if len(self) >= _MEMO:
            self.clear()
        ids = self[word] = struct.pack(f"<{len(found)}I", *found)
        return ids


class Encoder:
    """Ids of ``tokenizers`` for whole texts.

    Where the file splits plain text into pieces that hold no blank and are encoded one by one, the ids of
    a word between blanks are remembered, because the words of a corpus repeat; any other text, and any
    text that may hold a special token, is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [t["content"] for t in described["added_tokens"]]
        pieces = self._splitter(described)
        self.words = _Words(self.tokenizer, pieces, self._byte_letters()) if pieces else None

    @staticmethod
    def _splitter(described: dict):
        """The pattern of pieces, if the file says: compose, blanks to one, lower-case, keep matches only, bytes."""
        steps = (described.get("normalizer") or {}).get("normalizers", [])
        parts = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if ([s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]
                or not parts[0]["invert"] or parts[0]["behavior"] != "Removed" or parts[1]["use_regex"] or parts[1]["add_prefix_space"]
                or described.get("post_processor")):
            return None
        return regex.compile(parts[0]["pattern"]["Regex"])

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """How the byte level writes each character of a plain text."""
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100) if _PLAIN.fullmatch(chr(c))}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.words is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


@lru_cache(2)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoding of a rank file; its special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
