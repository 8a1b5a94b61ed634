"""Public byte-pair tokenizers and the cutting of texts into words that can be encoded one by one.

A word here is what stands between two single spaces.  A token never spans such a space from left to right: it
either ends before the space or begins with it, and only runs of white space look ahead.  So the ids of a text are
the ids of its words, each with its leading space, in order; where a space has white space beside it, no cut is made.
"""

from __future__ import annotations

import base64
import os
import re

#: Folder of the public tokenizers' files; a parameter of every operator.
TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BESIDE_SPACE = re.compile(r" \s|\s |\A | \Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")

_ENCODERS: dict[int, object] = {}


def rank_bytes(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    """The tokenizer's rank file, read on the driver and sent with the tasks (its size is fixed, below 1 MB)."""
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
        return f.read()


def token_bytes(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}


def encoder(ranks: bytes):
    """``text -> ids`` without special tokens; made once in each Python worker."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        made = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=token_bytes(ranks), special_tokens={})
        _ENCODERS[key] = made.encode_ordinary
    return _ENCODERS[key]


def words(text: str) -> list[str]:
    """The keys of a text's words in order.

    The first word's key has one space put before it; any other key never begins with a space, and stands for a
    word with its leading space.  An empty text has none.
    """
    if not text:
        return []
    found = _CUT.split(text) if _BESIDE_SPACE.search(text) else text.split(" ")
    found[0] = " " + found[0]
    return found


def word_text(key: str) -> str:
    """The text that a key of ``words`` stands for."""
    return key[1:] if key.startswith(" ") else " " + key
