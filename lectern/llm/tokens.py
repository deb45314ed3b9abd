"""Encoding by a public byte-level vocabulary.

``tiktoken`` runs the same vocabulary and pattern as the ``tokenizers`` file
several times faster; a text that holds a special token's string, or any
character beyond the ranges on which both are tested alike, goes through
``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
import sys
import types

import public_tokenizers

#: Name of the vocabulary files in the public tokenizers' folder.
VOCABULARY = "byte_bpe_50k"


def _held(key, make):
    """``make()``, once per process: worker processes are used again by later tasks."""
    store = sys.modules.setdefault("_lectern_held", types.ModuleType("_lectern_held")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def encoder(vocabulary: str = VOCABULARY, as_text: bool = False):
    """A function from text to ids.  as_text: strings of special tokens are ordinary text."""

    def fast():
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def exact():
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        made.encode_special_tokens = as_text
        return made

    quick = _held(("fast", vocabulary), fast)
    odd = re.compile(r"[^\t\n\r -~¡-ɏЀ-ӿ‐-‧一-鿿]|<\|")

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        if odd.search(text):
            return _held(("exact", vocabulary, as_text), exact).encode(text, add_special_tokens=False).ids
        return quick(text)

    return encode
