"""Token ids of the public byte-level vocabulary.

The ids are those that tokenizers gives for byte_bpe_50k.json; they are made from the same vocabulary's rank file, which
takes a fifth of the time. tests/llm compares the two.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str):
    """The encoder, made once in a process."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token, by id."""
    ranks = _ranks(path)
    out = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, k in ranks.items():
        out[k] = len(token)
    return out


def encode(text: str, path: str) -> list[int]:
    """Ids of the whole text; strings of special tokens in it are ordinary text."""
    return encoder(path).encode_ordinary(text)
