"""Byte-level BPE token ids of whole texts, in batches, by a public vocabulary file."""

from __future__ import annotations

import base64
import functools
import re

#: Fixed value: how texts are cut before merging, as the vocabulary's own pre-tokeniser does.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The added tokens of the vocabulary's tokenizers file, which match in ordinary text.
ADDED = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The ids of the same vocabulary's tokenizers file (a test holds them together), faster."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longer texts are encoded piece by piece, cut where a letter follows white space's first blank.
SLICE = 1 << 16


def encode(enc, text: str) -> list[int]:
    """Ids of a text between added tokens, whose strings are ordinary text here; lone surrogates become '?'."""
    if len(text) <= SLICE:
        return enc.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        # a cut between a letter and a single blank before a letter never splits a pre-token
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1:end + 2].isalpha()):
            end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def encode_whole(enc, text: str) -> list[int]:
    """Ids of a whole text as the tokenizers file gives them: an added token's string is its id."""
    if not any(t in text for t in ADDED):
        return encode(enc, text)
    out = []
    for piece in re.split(f"({'|'.join(map(re.escape, ADDED))})", text):
        out += [ADDED[piece]] if piece in ADDED else encode(enc, piece)
    return out
