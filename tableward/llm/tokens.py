"""Token ids of a byte-level BPE vocabulary; one encoder per Python worker.

The ids are those of the public vocabulary in its ``tokenizers`` form without added special tokens (tests compare them). They are
computed from the same vocabulary as ranks, which takes about a third of the time. Texts that the rank form refuses, such as a run of
millions of white-space characters, on which its pattern runs out of stack, are encoded with the ``tokenizers`` form itself. The end-of-text
string counts as its special id in both forms.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

#: Fixed values of the public vocabulary: the string and the id of its special token.
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(ranks: str) -> tiktoken.Encoding:
    """Reads the rank file, which must be at the same path on each executor."""
    with open(ranks, "rb") as lines:
        vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={END_OF_TEXT: END_OF_TEXT_ID}
    )


@cache
def token_bytes(ranks: str) -> np.ndarray:
    """How many bytes of text each id stands for."""
    own = encoder(ranks)
    return np.array([len(own.decode_single_token_bytes(i)) for i in range(own.n_vocab)], np.int64)


@cache
def whole_encoder(ranks: str) -> tokenizers.Tokenizer:
    """The ``tokenizers`` form of the vocabulary, which lies beside the rank file under the same name."""
    return tokenizers.Tokenizer.from_file(ranks.removesuffix(".tiktoken") + ".json")


def encode(text: str, ranks: str) -> np.ndarray:
    try:
        ids = encoder(ranks).encode(text, allowed_special="all")
    except ValueError:
        ids = whole_encoder(ranks).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)
