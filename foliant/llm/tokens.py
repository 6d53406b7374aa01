"""Token ids of texts by public vocabularies, and the cutting of long documents into pieces."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

END = 2
LENGTH = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids. *.tiktoken files are read as ranks of the byte-level BPE, others by tokenizers."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        special = "<|endoftext|>"
        found = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
        # tokenizers takes the special token's string in a text for the token
        return lambda text: found.encode(text, allowed_special="all") if special in text else found.encode_ordinary(text)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def encoded(path: str, text: str | None) -> array:
    """The document of a text: its ids (none for null), then END."""
    ids = array("I", encoder(path)(text) if text else ())
    ids.append(END)
    return ids


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but the first, which may be shorter."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]
