"""Token ids of a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32), as the tokenizers library gives them by default without adding special tokens: where a text holds the
    string of an added token, that is the token.

    Where the merges of the file are in the order of their ids, a rank encoder gives the same ids several times faster;
    other files, and texts that hold an added token, are left to the library.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ranked = [vocabulary.get("".join(p)) for p in pairs]
    special = {t["content"] for t in model.get("added_tokens", [])}
    library = []

    def slow(text: str) -> np.ndarray:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    if model["pre_tokenizer"].get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space") and None not in ranked and ranked == sorted(ranked) and not model.get("normalizer"):
        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(fast.encode_ordinary(text), np.uint32) if not any(t in text for t in special) else slow(text)
    return slow
