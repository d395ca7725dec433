"""Ids of the public byte-level BPE vocabularies, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Texts of these characters alone (Latin letters, no unusual white space) are cut alike by both libraries' tables of
#: character classes, whatever their Unicode version; others go to the tokenizers library itself.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]")
#: The cut that a byte-level vocabulary makes before its merges (a fixed value of the public format).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _libraries(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    library_only = re.compile("|".join([_PLAIN.pattern, *map(re.escape, sorted(special))]))
    symbols = _bytes_of_symbols()
    ranks = {bytes(symbols[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tokenizer, library_only, tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_ids(text: str | None, path: str) -> np.ndarray:
    """Ids (unsigned 32-bit) of a whole text; null or empty: none. Strings of special tokens have their own ids, as in the library."""
    if not text:
        return np.zeros(0, np.uint32)
    tokenizer, library_only, plain = _libraries(path)
    if library_only.search(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(plain.encode_to_numpy(text, disallowed_special=()), np.uint32)
