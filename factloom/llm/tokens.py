"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: White space this long goes through the tokenizer itself, as regular
#: expressions that look back over it may give up.
_LONG_SPACE = re.compile(r"\s{5000}")


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids and byte lengths of texts; equals the tokenizer on the whole text.

    Texts are merged by a second library under the ranks of the same vocabulary
    file (ids are ranks there), which is several times faster.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in self.tokenizer.get_vocab().items() if piece not in added}
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for piece, i in ranks.items():
            self.sizes[i] = len(piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, as uint32."""
        if _LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.merge.encode_to_numpy(text).astype("<u4", copy=False)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
