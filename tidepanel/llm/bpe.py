"""Byte-level BPE ids of whole texts.

Texts of ASCII and Latin letters go to ``tiktoken`` with the tokenizer's own
ranks and rule, which is several times faster; any other text, or one with the
special token's string, goes to the ``tokenizers`` library. Both give that
library's ids.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ƺ]|<\\|endoftext")  # Latin letters: one category in every Unicode version
_loaded: dict[str, BytePieces] = {}


def needs_library(text: str) -> bool:
    """False only where the quicker encoder surely gives the library's ids."""
    return bool(_OTHER.search(text))


class BytePieces:
    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """All ids of the text as unsigned 32-bit machine words, no special tokens added."""
        if not text:
            return b""
        if _OTHER.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()


def load(name: str) -> BytePieces:
    if name not in _loaded:
        _loaded[name] = BytePieces(name)
    return _loaded[name]
