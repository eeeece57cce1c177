"""Token ids of a public byte-level BPE vocabulary, as its own library gives them."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache


#: Runs of this many characters go to the tokenizer's own library: the other one's patterns and merges are not made for them.
RUN = 5000
_WHITE_RUN = re.compile(r"\s{%d}" % RUN)


def long_run(text: str) -> bool:
    """Whether the text may hold a pretoken of ``RUN`` characters or more, of white space or of anything else."""
    return len(text) >= RUN and (bool(_WHITE_RUN.search(text)) or max(map(len, text.replace("\n", " ").split(" "))) >= RUN)


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids without added special tokens, special strings inside a text handled as the library does by default.

    Where the same vocabulary lies beside the file as ranks, texts without special strings and very long runs go through
    the faster library.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    slow = _library(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not (path.endswith(".json") and os.path.exists(ranks)):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or long_run(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode
