"""Token ids by the public byte-level vocabulary.

The ids are those that the ``tokenizers`` library gives for the same vocabulary without further settings (tests compare
them): the string of a special token in a text is that token. ``path`` is the vocabulary as ranks (byte_bpe_50k.tiktoken).
"""

from __future__ import annotations

import base64
import re

import numpy as np

# Fixed values of the vocabulary: its special token.
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

#: The pattern gives up on some 800 000 blanks in a row; texts of this many characters are searched for runs.
LONG = 400_000
#: White space (the pattern's, which has not Python's U+001C to U+001F) that is cut out of a long text.
_RUN = re.compile(r"[^\S\x1c-\x1f]{1000,}")

_KEPT: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) > 0xFFFE:
        raise ValueError("ids above 65534 do not fit")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def encoder(path: str):
    """A function from a text (null: empty) to its ids as uint16; made once for each worker and path."""
    if path not in _KEPT:
        bpe = _vocabulary(path)

        def encode(text: str | None) -> np.ndarray:
            if not text:
                return np.empty(0, np.uint16)
            if len(text) >= LONG:
                return _by_runs(bpe, text)
            return bpe.encode_to_numpy(text, allowed_special="all").astype(np.uint16)

        _KEPT[path] = encode
    return _KEPT[path]


def _by_runs(bpe, text: str) -> np.ndarray:
    """Ids of a text whose long runs of white space are kept from the pattern. Between special tokens, all of a run but its last character is one
    piece of its own (``\\s+(?!\\S)``); where nothing follows all of it is. The last goes with what follows."""
    out = [np.empty(0, np.uint16)]
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(np.array([SPECIAL_ID], np.uint16))
        low = 0
        for m in _RUN.finditer(part):
            end = m.end() if m.end() == len(part) else m.end() - 1
            out.append(bpe.encode_to_numpy(part[low : m.start()]).astype(np.uint16))
            out.append(np.array(bpe._encode_single_piece(part[m.start() : end]), np.uint16))
            low = end
        out.append(bpe.encode_to_numpy(part[low:]).astype(np.uint16))
    return np.concatenate(out)
