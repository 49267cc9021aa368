"""Token ids of a public byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes, batch by batch.

The vocabulary's own splitting rule cuts a text into pieces whose ids do not depend on each other, so
the ids of a piece are kept in a bounded table per Python worker: most of a corpus is its common words.
Texts whose characters are all ASCII or Latin letters are split on their bytes; any other text, and one
that holds a special token's string, goes through the tokenizers library as a whole. Both ways give the
library's ids (tests compare them).
"""

import base64
import os
import re

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k"
#: Pieces whose ids a worker keeps (about 200 bytes each) before it starts afresh.
KEPT_PIECES = 120_000

#: The splitting rule over UTF-8 bytes of plain texts: there, a byte above 0x7F is part of a letter.
_PIECE = re.compile(
    rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9A-Za-z\x80-\xff]+|\s+(?!\S)|\s+"
)
#: What makes a text not plain: bytes of characters that are no Latin letters, separators, specials.
_ODD = re.compile(rb"[\x1c-\x1f\xc2\xca-\xff]|\xc3[\x97\xb7]|\xc9[\x90-\xbf]|<\|endoftext\|>")


class Encoder:
    """Ids of texts; one per worker process."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._pieces = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._texts = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self._kept: dict[bytes, bytes] = {}

    def _piece(self, piece: bytes) -> bytes:
        ids = np.array(self._pieces.encode_ordinary(piece.decode()), dtype="<u4").tobytes()
        if len(self._kept) >= KEPT_PIECES:
            self._kept.clear()
        self._kept[piece] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if _ODD.search(text):
            encoded = self._texts.encode(text.decode(), add_special_tokens=False)
            return np.array(encoded.ids, dtype="<u4").tobytes()
        kept, new = self._kept.get, self._piece
        return b"".join([kept(piece) or new(piece) for piece in _PIECE.findall(text)])


_ENCODER: Encoder | None = None


def encoder() -> Encoder:
    global _ENCODER
    if _ENCODER is None:
        _ENCODER = Encoder()
    return _ENCODER
