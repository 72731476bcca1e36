"""Token ids of the lower-casing word tokenizer, fast enough for whole corpora.

Pre-tokens never reach across white space, so the ids of a text are those of its chunks, one after the other, and the
ids of a chunk those of its pre-tokens. Both are remembered, within a bound, for as long as a Python worker lives.
Chunks with letters beyond Latin Extended-B, and texts with the separators on which Python and the tokenizer disagree,
go to the tokenizer whole.
"""

from __future__ import annotations

from array import array

import regex
from tokenizers import Tokenizer

REMEMBERED = 400_000
#: White space for str.split, not for the tokenizer.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: What the tokenizer's own configuration splits by.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LAST_LATIN = "ɏ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            written = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            known = array("I", [token.id for token in self.tokenizer.model.tokenize(written)]).tobytes()
            self.pieces[piece] = known
        return known

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or max(chunk) > LAST_LATIN:
            return self._whole(chunk)
        return b"".join(map(self._piece, PRE_TOKENS.findall(chunk.lower())))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return [self._text(text) for text in texts]

    def _text(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self._whole(text)
        chunks, known = text.split(), self.chunks
        for new in set(chunks).difference(known):
            known[new] = self._chunk(new)
        return b"".join(map(known.__getitem__, chunks))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
