"""Fast exact encoding with public tokenizer files.

Texts are cut where the tokenizer's own pre-tokenisation must cut too, and the
ids of each piece are remembered, so the library only sees pieces that are new
to the worker process.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Entries a worker remembers; at about 200 bytes each this bounds its memory.
CACHE_ENTRIES = 700_000
#: Pieces longer than this many bytes are never remembered.
CACHE_PIECE = 64
#: Bytes of text that are cut into pieces at once.
SLICE_BYTES = 1 << 20

_RUNS = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space beyond [ \t\n\r] in UTF-8, and the bytes that it begins with or consists of.
_ODD = rb"(?:[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_ODD_NEXT = re.compile(_ODD + rb"[ \t\n\r]|[ \t\n\r]" + _ODD)
_ODD_STARTS = (b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_TWO_SPACES = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\0")
#: A full stop or comma that does not follow an ASCII letter, a digit or a letter of Latin-1, or that has its like or a mark after it.
_MARK_RUN = re.compile(rb"[.,](?:(?<![a-zA-Z0-9\x80-\xbf][.,])|(?<=[^\xc3][\x80-\xbf][.,])|(?<=\xc3[\x97\xb7][.,])|(?=[^ \t\n\r\x0b\x0ca-zA-Z0-9]))")
#: Printable ASCII and the precomposed letters of Latin-1, on which lower() and NFC act letter by letter.
_LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]*")
#: The word tokenizer's split pattern on that alphabet.
_WORD_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
_loaded: dict[tuple[str, bool], Encoder] = {}


def byte_pieces(text: bytes) -> list[bytes]:
    """Cut before each run of white space that follows something else, and between a letter and a mark.

    The byte-level pattern scans left to right without look-behind, and none of its
    matches runs from a non-space into a space or from a letter or digit into a full
    stop or comma, so these are match ends; no piece ends in white space but the last,
    so look-ahead at its end sees what it sees in the text. Where other Unicode white
    space touches a cut, the text stays whole.
    """
    if any(x in text for x in _ODD_STARTS) and _ODD_NEXT.search(text):
        return [text]
    if any(x in text for x in _TWO_SPACES):
        return _RUNS.findall(text)
    text = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n")
    if b"<|" not in text and not _MARK_RUN.search(text):
        text = text.replace(b".", b"\0.").replace(b",", b"\0,")
    return text.split(b"\0")


def word_pieces(text: bytes) -> list[bytes]:
    """Cut at ASCII white space, which the word tokenizer drops and never joins across, and around single marks."""
    if b"<|" not in text:
        text = text.lower()
        if not _MARK_RUN.search(text):
            text = text.replace(b".", b" . ").replace(b",", b" , ")
    return text.split()


class Encoder:
    """Encodes UTF-8 texts as the tokenizers library does with add_special_tokens=False."""

    def __init__(self, path: str, words: bool) -> None:
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.pieces, self.new = (word_pieces, self._new_words) if words else (byte_pieces, self._new_bytes)
        if words:
            self.letters = byte_letters()
            self.parts: dict[str, bytes] = {}
        else:
            plain = self.lib.get_vocab(with_added_tokens=False).values()
            table = byte_table(self.lib)
            ranks = {table[i]: i for i in plain}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {b"": b""}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, by the library alone."""
        found = self.lib.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        batch: list[bytes] = []
        size = 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= SLICE_BYTES:
                yield from self._some(batch)
                batch, size = [], 0
        if batch:
            yield from self._some(batch)

    def _some(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {b"": b""}
        long = {}
        for piece in set().union(*cut).difference(self.known):
            (self.known if len(piece) <= CACHE_PIECE else long)[piece] = self.new(piece)
        if not long:
            return [b"".join(map(self.known.__getitem__, p)) for p in cut]
        return [b"".join([long[x] if x in long else self.known[x] for x in p]) for p in cut]

    def _new_bytes(self, piece: bytes) -> bytes:
        """The same merges by rank, which is quicker for short pieces; the library has special tokens and long runs."""
        if b"<|" in piece or len(piece) > 1024:
            return self.whole([piece])[0]
        return array("I", self.ranked.encode_ordinary(piece.decode())).tobytes()

    def _new_words(self, piece: bytes) -> bytes:
        """Plain Latin pieces are lower-cased and split here, where both are simple; the library has the rest."""
        text = piece.decode()
        if b"<|" in piece or len(piece) > 256 or not _LATIN.fullmatch(text):
            return self.whole([piece])[0]
        out = []
        for part in _WORD_PARTS.findall(text.lower()):
            if (ids := self.parts.get(part)) is None:
                if len(self.parts) > CACHE_ENTRIES:
                    self.parts = {}
                found = self.lib.model.tokenize("".join([self.letters[b] for b in part.encode()]))
                ids = self.parts[part] = array("I", [t.id for t in found]).tobytes()
            out.append(ids)
        return b"".join(out)


def encoder(name_or_path: str = BYTE_BPE) -> Encoder:
    """The worker process's encoder for a tokenizer file."""
    words = name_or_path.rpartition("/")[2].startswith("word_")
    if (key := (name_or_path, words)) not in _loaded:
        path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
        _loaded[key] = Encoder(path, words)
    return _loaded[key]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def byte_table(lib: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    of = {c: b for b, c in enumerate(byte_letters())}
    table = [b""] * (1 + max(lib.get_vocab(with_added_tokens=True).values()))
    for token, i in lib.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(of[c] for c in token if c in of)
    for i, added in lib.get_added_tokens_decoder().items():
        table[i] = added.content.encode()
    return table


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
