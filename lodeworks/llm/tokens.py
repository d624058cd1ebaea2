"""Token ids of whole texts, for tokenizers files with word-end BPE: NFC, lower case, and pieces that never span white space."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

from lodeworks.llm.common import kept_in_process

#: White space in the sense of Unicode, that no token spans. str.split() would also split at U+001C to U+001F.
_GAP = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
#: The splitting pattern of the file for characters below U+0250, which NFC leaves alone. Fixed values.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: Texts of these characters alone are split by that pattern; others go through the tokenizer run by run.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\x80-\u024f]+")
#: Byte-level BPE writes these bytes as characters from U+0100 on.
_SHIFTED = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class _Memory(dict):
    """What make() gives for a key, remembered in two generations: what is used again outlives the turn of them."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def turn(self, most: int) -> None:
        """Keep to twice so many keys."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class Encoder:
    """The ids of texts as little-endian 32-bit numbers.

    Runs between white space (plain ones in lower case) and their pieces are remembered, up to a bound. opened() keeps one encoder in each process,
    so that the memory outlives a task.
    """

    def __init__(self, path: str, most: int = 200_000):
        import tokenizers

        self.tokenizer, self.most = tokenizers.Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.pieces, self.plain, self.other = _Memory(self._piece), _Memory(self._plain), _Memory(self._other)
        #: Texts of the added tokens, which are found before anything is split.
        self.added = re.compile("|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHIFTED)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _plain(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(run)))

    def _other(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            memory = self.other
            if _PLAIN.fullmatch(text):
                low = text.lower()
                if not self.added.search(low):
                    memory, text = self.plain, low
            runs = filter(None, _GAP.split(text)) if _ODD.search(text) else text.split()
            out.append(b"".join(map(memory.__getitem__, runs)))
            memory.turn(self.most)
        self.pieces.turn(self.most)
        return out


def opened(path: str) -> Encoder:
    """The encoder of a file, one in each process."""
    return kept_in_process(f"encoder {path}", lambda: Encoder(path))
