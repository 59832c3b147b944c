"""Token ids of whole texts by a public tokenizer, with the ids of recurring words remembered."""

from __future__ import annotations

import os
from array import array

import numpy as np
from tokenizers import Tokenizer


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS = _byte_letters()
#: Letters below this are composed, and their lower case doesn't depend on their neighbours.
LATIN, ENDS = "\u0250", frozenset(",.;:!?")


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``: with ``added``, as the library does by itself, else with special
    tokens' strings as ordinary text (``encode_special_tokens``).

    A text is cut at single spaces between printable characters. Neither of the two vocabularies' splitting patterns
    crosses such a place (a space only ever opens a token, or is dropped), so the ids of the pieces make up the ids of the
    text. New pieces pass the library's normalizer, splitter and model by themselves, which spares what a full encoding
    builds around them; Latin words, with a punctuation mark after them or without, go to the model at once. Any other text,
    with runs of spaces or white space beside them, is encoded in one go; so is one that holds an added token's string,
    if these count.
    """

    def __init__(self, path: str, remember: int, added: bool = False):
        """``remember``: pieces kept, some 200 bytes each; after eight times as many beyond them all are forgotten."""
        self.remember = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        # a token that is looked for in the normalized text may stand in any text
        self.whole = [""] if any(t.normalized for t in tokens) and self.tokenizer.normalizer is not None else [t.content for t in tokens]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes | bool] = {}  # False: the piece can't stand alone
        self.beyond = 0
        self.units: dict[str, bytes] = {}  # what the splitter's recurring short units come to
        t, split = self.tokenizer, lambda x: [u for u, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        self.lower = t.normalizer is not None
        self.opener = {("Ġab", ","): "Ġ", ("ab", ","): ""}.get(tuple(split(" ab,")))  # None: no shortcut
        if self.lower and t.normalizer.normalize_str("Aé b\n") != "aé b ":
            self.opener = None

    def _unit(self, unit: str) -> bytes:
        out = array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(unit)]).tobytes()
        if len(unit) < 4 and len(self.units) < 50_000:
            self.units[unit] = out
        return out

    def _plain(self, piece: str) -> str:
        """The piece as the normalizer leaves it; one of ASCII only is lower-cased at most."""
        n = self.tokenizer.normalizer
        return piece if n is None or piece.isascii() and piece.islower() else n.normalize_str(piece)

    def _latin(self, piece: str, fresh: dict) -> bytes | None:
        """The ids of a Latin word and the mark after it, None for any other piece."""
        word, end = piece.lower() if self.lower else piece, b""
        if not word.isalpha():
            if word[-1] not in ENDS or not word[:-1].isalpha():
                return None
            end = self.units.get(word[-1]) or self._unit(word[-1])
            word = word[:-1]
        known = self.known.get(word) or fresh.get(word)
        return (known or self._unit(self.opener + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)))) + end

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes | bool]:
        """The ids of new pieces; a key that starts with NUL stands at a text's start, others follow a space."""
        out: dict[str, bytes | bool] = {}
        inner = []
        for p in new:
            core = p[1:] if p[0] == "\0" else p
            a, b = core[0], core[-1]
            if not (a.isprintable() and b.isprintable()) or a.isspace() or b.isspace():
                out[p] = False
            elif core is p:
                x = self._latin(p, out) if self.opener is not None and (p.isascii() or max(p) < LATIN) else None
                if x is None:
                    inner.append(p)
                else:
                    out[p] = x
            else:
                out[p] = self._ids(core)
        if inner:
            plain = [self._plain(p) for p in inner]
            starts = np.cumsum([len(p) + 1 for p in plain]).tolist()
            parts: list[list[bytes]] = [[] for _ in inner]
            i = 0
            for unit, (at, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(" " + " ".join(plain)):
                while at >= starts[i]:
                    i += 1
                parts[i].append(self.units.get(unit) or self._unit(unit))
            for p, x in zip(inner, parts, strict=True):
                out[p] = b"".join(x)
        if len(self.known) < self.remember:
            self.known |= out
        else:
            self.beyond += len(out)
        if self.beyond > 8 * self.remember:
            self.known.clear()
            self.beyond = 0
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``dtype``."""
        out: list[bytes] = []
        for i in range(0, len(texts), 32):
            found, new = [], {}
            for text in texts[i : i + 32]:
                pieces = (text or "").split(" ")
                if "" in pieces or any(x in text for x in self.whole):  # an empty text, spaces side by side or at an end, an added token
                    found.append((text, None, None))
                    continue
                pieces[0] = "\0" + pieces[0]
                got = list(map(self.known.get, pieces))
                if None in got:
                    new |= dict.fromkeys(p for p, x in zip(pieces, got, strict=True) if x is None)
                found.append((text, pieces, got))
            learned = self._learn(list(new)) if new else {}
            for text, pieces, got in found:
                if pieces is None:
                    out.append(self._ids(text) if text else b"")
                    continue
                if new and None in got:
                    got = [learned[p] if x is None else x for p, x in zip(pieces, got, strict=True)]
                out.append(self._ids(text) if False in got else b"".join(got))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, remember: int = 800_000, added: bool = False) -> Encoder:
    """The worker's own encoder of this tokenizer file; a worker serves many tasks, and keeps the encoder it used last."""
    key = (path, remember, added)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, remember, added)
    return _ENCODERS[key]


def forget() -> None:
    """Frees the worker's encoder, for jobs whose other stages need the memory."""
    _ENCODERS.clear()
