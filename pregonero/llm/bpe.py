"""Whole texts through the tokenizer libraries, each distinct piece of a text once.

A text is cut at single spaces between two printed characters. Neither kind of tokenizer joins anything over such a place:
a byte-level pre-tokenizer starts a new word there, and no piece of a sentence-piece vocabulary holds a space after another
character (both classes look at their files and cut nothing where that isn't so). So the library sees a piece once as long as
it is in the worker's cache, and a text's ids are its pieces' ids in a row. A full cache is emptied.

Tokenizer files are read on the driver, by a path given, and sent as text or bytes; their size is that of one vocabulary.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that are no white space by any definition; a space between two of them is a place to cut.
CUT = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])")
ENDS = re.compile(r"(?s)(?=[!-~¡-ᙿ]).*[!-~¡-ᙿ]\Z")
#: Pieces encoded as one text.
JOINED = 100
CACHED_PIECES = 600_000
SPACE_MARK = "▁"


def byte_level_bytes() -> dict[str, int]:
    """Byte-level alphabet: printed Latin-1 characters are themselves, the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


BYTES = byte_level_bytes()
ALPHABET = {b: c for c, b in BYTES.items()}
SPACE = ALPHABET[0x20]


def kept_in_worker(name: str) -> dict:
    """What a worker process keeps for its next tasks under a name."""
    kept = sys.modules.setdefault("pregonero_kept_pieces", types.ModuleType("pregonero_kept_pieces"))
    return vars(kept).setdefault(name, {})


def learn_joined(pieces: list[str], ids: np.ndarray, spaced: np.ndarray, known: dict[str, bytes | None]) -> bool:
    """Learns pieces from the ids of one text, where each stands after a space: a piece's ids begin at a token that begins with
    a space. False, with nothing learnt, if there are more or fewer of them than pieces."""
    starts = np.flatnonzero(spaced[ids])
    if len(starts) != len(pieces) or starts[0]:
        return False
    whole, bounds = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
    known.update(zip(pieces, map(whole.__getitem__, map(slice, bounds, bounds[1:]))))
    return True


def crosses(token: str) -> bool:
    """Whether a token of the byte-level alphabet holds a place where the pre-tokenizer cuts a text of plain pieces: between
    letters, digits and other characters, and around white space that is not one space before them."""
    kinds = {
        "space" if b in b" \t\n\v\f\r" else "digit" if 0x30 <= b <= 0x39 else "letter" if b >= 0x80 or chr(b).isalpha() else "other"
        for b in (BYTES.get(c, 0) for c in (token[1:] if token[:1] == SPACE else token))
    }
    return len(kinds) > 1 or (kinds == {"space"} and len(token) > 1)


class ByteLevel:
    """A byte-level BPE of the tokenizers library, in a task."""

    adds_space = False

    def __init__(self, json_text: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.name = f"bytes-{zlib.crc32(json_text.encode())}-{specials_are_text}"
        self.tokenizer, self.joined, self.cuts, self.plain, self.spaced, self.crossing = kept_in_worker("libraries").get(self.name) or self._read(json_text)
        self.tokenizer.encode_special_tokens = specials_are_text
        kept_in_worker("libraries")[self.name] = self.tokenizer, self.joined, self.cuts, self.plain, self.spaced, self.crossing

    @staticmethod
    def _read(json_text: str) -> tuple:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(json_text)
        said = json.loads(json_text)
        before, added = said["pre_tokenizer"] or {}, [t["content"] for t in said["added_tokens"]]
        cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not said["normalizer"]
            and said["model"]["type"] == "BPE" and not any(" " in t for t in added)
        )
        first = "".join(sorted({t[0] for t in added if t} | {"'"}))
        part = f"(?![{re.escape(first)}])[!-~À-ÖØ-öø-ɏ]"
        vocabulary = tokenizer.get_vocab()
        spaced, crossing = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        for token, number in vocabulary.items():
            spaced[number], crossing[number] = token.startswith(SPACE) and token not in added, crosses(token)
        return tokenizer, Tokenizer(tokenizer.model), cuts, re.compile(f"(?:{part})+(?:\n(?:{part})+)*"), spaced, crossing

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str], known: dict[str, bytes | None]) -> None:
        """Ids of pieces after a space. Pieces of letters, digits, signs and single line breaks go to the library's model many at
        a time and without its pre-tokenizer. No token crossed a place where that cuts if none of those that came out does: what
        is merged once stays so. Else, and with apostrophes or other characters, pieces are encoded one by one."""
        others, plain = [], []
        for piece in pieces:
            (plain if self.plain.fullmatch(piece) else others).append(piece)
        parts = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        texts = [(" " + " ".join(part)).encode().decode("latin-1").translate(ALPHABET) for part in parts]
        for part, found in zip(parts, self.joined.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            if self.crossing[ids].any() or not learn_joined(part, ids, self.spaced, known):
                others += part
        for piece, ids in zip(others, self.encode([" " + p for p in others])):
            known[piece] = array("I", ids).tobytes()

    def token_bytes(self) -> list[bytes]:
        alphabet, vocabulary = byte_level_bytes(), self.tokenizer.get_vocab()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            out[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        return out


class SentencePieces:
    """A sentence-piece model with byte fallback, in a task. The model adds the space before a text itself."""

    adds_space = True

    def __init__(self, model: bytes):
        import sentencepiece

        self.name = f"pieces-{zlib.crc32(model)}"
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.spaced = np.array([p.startswith(SPACE_MARK) for p in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def learn(self, pieces: list[str], known: dict[str, bytes | None]) -> None:
        """Ids of pieces after a space, which the model adds. Printed ASCII is what the model's normaliser leaves as it is;
        other pieces may gain or lose spaces in it and are learnt one by one."""
        plain = [p for p in pieces if p.isascii() and p.isprintable()]
        others = [p for p in pieces if not (p.isascii() and p.isprintable())]
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            if not learn_joined(part, np.array(self.model.encode(" ".join(part)), np.uint32), self.spaced, known):
                others += part
        for piece, ids in zip(others, self.encode(others)):
            known[piece] = array("I", ids).tobytes()

    def token_bytes(self) -> list[bytes]:
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        return [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)
        ]


def printed(c: str) -> bool:
    """Whether a character is no white space by any definition."""
    return "!" <= c <= "~" or "¡" <= c <= "ᙿ"


class PieceCache:
    """Ids of texts' pieces as 32-bit numbers; what a worker process learnt serves its next tasks too.

    after_space: texts are encoded as if a space stood before them.
    """

    def __init__(self, library: ByteLevel | SentencePieces, after_space: bool, most: int = CACHED_PIECES):
        self.library, self.lead, self.most = library, after_space, most
        self.space = "" if library.adds_space else " "
        self.known: dict[str, bytes | None] = kept_in_worker(library.name)
        self.cuts = library.cuts

    def learn(self, pieces: set[str]) -> None:
        """Makes all of these known; None for those that must not be cut off at a space."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(pieces)
        for at in range(0, len(new), 10_000):
            part = [p for p in new[at : at + 10_000] if ENDS.match(p)]
            self.known.update(dict.fromkeys(new[at : at + 10_000]))
            self.library.learn(part, self.known)

    def _alone(self, text: str) -> bytes:
        """Ids of a text with other white space next to spaces."""
        pieces = CUT.split(text) if self.cuts else [text]
        first, *last = self.library.encode([(self.space if self.lead else "") + pieces[0], *[self.space + p for p in pieces[1:][-1:]]])
        self.learn(set(pieces[1:-1]))
        inner = b"".join(map(self.known.__getitem__, pieces[1:-1]))
        return array("I", first).tobytes() + inner + b"".join(array("I", ids).tobytes() for ids in last)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [t.split(" ") for t in texts]
        out: list[bytes | None] = [None] * len(texts)
        at = 0
        while self.cuts and at < len(texts):
            # as many texts as the cache can hold the pieces of, at least one
            pieces, upto = set(), at
            while upto < len(texts) and (upto == at or len(pieces) + len(split[upto]) <= self.most):
                pieces.update(split[upto])
                upto += 1
            self.learn(pieces)
            get = self.known.__getitem__
            # without a space before it the first piece is not one of the others
            firsts = [[]] * (upto - at) if self.lead else self.library.encode([s[0] for s in split[at:upto]])
            for row, first in enumerate(firsts, at):
                words = split[row]
                if self.lead or len(words) == 1 or printed(words[0][-1:]):
                    try:
                        out[row] = array("I", first).tobytes() + b"".join(map(get, words if self.lead else words[1:]))
                    except TypeError:  # a piece that is not known alone
                        pass
            at = upto
        return [np.frombuffer(self._alone(t) if o is None else o, np.uint32) for t, o in zip(texts, out)]
