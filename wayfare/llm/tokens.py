"""Encoding of whole texts by a byte-level pair tokenizer file, with the ids that the library gives for a text in one piece.

Such a tokenizer splits a text before merging, and a space that stands before anything but white space always begins a new
part, as does a line feed between two characters that aren't white space. So a text is cut there and each distinct piece is
encoded once and kept. Pieces of common characters are split by the public pattern and their parts go to the library's merge
model; other pieces, and texts in which a cut could differ (runs of white space with a space inside, texts that hold a special
token), go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces that a worker keeps before it starts anew (about 150 bytes each), and for one part of a piece (about 400) how many.
KEPT, PIECES_PER_PART = 600_000, 10
#: A space between white space, or at the end of the text after white space: no cut is made in such a text.
UNSURE = re.compile(r"\s (?:\s|\Z)")
SUSPECT = re.compile(r" (?:\s|\Z)")
#: Characters on which all implementations of the splitting pattern agree: ASCII and Latin letters.
COMMON = re.compile(r"[\n\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.split = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # the library's letters for bytes, found by asking it: bytes of one character each, then of two
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {b: shown.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for c in map(chr, [*range(0x80, 0x800), 0x800, 0x1000, *range(0x2000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]):
            if not 0xD800 <= ord(c) < 0xE000:
                self.letters.update(zip(c.encode(), shown.pre_tokenize_str(c)[0][0], strict=True))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}  # of parts as they are
        self.stems: dict[str, list[int]] = {}  # of words with a space before them
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = [t.id for t in self.merge(part.encode().decode("latin-1").translate(self.letters))]
        return ids

    def _piece(self, piece: str) -> list[int]:
        if COMMON.match(piece) and not any(s in piece for s in self.special):
            return [i for part in self.split(piece) for i in self._part(part)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces that aren't known yet."""
        stems, merge, space = self.stems, self.merge, self.letters[32]
        flat: list[int] = []
        lens: list[int] = []
        for p in pieces:
            # most pieces are a word of letters after a space, or one with a stop or comma, for which there is a short way
            stem = p[1:].rstrip(".,")
            more = len(p) - len(stem)
            if more < 3 and stem.isalpha() and p[0] == " " and (stem.isascii() or COMMON.match(stem)):
                ids = stems.get(stem)
                if ids is None:
                    word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                    ids = stems[stem] = [t.id for t in merge(space + word)]
                if more == 2:
                    ids = ids + self._part(p[-1])
            else:
                ids = self._piece(p)
            flat += ids
            lens.append(len(ids))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        more = np.array(lens, np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(more) - more))
        self.lens, self.flat = np.concatenate((self.lens, more)), np.concatenate((self.flat, np.array(flat, self.dtype)))

    def _prepared(self, text: str) -> str | None:
        """The text with a mark at each cut; None if it has to go to the library whole."""
        if "\0" in text or any(s in text for s in self.special) or (SUSPECT.search(text) and UNSURE.search(text)):
            return None
        if "\n" in text and all(line and not line[0].isspace() and not line[-1].isspace() for line in text.split("\n")):
            text = text.replace("\n", "\0\n\0")
        return text.replace(" ", "\0 ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if len(self.known) > self.kept:
            self._clear()
        if len(self.parts) + len(self.stems) > self.kept // PIECES_PER_PART:
            self.parts, self.stems = {}, {}
        prepared = [self._prepared(t) for t in texts]
        whole = np.fromiter((p is None for p in prepared), bool, len(prepared))
        # a batch's pieces are made distinct before Python sees them
        split = pc.split_pattern(pa.array([p for p in prepared if p is not None], pa.large_string()), "\0")
        coded = pc.dictionary_encode(split.flatten())
        pieces = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(numbers < 0)
        numbers[at] = np.arange(len(self.known), len(self.known) + len(at))
        self._learn([pieces[i] for i in at.tolist()])
        index = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.lens[index]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[index] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
        counts = np.diff(np.concatenate(([0], ends))[split.offsets.to_numpy()])
        if not whole.any():
            return ids, counts
        others = [np.array(self._piece(t), self.dtype) for t, w in zip(texts, whole.tolist(), strict=True) if w]
        cuts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        rest = iter(others)
        parts = [next(rest) if w else next(cuts) for w in whole.tolist()]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_encoders: dict[str, Encoder] = {}


def release() -> None:
    """Give up what this worker process keeps, for a step that encodes nothing."""
    _encoders.clear()


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].kept = kept
    return _encoders[path]
