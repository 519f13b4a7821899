"""Token ids of whole texts by a given vocabulary file of the ``tokenizers`` library.

Texts are cut where no vocabulary of this kind joins characters: before white space that follows a
visible character, and between a Latin letter and the full stops or commas that end a word. Each
distinct piece is encoded once per worker and remembered, so frequent words cost a lookup. Texts with
a piece before which that cut could matter (unusual white space, text that spells a special token)
are encoded whole. The memory holds a bounded number of pieces; what falls out is encoded again.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from tripledger.llm.common import sole_memory

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = r" \n\t\r"
_PIECE = re.compile(rf"[{_BLANK}]*[{_LETTERS}]+(?![^.,{_BLANK}])|[.,]+(?=[{_BLANK}]|$)|[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_UNUSUAL = re.compile(rf"[^\S{_BLANK}]|<\|")
#: Pieces that begin with white space and hold more, and those of them that are one word: any number of them, one after the other, are
#: encoded as each alone.
_SPACED = re.compile(rf"[{_BLANK}]+[^{_BLANK}]+")
_WORD = re.compile(rf"[{_BLANK}]+[{_LETTERS}]+")
#: Pieces remembered per worker: twice this many at most.
REMEMBERED = 500_000
#: Codes of unsigned integers by their width in bytes.
_CODES = {array(code).itemsize: code for code in "HIQ"}

_loaded: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """``width``: bytes of an id in the results, little-endian; an id that does not fit is an error."""

    def __init__(self, path: str, remembered: int = REMEMBERED, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.remembered, self.width, self.code = remembered, width, _CODES[width]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lengths, self.closes = self._edges()
        self.joins = (_WORD if self.lengths is None else _SPACED).fullmatch

    @classmethod
    def at(cls, path: str, width: int = 4, remembered: int = REMEMBERED) -> Encoder:
        """The worker's encoder for this file; workers outlive tasks, and keep one: its memory is what they hold."""
        sole_memory("tokens", _loaded.clear)
        if (path, width) not in _loaded:
            _loaded.clear()
            _loaded[path, width] = cls(path, remembered, width)
        return _loaded[path, width]

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)  # OverflowError if an id does not fit
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _edges(self) -> tuple[np.ndarray | None, np.ndarray]:
        """Per id the bytes it stands for, if ids spell a text byte by byte, and whether it ends a word."""
        from tokenizers import pre_tokenizers

        names = self.library.get_vocab()
        size = max(names.values(), default=0) + 1
        lengths, closes = np.zeros(size, np.int64), np.zeros(size, bool)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        for name, k in names.items():
            lengths[k] = len(name)
            closes[k] = bool(suffix) and name.endswith(suffix)
        cut = self.library.pre_tokenizer
        exact = isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space
        return lengths if exact and self.library.normalizer is None and not suffix else None, closes

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [self.packed(e.ids) for e in found]

    def _each(self, pieces: list[str]) -> list[bytes]:
        """Per piece its ids. The library takes them as the words of one text, which it encodes apart from each other: about
        half the work of as many texts."""
        found = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = self.packed(found.ids)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces)) * self.width
        ends = np.cumsum(sizes).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """``_each`` of pieces that ``joins`` allows, as one text that the library encodes the quick way: it tells no words, but
        where a piece ends follows from the ids."""
        found = self.library.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids
        ids = np.array(found, np.int64)
        if self.lengths is not None:
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([len(piece.encode()) for piece in pieces])
            last = np.minimum(np.searchsorted(ends, wanted), len(ids) - 1)
            sound = ends[-1] == wanted[-1] and (ends[last] == wanted).all()
        else:
            last = np.flatnonzero(self.closes[ids])
            sound = len(last) == len(pieces) and last[-1] == len(ids) - 1
        if not sound:
            return self._each(pieces)
        raw = self.packed(found)
        edges = ((last + 1) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *edges], edges, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned integers."""
        out: list[bytes] = [b""] * len(texts)
        open_texts, missing = [], {}
        known = self.young.get
        for k, text in enumerate(texts):
            pieces = _PIECE.findall(text)
            ids = list(map(known, pieces))
            if None in ids:
                holes = [j for j, found in enumerate(ids) if found is None]
                missing.update(dict.fromkeys([pieces[j] for j in holes]))
                open_texts.append((k, pieces, ids, holes))
            else:
                out[k] = b"".join(ids)
        self._find(missing)
        for k, pieces, ids, holes in open_texts:
            for j in holes:
                ids[j] = missing[pieces[j]]
            out[k] = self._raw([texts[k]])[0] if None in ids else b"".join(ids)
        return out

    def _find(self, missing: dict[str, bytes | None]) -> None:
        """Fills in the pieces' ids; a piece before which the cut could matter stays None."""
        spaced, others = [], []
        for piece in missing:
            ids = self.old.get(piece)
            if ids is not None:
                missing[piece] = ids
                self._keep(piece, ids)
            elif not _UNUSUAL.search(piece):
                (spaced if self.joins(piece) else others).append(piece)
        for new, encoded in ((spaced, self._joined), (others, self._each)):
            for k in range(0, len(new), 4096):
                some = new[k : k + 4096]
                for piece, ids in zip(some, encoded(some), strict=True):
                    missing[piece] = ids
                    if len(piece) <= 64:
                        self._keep(piece, ids)

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(self.young) >= self.remembered:
            self.old, self.young = self.young, {}
        self.young[piece] = ids


def in_steps(texts: list[str], chars: int = 2_000_000):
    """Slices of a batch with a bounded amount of text each (one text at least)."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end
