"""Pre-tokens of whole batches of texts as arrays, for the two regular-expression splitters of the public BPE files.

A text whose characters all have a class in CLASS is split here; any other text (rare scripts, characters that
normalisation may change, "<|" which may begin a special token) is left to the tokenizer library.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from . import hashing
from .hashing import U

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(0x2100, np.uint8)
    lower = np.arange(0x2100, dtype=np.uint32)
    for code in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20BA)]:
        c = chr(code)
        if len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c:
            continue
        general = unicodedata.category(c)[0]
        blank = code in (*range(9, 14), 32, 0x85, 0xA0)
        kind[code] = BLANK if blank else {"L": LETTER, "N": NUMBER}.get(general, OTHER)
        lower[code] = ord(c.lower())
    kind[(lower >= 0x2100) | (kind[np.minimum(lower, 0x20FF)] == 0)] = 0
    return kind, lower


CLASS, LOWER_CODE = _classes()
_SHORT = np.zeros(0x2100, bool)
_SHORT[[ord(c) for c in "stmd"]] = True


class Codes:
    """Code points of a run of rows, and which rows the array splitter may take."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        self.rows = heads[offsets]
        top = np.minimum(self.codes, 0x20FF)
        odd = (CLASS[top] == 0) | (self.codes >= 0x2100)
        if len(self.codes) > 1:
            odd[:-1] |= (self.codes[:-1] == ord("<")) & (self.codes[1:] == ord("|"))
        seen = np.zeros(len(odd) + 1, np.int64)
        np.cumsum(odd, out=seen[1:])
        self.plain = seen[self.rows[1:]] == seen[self.rows[:-1]]
        if not self.plain.all():
            keep = np.repeat(self.plain, np.diff(self.rows))
            self.codes = self.codes[keep]
            self.rows = np.concatenate([[0], np.cumsum(np.diff(self.rows) * self.plain)])


def _runs(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    kind = CLASS[codes]
    fresh = np.zeros(len(codes) + 1, bool)
    fresh[rows] = True
    cut = fresh.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    edge = np.flatnonzero(cut)
    starts, ends = edge[:-1], edge[1:]
    return starts, ends, kind[starts], fresh[ends]


def _contractions(codes, starts, ends, kind, last, free):
    """Letters that an apostrophe of its own takes from the run behind it: 's 't 'm 'd, 're 've 'll."""
    take = np.zeros(len(starts), np.int64)
    at = np.flatnonzero((kind == OTHER) & (ends - starts == 1) & free & ~last & (codes[starts] == 39))
    if len(at):
        at = at[kind[at + 1] == LETTER]
        one = codes[ends[at]]
        two = np.where(ends[at + 1] - starts[at + 1] > 1, codes[np.minimum(ends[at] + 1, len(codes) - 1)], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        take[at] = np.where(_SHORT[one], 1, np.where(pair, 2, 0))
    return take


def split_bytes(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in order."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, kind, last = _runs(codes, rows)
    blank = kind == BLANK
    lends = blank & ~last & (codes[ends - 1] == 32)
    behind = np.zeros(len(starts), bool)
    behind[1:] = lends[:-1]
    take = _contractions(codes, starts, ends, kind, last, ~behind)
    begin, end = starts - behind, ends + take
    begin[1:] += take[:-1]
    split = blank & ~last & (ends - starts > 1) & ~lends
    end = np.where(lends | split, ends - 1, end)
    extra = np.flatnonzero(split)
    begin, end = np.concatenate([begin, ends[extra] - 1]), np.concatenate([end, ends[extra]])
    keep = end > begin
    begin, end = begin[keep], end[keep]
    if len(extra):
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    return begin, end


def split_words(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+ in lower-case code points, what lies between dropped."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, kind, last = _runs(codes, rows)
    take = _contractions(codes, starts, ends, kind, last, np.ones(len(starts), bool))
    begin, end = starts.copy(), ends + take
    begin[1:] += take[:-1]
    keep = (kind != BLANK) & (kind != NUMBER) & (end > begin)
    digits = np.flatnonzero(CLASS[codes] == NUMBER)
    begin, end = np.concatenate([begin[keep], digits]), np.concatenate([end[keep], digits + 1])
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def code_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of code points, all of which are in CLASS."""
    return hashing.span_hashes(codes.astype("<u2").view(np.uint8), 2 * starts, 2 * ends)


def string(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le")


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BYTE_OF = {c: b for b, c in _LETTER_OF.items()}


def mapped(text: str) -> str:
    """The byte-level letters that stand for a text's UTF-8 bytes."""
    return text.encode("utf-8").decode("latin-1").translate(_LETTER_OF)


def unmapped(piece: str) -> str | None:
    """The text that byte-level letters stand for; None if its bytes are no UTF-8."""
    try:
        return bytes(_BYTE_OF[c] for c in piece).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


class Memory:
    """A direct-mapped table from a pre-token's hash to a number; of fixed size, a new entry takes the place of an old one."""

    def __init__(self, bits: int = 20):
        self.mask = U((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, positions of the hashes that aren't known)."""
        slots = hashes & self.mask
        return self.values[slots], np.flatnonzero(self.keys[slots] != hashes)

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slots = hashes & self.mask
        self.keys[slots] = hashes
        self.values[slots] = values
        clash = self.keys[slots] != hashes
        if clash.any():  # of two new hashes with one slot the later won; its value must be the later's too
            keep = ~clash
            self.values[slots[keep]] = values[keep]
