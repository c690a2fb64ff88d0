"""Cutting batches of texts into the pieces that byte-pair merges never cross, on code points in numpy.

The two patterns served here are built of runs of letters, digits, blanks and other characters:

``WORDS``  's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+            (blanks are dropped)
``SPACED`` 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

from fieldspark.llm import arrays as A

LETTER, DIGIT, BLANK, OTHER, BREAK = 1, 2, 3, 4, 5
TAILS = (("s",), ("t",), ("r", "e"), ("v", "e"), ("m",), ("l", "l"), ("d",))


@cache
def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode tables."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = DIGIT
    blanks = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[blanks] = BLANK
    return out


@cache
def char_values() -> np.ndarray:
    return A.mix(np.arange(1, sys.maxunicode + 2, dtype=A.U))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, length) of the runs that are a single apostrophe before a contraction's letters."""
    one = np.flatnonzero((end - start == 1) & (cp[start] == 39))
    one = one[end[one] < len(cp)]
    length = np.zeros(len(one), np.int64)
    padded = np.r_[cp, np.zeros(3, cp.dtype)]
    for tail in TAILS:
        ok = np.ones(len(one), bool)
        for k, c in enumerate(tail):
            ok &= padded[end[one] + k] == ord(c)
        length[ok & (length == 0)] = 1 + len(tail)
    return one[length > 0], length[length > 0]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of several texts with one break behind each, and the places of the breaks."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return code_points("\0".join(texts) + "\0"), np.cumsum(lens + 1) - 1


def pieces(cp: np.ndarray, spaced: bool, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of one text, or of several with breaks between them."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[cp]
    if breaks is not None:
        kind[breaks] = BREAK
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.r_[0, change]
    end = np.r_[change, len(cp)]
    run, length = _contractions(cp, kind, start, end)
    k = kind[start]
    if spaced:
        # A blank right before a run that is not blank belongs to it if it is a plain space.
        blank = k == BLANK
        last = np.r_[k[1:] == BREAK, True]
        takes = blank & ~last & (cp[end - 1] == 32)
        taken_by = np.r_[False, takes[:-1]]
        free = ~taken_by[run]
        run, length = run[free], length[free]
        piece_start = np.where(taken_by, start - 1, start)
        # Blank runs: all but the last character, then the last one unless it was taken; whole at the end of the text.
        whole = blank & last
        body = blank & ~whole & (end - start > 1)
        tail = blank & ~whole & ~takes
        text = ~blank & (k != BREAK)
        s = np.concatenate([piece_start[text], start[whole], start[body], end[tail] - 1])
        e = np.concatenate([end[text], end[whole], end[body] - 1, end[tail]])
    else:
        word = (k == LETTER) | (k == OTHER)
        digits = np.flatnonzero(kind == DIGIT)
        s = np.concatenate([start[word], digits])
        e = np.concatenate([end[word], digits + 1])
    if len(run):  # the apostrophe's piece grows by the contraction's letters, the letters behind it are what is left
        at = start[run]
        order = np.argsort(s, kind="stable")
        s, e = s[order].copy(), e[order].copy()
        p = np.searchsorted(s, at)
        e[p] = at + length
        s[p + 1] = at + length
        keep = s < e
        return s[keep], e[keep]
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def piece_hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces."""
    values = char_values()[cp] * A._power_table(A.BASE, len(cp))
    prefix = np.zeros(len(cp) + 1, A.U)
    np.cumsum(values, out=prefix[1:])
    inverse = A._power_table(pow(A.BASE, -1, 2**64), len(cp) + 1)
    return A.mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(A.U))
