"""Character codes and n-grams of texts as numpy arrays, shared by the text classifiers.

Letters of the Latin blocks up to U+017F are told apart; any other letter counts by its
low bits, and whatever is no letter is a boundary (0).
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 128
LATIN_END = 0x180
CHUNK_CHARS = 1 << 21


def symbol_table() -> np.ndarray:
    """Code point to symbol for U+0000..U+017F, from the Unicode case and letter rules."""
    table, known = np.zeros(LATIN_END, np.uint8), {}
    for cp in range(LATIN_END):
        c = chr(cp).lower()
        if c[0].isalpha():
            table[cp] = known.setdefault(c[0], 1 + len(known) % (SYMBOLS - 1))
    return table


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    """Symbols of a text; one boundary is added at each end."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = TABLE[np.minimum(points, LATIN_END - 1)]
    far = points >= LATIN_END
    if far.any():
        codes = codes.copy()
        letters = np.fromiter((chr(p).isalpha() for p in points[far]), bool, int(far.sum()))
        codes[far] = np.where(letters, 1 + points[far] % (SYMBOLS - 1), 0)
    return codes


def codes_of(sym: np.ndarray, order: int) -> np.ndarray:
    """Exact codes of all windows of ``order`` symbols."""
    n = len(sym) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = sym[:n].astype(np.int64)
    for i in range(1, order):
        code = (code << 7) | sym[i : i + n]
    return code


def hashed(code: np.ndarray, bits: int) -> np.ndarray:
    """Codes as indices of a table of 2**bits."""
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def chunks(text: str, order: int) -> list[str]:
    """A text in chunks that overlap so that every window of ``order - 2`` inner
    characters or fewer lies in one; short texts are one chunk."""
    if len(text) <= CHUNK_CHARS:
        return [text]
    return [text[max(0, i - order) : i + CHUNK_CHARS] for i in range(0, len(text), CHUNK_CHARS)]
