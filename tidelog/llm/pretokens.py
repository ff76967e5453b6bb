"""Pre-tokens of the usual byte-level BPE pattern, found for whole buffers of texts at once.

The pattern takes contractions, then runs of letters, of digits or of other signs, each with one space before it, then
white space. Which token a character belongs to follows from the kinds of its neighbours, so numpy can mark all token
starts without walking through the text.
"""

from __future__ import annotations

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The kind of every code point; made once per process."""
    global _kinds
    if _kinds is None:
        every = "".join(map(chr, range(0x110000)))
        table = np.full(len(every), OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for run in regex.finditer(pattern, every):
                table[run.start():run.end()] = kind
        _kinds = table
    return _kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[at].astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        wide = np.flatnonzero((out >= low) & (out < high) & (data[at] >= low))
        value = out[wide] & mask
        for i in range(1, more + 1):
            value = (value << 6) | (data[at[wide] + i] & 0x3F)
        out[wide] = value
    return out, at


def starts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every pre-token. A pre-token ends where the next begins, or its text ends."""
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    opens = np.zeros(n + 1, bool)  # the first character of a text
    opens[np.searchsorted(at, offsets)] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space before something else in the same text: its last character stands apart, or joins as a space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # Contractions begin with an apostrophe that begins a token.
    quote = np.flatnonzero((points == 0x27) & start)
    padded = np.concatenate([points, [0, 0, 0]])
    closed = np.concatenate([opens, [True, True]])
    one, two = padded[quote + 1], padded[quote + 2]
    same = ~closed[quote + 1]
    short = same & np.isin(one, [ord(c) for c in "stmd"])
    long = same & ~closed[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                                        | (one == ord("l")) & (two == ord("l")))
    start = np.concatenate([start, [True, True, True]])
    start[quote[short] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 1] = start[quote[long] + 2] = False
    start[quote[long] + 3] = True
    return at[start[:n]]
