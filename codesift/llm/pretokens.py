"""Pre-tokens of many texts at once, as ranges of one byte buffer.

Handles texts of ASCII and the Latin-1 letters of UTF-8 lead byte C3, which
lower-case byte by byte; any other text is left to the tokenizers library.
"""

from __future__ import annotations

import numpy as np

from .common import mix

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LETTER
    out[128:] = LETTER
    out[48:58] = DIGIT
    out[[9, 10, 13, 32]] = SPACE
    return out


CLASSES = _byte_classes()
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3])


def is_plain(text: bytes) -> bool:
    """Only characters that this module classifies as the tokeniser file does,
    and nothing that may be a special string."""
    return (not text.translate(None, PLAIN_BYTES) and b"<|" not in text
            and b"\xc3\x97" not in text and b"\xc3\xb7" not in text
            and text.count(b"\xc3") == len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))))


def lowered(texts: list[bytes]) -> bytes:
    """The texts in lower case, each followed by a blank."""
    buf = bytearray(b" ".join(texts).translate(LOWER) + b" ")
    a = np.frombuffer(buf, np.uint8)
    lead = np.flatnonzero(a[:-1] == 0xC3)
    upper = lead[(a[lead + 1] >= 0x80) & (a[lead + 1] <= 0x9E)] + 1
    a[upper] += 0x20
    return bytes(buf)


def ranges(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens: contractions, runs of letters, single
    digits and runs of other characters."""
    a = np.frombuffer(buf, np.uint8)
    cls = CLASSES[a]
    start = np.empty(len(a), bool)
    start[0] = True
    start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT)
    # a contraction begins at an apostrophe that no other character precedes
    tick = np.flatnonzero(a == 39)
    if len(tick):
        before = np.where(tick > 0, cls[np.maximum(tick - 1, 0)], SPACE)
        tick = tick[before != OTHER]
        pad = np.r_[a, np.zeros(3, np.uint8)]
        x, y = pad[tick + 1], pad[tick + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        hit, size = tick[one | two], np.where(one, 2, 3)[one | two]
        start[hit + 1] = False
        after = hit + size
        start[after[after < len(a)]] = True
    at = np.flatnonzero(start)
    ends = np.r_[at[1:], len(a)]
    word = cls[at] != SPACE
    return at[word], ends[word]


BASE = 0x9FB21C651E98DF25


def range_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, from one running sum of weighted bytes;
    equal bytes have equal hashes anywhere in any buffer."""
    n = len(buf)
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (np.uint64(BASE), inverse)]
    weight, back = _powers
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[np.frombuffer(buf, np.uint8)] * weight[:n], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


# Powers of BASE and of its inverse, as many as the longest buffer so far needed.
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows ``values[offsets[i]:offsets[i + 1]]`` for i in ``which``,
    laid out one after the other, and their lengths."""
    lens = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lens)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[:-1][which] - (ends - lens), lens)
    return values[index], lens
