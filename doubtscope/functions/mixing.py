"""Repeatable pseudo-random integers from a digest: the same in any SQL engine.

Used instead of ``rand``: a retried task draws the same numbers again, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_int(*parts: Column) -> Column:
    """First 60 bits of the MD5 of the parts joined by ':', as a bigint."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_below(n: Column, *parts: Column) -> Column:
    """Integer in 0 … n-1 for the given parts (seed, stream, position).

    Never null, and declared so: a join on it then needs no null filter, which would compute the
    digest a second time.
    """
    return F.coalesce(F.pmod(digest_int(*parts), n), F.lit(0).cast("bigint"))


# MD5 (RFC 1321) over arrays: a number takes a tenth of the time of a call to hashlib
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: Numbers whose digests are worked out at a time: a dozen arrays of them stay in the processor's cache.
STEP = 25_000
_ENDING = 5  # digits that differ within a step and the steps of the same head


def _endings() -> np.ndarray:
    """The last digits of 0, 1, 2 …, less the code of zero, the first digit in the lowest byte."""
    at = np.arange(10**_ENDING, dtype=np.uint64)
    return sum((at // np.uint64(10 ** (_ENDING - 1 - k)) % np.uint64(10)) << np.uint64(8 * k) for k in range(_ENDING))


_DIGITS = _endings()


def _message(prefix: bytes, low: int, high: int) -> list:
    """The 16 words of one block for each of prefix + low … high - 1, numbers of equal length and head: an int where all agree, else an array."""
    number = b"%d" % low
    size, ending = len(prefix) + len(number), min(len(number), _ENDING)
    block = prefix + number[:-ending] + b"0" * ending + b"\x80"
    if len(block) > 56:
        raise ValueError(f"more than one block: {block!r}")
    words: list = np.frombuffer(block.ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4").tolist()
    first = low % 10**_ENDING
    digits = _DIGITS[first : first + high - low] >> np.uint64(8 * (_ENDING - ending))
    at, shift = divmod(size - ending, 4)
    digits = digits << np.uint64(8 * shift)
    words[at] = digits.astype(np.uint32) | np.uint32(words[at])
    if shift + ending > 4:
        words[at + 1] = (digits >> np.uint64(32)).astype(np.uint32) | np.uint32(words[at + 1])
    return words


def _digested(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two of the four words of n digests."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t, pair = (np.empty(n, np.uint32) for _ in range(3))
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48 and i % 2 == 0:
            np.bitwise_xor(b, c, out=pair)  # the next step's c and d
            np.bitwise_xor(pair, d, out=f)
        elif i < 48:
            np.bitwise_xor(b, pair, out=f)
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        word, turn = words[_WORDS[i]], _TURNS[i // 16][i % 4]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a, b


def digest_ints(prefix: str, n: int) -> Iterator[np.ndarray]:
    """``digest_int`` of prefix + i for i = 0 … n-1, some at a time."""
    start, low = prefix.encode(), 0
    while low < n:
        high = min(n, low - low % STEP + STEP, 10 ** len(str(low)))
        first, second = _digested(_message(start, low, high), high - low)
        found = first.byteswap().astype(np.uint64)
        found <<= np.uint64(32)
        found |= second.byteswap()
        found >>= np.uint64(4)
        yield found
        low = high
