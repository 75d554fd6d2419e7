"""Hashes of the words in a byte string, computed for all words at once."""

from __future__ import annotations

import re

import numpy as np

from tallystar.tasks import ship_by_value

ship_by_value(__name__)

_MULTIPLIER = 0x9E3779B97F4A7C15
_BLANK_BYTES = np.zeros(256, bool)
_BLANK_BYTES[list(b" \t\n\x0b\x0c\r")] = True


def word_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in the bytes, and where each word starts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK_BYTES[data]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # Sum of byte * m^position over the word, shifted back to position 0 by the inverse power.
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    keys = (sums[ends] - sums[starts]) * inverse[starts]
    return stirred(keys), starts


class _Unsent(dict):
    """A dict that travels empty: functions that use it are sent with every job, and tasks fill it themselves."""

    def __reduce__(self):
        return _Unsent, ()


_tables: dict[str, np.ndarray] = _Unsent()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("powers", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("powers", _MULTIPLIER), ("inverse", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.cumprod(steps)
    return _tables["powers"], _tables["inverse"]


def stirred(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return keys ^ (keys >> np.uint64(32))


_PIECE = 1 << 20
_NEAR = 1 << 16  # bytes whose numbers stay in a core's cache
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int | None = None):
    """A text cut at white space into pieces of bounded size, each with its place; a longer word stays whole."""
    at, size = 0, size or _PIECE
    while len(data) - at > size and (cut := _BLANK.search(data, at + size)):
        yield at, data[at:cut.end()]
        at = cut.end()
    yield at, data[at:]


def text_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_keys``, for bytes of any length."""
    found = [(keys, starts + at) for at, (keys, starts) in
             ((at, word_keys(np.frombuffer(piece, np.uint8))) for at, piece in pieces(data, min(_PIECE, _NEAR)))]
    return np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])
