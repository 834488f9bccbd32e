"""Words of many texts at once, as 64-bit hashes, with numpy.

A text is lower-cased UTF-8.  Letters, digits, ``_`` and every non-ASCII byte are
word bytes, ASCII white space and control bytes separate, other bytes are marks.
A token is a maximal run of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD, MARK = 1, 2
#: Bytes of text worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20

_CLASS = np.full(256, MARK, np.uint8)
_CLASS[:33] = _CLASS[127] = 0
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_low:_high] = WORD
_CLASS[95] = WORD
_random = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about BLOCK bytes: first and last index, their bytes, where each begins and the end."""
    parts, first, size = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if parts and size + len(data) > BLOCK:
            yield first, i, b"\n".join(parts) + b"\n", np.cumsum([0, *(len(p) + 1 for p in parts)])
            parts, first, size = [], i, 0
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield first, len(texts), b"\n".join(parts) + b"\n", np.cumsum([0, *(len(p) + 1 for p in parts)])


def hashes(data: bytes, begins: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes, and where each text's tokens begin among them (and the end)."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    if not marks:
        kind = np.where(kind == MARK, 0, kind)
    edge = np.empty(len(kind) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    cuts = np.flatnonzero(edge)
    is_token = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][is_token], cuts[1:][is_token]
    power, inverse = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64)), np.searchsorted(starts, begins)
