"""Vectorised letter windows of many strings at once, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the length of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), lengths


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def owners(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every whole window: the number of its text and its place in the row of letters."""
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = starts(lengths)[:-1]
    within = np.arange(len(owner)) - np.repeat(starts(counts)[:-1], counts)
    return owner, first[owner] + within


def five_codes(points: np.ndarray) -> np.ndarray:
    """A 64-bit code of the 5-letter window at each place, whatever stands around it.

    Exact below 2 ** 60 where all code points are below 4096; else hashed, with the top bit set.
    """
    if len(points) < 5:
        return np.zeros(0, np.uint64)

    def total(values: np.ndarray, base: np.uint64) -> np.ndarray:
        code = values[:-4].copy()
        for i in range(1, 5):
            code = code * base + values[i : len(values) - 4 + i]
        return code

    code, high = total(points, np.uint64(4096)), points >= 4096
    if high.any():
        count = np.concatenate([[0], np.cumsum(high)])
        code = np.where(count[5:] > count[:-5], total(mix(points + _GOLD), _GOLD) | np.uint64(1 << 63), code)
    return code


def rolling(points: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the window of ``width`` letters at each place, by doubling."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    piece = mix(points + np.uint64(seed * int(_GOLD) % 2**64))
    total, done, size, shift = None, 0, 1, np.uint64(0x5851F42D4C957F2D)
    while True:
        if width & size:
            part = piece[done:]
            total = part if total is None else mix(total[: len(part)] * shift + part)
            done += size
        if size * 2 > width:
            break
        piece = mix(piece[: len(piece) - size] * shift + piece[size:])
        size *= 2
    return total[: len(points) - width + 1]


def _ascii_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct (text number << 35 | five letters of 7 bits), sorted, and how many each text has; None unless all letters are ASCII."""
    joined = "".join(texts)
    if not joined.isascii() or len(texts) >= 1 << 28:
        return None
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner, place = owners(lengths, 5)
    points = np.frombuffer(joined.encode("ascii"), np.uint8).astype(np.uint64)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    code = points[:-4].copy()
    for i in range(1, 5):
        code = (code << np.uint64(7)) | points[i : len(points) - 4 + i]
    key = np.sort((owner.astype(np.uint64) << np.uint64(35)) | code[place])
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    return key, np.bincount((key >> np.uint64(35)).astype(np.int64), minlength=len(texts))


def token_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 5-letter windows: (text number, code) sorted by both, and how many each text has."""
    fast = _ascii_keys(texts)
    if fast is not None:
        key, n = fast
        code = np.zeros(len(key), np.uint64)
        for i in range(5):  # as in five_codes
            code |= ((key >> np.uint64(7 * i)) & np.uint64(127)) << np.uint64(12 * i)
        return (key >> np.uint64(35)).astype(np.int64), code, n
    points, lengths = letters(texts)
    owner, place = owners(lengths, 5)
    code = five_codes(points)[place] if len(place) else np.zeros(0, np.uint64)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    owner, code = owner[fresh], code[fresh]
    return owner, code, np.bincount(owner, minlength=len(texts))


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the 5-letter windows of left[i] and right[i]; 0 where either has none."""
    fast_l, fast_r = _ascii_keys(left), _ascii_keys(right)
    if fast_l is not None and fast_r is not None:
        (key_l, n_l), (key_r, n_r) = fast_l, fast_r
        key = np.concatenate([key_l, key_r])
        key.sort()
        both = (key[1:][key[1:] == key[:-1]] >> np.uint64(35)).astype(np.int64)
    else:
        owner_l, code_l, n_l = token_sets(left)
        owner_r, code_r, n_r = token_sets(right)
        owner, code = np.concatenate([owner_l, owner_r]), np.concatenate([code_l, code_r])
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        both = owner[1:][(owner[1:] == owner[:-1]) & (code[1:] == code[:-1])]
    shared = np.bincount(both, minlength=len(left))
    return shared / np.maximum(n_l + n_r - shared, 1)


def pairs_of_runs(first: np.ndarray, sizes: np.ndarray, limit: int = 4_000_000):
    """All pairs (i < j) of places within each run, in chunks of about ``limit``; runs sorted by size inside."""
    for size in np.unique(sizes[sizes > 1]):
        begin = first[sizes == size]
        if size * (size - 1) // 2 <= limit:
            i, j = np.triu_indices(size, 1)
            step = max(1, limit // len(i))
            for at in range(0, len(begin), step):
                base = begin[at : at + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            step = max(1, limit // int(size))
            for base in begin:
                for at in range(0, int(size), step):
                    i = np.arange(at, min(at + step, int(size)))
                    counts = size - 1 - i
                    a = np.repeat(i, counts)
                    b = np.arange(len(a)) - np.repeat(starts(counts)[:-1], counts) + a + 1
                    yield base + a, base + b
