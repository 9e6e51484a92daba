"""Lossless counting filters of packed word-id sequences, by quotient and remainder.

A sequence of n ids of b bits is a number of n x b bits, held in limbs of 64 bits, the first limb the widest. The first limb is
permuted by an invertible mix of all limbs, so its leading bits are spread evenly: they name the shard and, as the quotient, a slot
inside it. A filter keeps for every slot how many entries it has (one bit each, and one to end the slot), and for every entry the
whole remainder and a counter. Nothing is rounded or merged by chance: the sequence can be read back from slot and remainder.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1


def widths(n: int, bits: int) -> list[int]:
    """Bits of each limb of a sequence of n ids."""
    total = n * bits
    return [min(64, total - at) for at in range(0, total, 64)]


def _mask(width: int) -> np.uint64:
    return _U((1 << width) - 1)


def pack(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    limbs = [np.zeros(len(ids[0]), np.uint64) for _ in widths(len(ids), bits)]
    for k, one in enumerate(ids):
        limb, shift = divmod(k * bits, 64)
        one = one.astype(np.uint64)
        limbs[limb] |= one << _U(shift)
        if shift + bits > 64:
            limbs[limb + 1] |= one >> _U(64 - shift)
    return limbs


def unpack(limbs: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    ids = []
    for k in range(n):
        limb, shift = divmod(k * bits, 64)
        one = limbs[limb] >> _U(shift)
        if shift + bits > 64:
            one |= limbs[limb + 1] << _U(64 - shift)
        ids.append((one & _mask(bits)).astype(np.int64))
    return ids


def _stir(limbs: list[np.ndarray], width: int) -> np.ndarray:
    """A number of `width` bits from the limbs after the first."""
    out = np.zeros(len(limbs[0]), np.uint64)
    for limb in limbs[1:]:
        out = (out ^ limb) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return out >> _U(64 - width)


def permute(limbs: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    width = widths(n, bits)[0]
    half, mask, x = _U((width + 1) // 2), _mask(width), limbs[0]
    if len(limbs) > 1:
        x = x ^ _stir(limbs, width)
    for _ in range(2):
        x = x ^ (x >> half)
        x = (x * _U(_ODD)) & mask
    return [x ^ (x >> half), *limbs[1:]]


def restore(limbs: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    """The inverse of `permute`: a shift by half the width or more undoes itself, an odd factor has an inverse."""
    width = widths(n, bits)[0]
    half, mask, x = _U((width + 1) // 2), _mask(width), limbs[0]
    back = _U(pow(_ODD, -1, 1 << 64))
    x = x ^ (x >> half)
    for _ in range(2):
        x = (x * back) & mask
        x = x ^ (x >> half)
    if len(limbs) > 1:
        x = x ^ _stir(limbs, width)
    return [x, *limbs[1:]]


def tally(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct sequences in ascending order of their permuted limbs, the sums of their counters (1 each if none are given), and for
    every given entry the place of its sequence."""
    if not len(limbs[0]):
        return limbs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs = [limb[order] for limb in limbs]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([limb[1:] != limb[:-1] for limb in limbs])
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [limb[first] for limb in limbs], total.astype(np.int64), place


def _bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(width + 7) // 8]).tobytes()


def _numbers(data: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    size = (width + 7) // 8
    full = np.zeros((n, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return full.view("<u8").ravel(), at + n * size


def encode(limbs: list[np.ndarray], counts: np.ndarray, n: int, bits: int, shard_bits: int) -> bytes:
    """The filter of sorted distinct entries of one shard."""
    width, m = widths(n, bits), len(counts)
    slots = max(0, min(width[0] - shard_bits, m.bit_length() - 1))
    rest = width[0] - shard_bits - slots
    own = limbs[0] & _mask(width[0] - shard_bits)
    slot = (own >> _U(rest) if slots else np.zeros(m, np.uint64)).astype(np.int64)
    marks = np.zeros(m + (1 << slots), np.uint8)
    marks[np.arange(m) + slot] = 1
    small, large = np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255]
    parts = [np.array([m, slots], "<i8").tobytes(), np.packbits(marks).tobytes(), _bytes(own & _mask(rest), rest)]
    parts += [_bytes(limb, w) for limb, w in zip(limbs[1:], width[1:], strict=True)]
    return b"".join([*parts, small.tobytes(), large.astype("<i8").tobytes()])


def decode(data: memoryview, n: int, bits: int, shard_bits: int, shard: int) -> tuple[list[np.ndarray], np.ndarray]:
    width = widths(n, bits)
    m, slots = (int(v) for v in np.frombuffer(data, "<i8", 2))
    rest, marked = width[0] - shard_bits - slots, m + (1 << slots)
    size = (marked + 7) // 8
    marks = np.unpackbits(np.frombuffer(data, np.uint8, size, 16), count=marked)
    slot = (np.flatnonzero(marks) - np.arange(m)).astype(np.uint64)
    low, at = _numbers(data, 16 + size, m, rest)
    high = _U(shard << (width[0] - shard_bits)) if shard_bits else _U(0)
    limbs = [low | (slot << _U(rest) if slots else _U(0)) | high]
    for w in width[1:]:
        limb, at = _numbers(data, at, m, w)
        limbs.append(limb)
    counts = np.frombuffer(data, np.uint8, m, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", int((counts == 255).sum()), at + m)
    return limbs, counts
