"""SHA-256 whose state between blocks can be kept in a table, for many messages at a time.

States are arrays of shape (8, n), blocks of shape (16, n), both of 32-bit words.  The digests hashed here are hex
text of 64 bytes, which is one block, so the state before any of them is eight words and nothing pending.
"""

from __future__ import annotations

import numpy as np


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits after the point of the ``power``-th root of ``n``."""
    target, low, high = n << (32 * power), 0, n << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= target else (low, middle - 1)
    return low & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32).reshape(8, 1)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def step(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block each."""
    w = list(block)
    for t in range(16, 64):
        near, far = w[t - 2], w[t - 15]
        small = _turn(far, 7) ^ _turn(far, 18) ^ (far >> np.uint32(3))
        large = _turn(near, 17) ^ _turn(near, 19) ^ (near >> np.uint32(10))
        w.append(w[t - 16] + small + w[t - 7] + large)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def close(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = blocks * 512
    return step(state, last)


def to_bytes(state: np.ndarray) -> np.ndarray:
    """Shape (n, 32): the digests or states as bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).reshape(-1, 32).view(">u4").astype(np.uint32).T


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Each digest's hex text as a block."""
    raw = to_bytes(digests)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32).T
