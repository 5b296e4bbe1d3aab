"""AES forward cipher (FIPS 197) over whole columns of blocks.

FF3-1 calls AES eight times per value, always in the forward direction, so this is the only primitive
needed.  A batch of blocks is four ``uint32`` arrays (little-endian state columns) and each round is a
handful of array operations.  Two neighbouring state bytes share one 65,536-entry table, which halves
the number of gathers against the usual byte tables.  Every table is derived from the field rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_LOW, _HIGH, _HALF = np.uint32(0x00FF), np.uint32(0xFF00), np.uint32(16)


def _double(x: int) -> int:
    """Multiply by x in GF(2^8) modulo x^8 + x^4 + x^3 + x + 1."""
    x <<= 1
    return x ^ 0x11B if x & 0x100 else x


@lru_cache(maxsize=1)
def _sbox() -> np.ndarray:
    """S-box from its definition: field inverse, then the affine map."""
    power, log = [1] * 255, [0] * 256
    for i in range(1, 255):
        power[i] = _double(power[i - 1]) ^ power[i - 1]  # 3 generates the multiplicative group
    for i, p in enumerate(power):
        log[p] = i
    inverse = [0] + [power[-log[x] % 255] for x in range(1, 256)]
    box = [0x63] * 256
    for x, inv in enumerate(inverse):
        for turn in range(5):
            box[x] ^= ((inv << turn) | (inv >> (8 - turn))) & 0xFF
    return np.array(box, dtype=np.uint32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first-row pair table, second-row pair table, plain S-box pair table)."""
    s = _sbox()
    s2 = np.array([_double(int(v)) for v in s], dtype=np.uint32)
    column = s2 | (s << np.uint32(8)) | (s << _HALF) | ((s2 ^ s) << np.uint32(24))

    def turned(bits: int) -> np.ndarray:
        return (column << np.uint32(bits)) | (column >> np.uint32(32 - bits))

    pair = np.arange(65536)
    low, high = pair & 0xFF, pair >> 8
    return (
        column[low] ^ turned(8)[high],
        turned(16)[low] ^ turned(24)[high],
        s[low] | (s[high] << np.uint32(8)),
    )


def expand_key(key: bytes) -> np.ndarray:
    """Round keys as little-endian words, shape (rounds + 1, 4); 16, 24 or 32 key bytes."""
    box, nk = _sbox(), len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(nk)]
    rcon = 1
    for i in range(nk, 4 * (nk + 7)):
        word = list(words[-1])
        if i % nk == 0:
            word = [int(box[b]) for b in word[1:] + word[:1]]
            word[0] ^= rcon
            rcon = _double(rcon)
        elif nk > 6 and i % nk == 4:
            word = [int(box[b]) for b in word]
        words.append([a ^ b for a, b in zip(words[i - nk], word)])
    return np.array(words, dtype=np.uint8).view("<u4").reshape(-1, 4).astype(np.uint32)


def encrypt_blocks(state: list[np.ndarray], round_keys: np.ndarray) -> list[np.ndarray]:
    """Encrypt blocks given as four ``uint32`` column arrays."""
    upper, lower, plain = _tables()
    cols = [c ^ k for c, k in zip(state, round_keys[0])]
    last = len(round_keys) - 1
    for r in range(1, last + 1):
        b0 = [c & _LOW for c in cols]
        b1 = [c & _HIGH for c in cols]
        tops = [c >> _HALF for c in cols]
        b2 = [t & _LOW for t in tops]
        b3 = [t & _HIGH for t in tops]
        first = [(b0[j] | b1[(j + 1) & 3]).astype(np.intp) for j in range(4)]
        second = [(b2[(j + 2) & 3] | b3[(j + 3) & 3]).astype(np.intp) for j in range(4)]
        if r < last:
            cols = [
                upper.take(f, mode="wrap") ^ lower.take(g, mode="wrap") ^ k
                for f, g, k in zip(first, second, round_keys[r])
            ]
        else:
            cols = [
                plain.take(f, mode="wrap") ^ (plain.take(g, mode="wrap") << _HALF) ^ k
                for f, g, k in zip(first, second, round_keys[r])
            ]
    return cols
