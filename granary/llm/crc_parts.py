"""CRC-32 of a text from the checksums of its parts, in any order.

Appending n bytes to a text multiplies its checksum by x^(8n) modulo the CRC's
polynomial, and the checksums of parts then add up by exclusive or. x has the order
2^32 - 1, so a part can be divided by the power of its own end and the sum multiplied by
that of the whole length: no part needs to know what follows it. Polynomials are
32-bit numbers with x^0 in the highest bit, as CRC-32 has them.
"""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = np.uint32(0xEDB88320)
_ORDER = (1 << 32) - 1


def _product(a: int, b: np.ndarray) -> np.ndarray:
    """The polynomial ``a`` times each of ``b``."""
    total = np.zeros_like(b)
    for degree in range(32):
        if a >> 31 - degree & 1:
            total ^= b
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * _POLYNOMIAL
    return total


def _squares() -> list[int]:
    powers = [1 << 31 - 8]
    while len(powers) < 32:
        powers.append(int(_product(powers[-1], np.array([powers[-1]], dtype=np.uint32))[0]))
    return powers


_POWERS = _squares()  # x^8 to the powers 1, 2, 4, ...


def moved(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Checksums as if ``n_bytes`` more (less, where negative) followed their parts."""
    crcs, n_bytes = np.asarray(crcs, dtype=np.uint32), np.asarray(n_bytes, dtype=np.int64) % _ORDER
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        bit = np.flatnonzero(n_bytes >> k & 1)
        crcs = crcs.copy()
        crcs[bit] = _product(_POWERS[k], crcs[bit])
    return crcs
