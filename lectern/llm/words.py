"""Words, their hashes and rolling hashes of word sequences in numpy; batches never hold per-word Python state."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64
_lean = False


def lean() -> None:
    """In a worker, before large arrays come and go: have what is freed go back to the system at once.

    Else the allocator raises its threshold for mapped blocks with the first large one that is freed, and Arrow's pool
    keeps its pages, so a worker that is used again holds what its largest task needed.
    """
    global _lean
    if not _lean:
        _lean = True
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).mallopt(-3, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())


#: Odd multipliers of the polynomial hashes and of the mixer (fixed values).
R1, R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit hangs on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(MIX1)
    x = x ^ (x >> U(27))
    x = x * U(MIX2)
    return x ^ (x >> U(31))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """Runs without the bytes 0x20 and 0x09-0x0D: what bytes.split() takes as white space, no more."""
    return text.split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=U, count=len(words))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult ** i and its inverse powers modulo 2 ** 64 for i < n at least."""
    got = _powers.get(mult)
    if got is None or len(got[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        both = []
        for m in (mult, pow(mult, -1, 1 << 64)):
            out = np.ones(size, U)
            step, done = m, 1
            while done < size:  # doubling: the second half is the first times m ** done
                out[done : 2 * done] = out[:done] * U(step)
                step, done = step * step & (1 << 64) - 1, 2 * done
            both.append(out)
        got = _powers[mult] = (both[0], both[1])
    return got


def prefix(names: np.ndarray, mult: int = R1) -> np.ndarray:
    """Prefix sums from which grams() takes the hash of any range."""
    out = np.zeros(len(names) + 1, U)
    np.cumsum(names * powers(mult, len(names) + 1)[1][: len(names)], out=out[1:])
    return out


def grams(sums: np.ndarray, starts: np.ndarray, k, mult: int = R1) -> np.ndarray:
    """Hash of the k names from each start; equal sequences get equal hashes wherever they stand."""
    up = powers(mult, len(sums) + 1)[0]
    return mix((sums[starts + k] - sums[starts]) * up[starts])
