"""Array code that the text operators share: words, hashes and runs of many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
#: Bytes of text that are worked on at once; one longer document is worked on alone.
GROUP_BYTES = 1 << 20

_letters = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def multiple(k: int) -> np.uint64:
    return U(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i, or its inverse, modulo 2 ** 64, for i < n."""
    key = "inverse" if inverse else "power"
    if len(_powers.get(key, ())) < max(n, 1):
        base = pow(BASE, -1, 1 << 64) if inverse else BASE
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: text_hash() of any range follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters[data] * powers(len(data)), out=out[1:])
    return out


def text_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def text_groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of about `size` bytes of a string column: row numbers, offsets (one more) and bytes. Null is empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield np.arange(i, j), offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work() over batches, that gives the system back what Arrow keeps of batches that are done: workers outlive their tasks, and
    an idle one would hold that beside those at work."""
    release = lambda: pa.default_memory_pool().release_unused()

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for b in batches:
                yield b
                del b
                release()

        yield from work(each())
        release()

    return run


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the documents that offsets cut data into, and the documents' first words (one more)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens = ~space
    closes = ~space
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    if len(inner):
        opens[inner] = ~space[inner]
        closes[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return text_hash(prefix(data), starts, ends)


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | U(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values, wherever they start; runs over documents' ends are for the caller to leave out."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    c, size = multipliers(n), len(hashes) - n + 1
    out = hashes[:size] * c[0]
    for k in range(1, n):
        out += hashes[k : k + size] * c[k]
    return mix(out)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, each member's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, as booleans."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    if len(x) < width:
        return x[:0]
    n, out = 1, x
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return out if n == width else np.minimum(out[: len(x) - width + 1], out[width - n :])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are not compared again."""
    end = min(len(a), len(b))
    low, step = known, 8
    while low < end:
        high = min(end, low + step)
        if a[low:high] != b[low:high]:
            while high - low > 1:
                mid = (low + high) // 2
                if a[low:mid] == b[low:mid]:
                    low = mid
                else:
                    high = mid
            return low
        low, step = high, 2 * step
    return end


def commons(strings: Sequence[bytes], rows: int = 4096) -> np.ndarray:
    """The lengths of the common prefixes of neighbours, `rows` of them compared at once."""
    size = np.array([len(s) for s in strings], np.int64)
    out = np.minimum(size[1:], size[:-1])
    for i in range(0, len(out), rows):
        some = strings[i : i + rows + 1]
        width = max(1, int(size[i : i + rows + 1].max()))
        # Shorter strings are filled up with zeros, which tell nothing as no prefix is longer than its string.
        padded = np.array(some, f"S{width}").view(np.uint8).reshape(len(some), width)
        differ = padded[1:] != padded[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[i : i + rows] = np.minimum(out[i : i + rows], at)
    return out
