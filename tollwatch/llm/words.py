"""Words and word windows of whole texts, as numpy arrays over the bytes of a batch.

Tasks get Arrow batches. ``chunks`` cuts a batch into runs of whole texts of a
few megabytes, so that memory depends on the longest text, not on the batch.
A null text has no words. Hashes are polynomials modulo 2**64 over bytes, and
over word hashes for windows, finished with a mixing step; ``seed`` picks one
of many independent functions.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20


def mix(x):
    """Spread the bits of unsigned 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The one base of all polynomials, so that a worker holds its powers once.
BASE = 0x5851F42D4C957F2D


@functools.lru_cache(16)
def _table(seed):
    rng = np.random.default_rng(1000 + seed)
    return rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS = []


def _powers(size):
    """Powers of the base and of its inverse; 32 MB at most are kept for later chunks."""
    if _POWERS and len(_POWERS[0]) >= size:
        return _POWERS
    most = CHUNK_BYTES + 1
    both = []
    for number in (BASE, pow(BASE, -1, 2**64)):
        steps = np.full(max(size, most), np.uint64(number), np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    if size <= most:
        _POWERS[:] = both
    return both


def prefix_hashes(values):
    """Function from pairs of bounds to hashes of ``values[start:end]``."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=total[1:])

    def of(start, end):
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))

    return of


def range_hashes(values, start, end):
    """Hash of ``values[start:end]`` for each pair of bounds."""
    return prefix_hashes(values)(start, end)


def byte_set(pattern):
    """Table of the bytes for which ``pattern(byte)`` holds."""
    return np.array([bool(pattern(b)) for b in range(256)])


#: Words are runs of anything but ASCII white space.
SPACED = byte_set(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_set(lambda b: 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


class Texts:
    """Bytes, word bounds and per-text word ranges of some texts.

    ``start`` and ``end`` are byte bounds of the words, ``first[d]`` to
    ``first[d + 1]`` the words of text ``d``, ``at[d]`` its first byte.
    """

    def __init__(self, data, at, word_bytes=SPACED, fold=None):
        self.data = fold[data] if fold is not None else data
        self.at = at
        inside = word_bytes[self.data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        edges = at[:-1][at[:-1] < len(data)]
        before[edges] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:] & before[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self):
        return len(self.at) - 1

    @property
    def counts(self):
        return np.diff(self.first)

    @functools.cached_property
    def doc(self):
        """Text number of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def words(self, seed=0):
        """Hash of each word."""
        return range_hashes(_table(seed)[self.data], self.start, self.end)

    def window_starts(self, size):
        """Words at which ``size`` words of one text begin."""
        place = np.arange(len(self.start))
        return place[place + size <= self.first[1:][self.doc]] if len(place) else place

    def window_hashes(self, hashes, starts, size):
        return range_hashes(hashes, starts, starts + size)

    def text_sums(self, values):
        """Sum per text of a number per byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def word_sums(self, values):
        """Sum per text of a number per word."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def covered(n, starts, size):
    """Which of ``n`` words lie in a window of ``size`` words at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:-1]) > 0


def raw(column):
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(batches, column, limit=CHUNK_BYTES):
    """Pairs of a slice of a record batch and the bytes and offsets of its texts."""
    for batch in batches:
        data, at = raw(batch.column(column))
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
            yield (batch.slice(low, high - low),
                   data[at[low]:at[high]], at[low:high + 1] - at[low])
            low = high


def of_strings(values, **options):
    """``Texts`` of a list of strings."""
    data, at = raw(pa.array(values, pa.large_string()))
    return Texts(data, at, **options)
