"""Vectorised byte, word and hash helpers shared by the text operators.

Every helper works on the data buffer of an Arrow string column: one uint8 array that holds all
texts of a slice back to back, with an offsets array, so no Python code runs per character or word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Hashes of spans are polynomials modulo this prime: modulo a power of two, structured texts (Thue-Morse words) collide for every base.
PRIME = U64((1 << 61) - 1)
BASES = (0x1E3779B97F4A7C15, 0x0F58476D1CE4E5B9)
#: Bytes of text handled at once; the temporaries of one slice are a few dozen times this.
SLICE_BYTES = 1 << 18
#: Terms that are summed up before they are brought below the prime again; so few that their temporaries stay in the cache (2^20 at most).
RUN = 1 << 15


class _Cache(dict):
    """A dict that is sent to executors empty."""

    def __reduce__(self):
        return _Cache, ()


_powers: dict[int, np.ndarray] = _Cache()
_LOW31, _LOW30, _LOW32, _LOW29 = (U64((1 << n) - 1) for n in (31, 30, 32, 29))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    high = x >> U64(61)
    x = x & PRIME
    x += high
    # below the prime, the difference wraps to a larger number
    return np.minimum(x, x - PRIME)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a0 * b1
    middle += a1 * b0
    out = a0 * b0
    out = (out & PRIME) + (out >> U64(61))
    out += (middle & _LOW30) << U64(31)
    out += middle >> U64(30)
    out += a1 * b1 * U64(2)
    return reduced(out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime; kept while not far longer than a slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < max(n, SLICE_BYTES + 1):
            step = U64(pow(base, len(have), int(PRIME)))
            have = np.concatenate([have, times(have, np.full(len(have), step, U64))])
        if n <= 32 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift, multiply, shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, end row) of runs of rows of about limit bytes; a longer text is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def text_slices(batches, column: str, limit: int = SLICE_BYTES):
    """(record batch rows, bytes, offsets) for each slice of each batch of an Arrow iterator."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for a, b in row_slices(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def byte_table(word: str) -> np.ndarray:
    """256 flags: whether a byte belongs to a word. word is 'space' (all but ASCII white space) or
    'alnum' (lower-case letters, digits, everything outside ASCII)."""
    table = np.zeros(256, bool)
    if word == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
    """Words of all rows: bytes (lower-cased if asked for), word starts, word ends, row of each word."""
    low = LOWER[data] if lower else data
    inside = table[low]
    edge = np.empty(len(low) + 1, bool)
    if len(low) == 0:
        none = np.zeros(0, np.int64)
        return low, none, none, none
    bounds = np.zeros(len(low) + 1, bool)
    bounds[offsets] = True
    edge[0], edge[-1] = inside[0], False
    np.greater(inside[1:], inside[:-1] & ~bounds[1:-1], out=edge[1:-1])
    starts = np.flatnonzero(edge)
    edge[0], edge[-1] = False, inside[-1]
    np.greater(inside[:-1], inside[1:] & ~bounds[1:-1], out=edge[1:-1])
    ends = np.flatnonzero(edge)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return low, starts, ends, rows


def prefix_sums(values: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Running sums of (value + 1) * base^position modulo the prime, one longer than values, which are bytes or numbers below the prime."""
    out = np.zeros(len(values) + 1, U64)
    scale = powers(base, len(values))
    for at in range(0, len(values), RUN):
        part, by = values[at : at + RUN], scale[at : at + RUN]
        if part.dtype == np.uint8:
            part = part.astype(U64) + U64(1)
            # at most 2^20 terms of 40 bits
            low, high = np.cumsum(part * (by & _LOW32)), np.cumsum(part * (by >> U64(32)))
        else:
            term = times(reduced(part + U64(1)), by)
            low, high = np.cumsum(term & _LOW32), np.cumsum(term >> U64(32))
        # high * 2^32, of which 2^61 is 1; low, below 2^60, the two parts and what went before are less than 2^63
        total = (high & _LOW29) << U64(32)
        high >>= U64(29)
        total += high
        total += low
        total += out[at]
        out[at + 1 : at + 1 + len(part)] = reduced(total)
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each span that depends on its values and length alone."""
    scale = powers(pow(base, -1, int(PRIME)), len(sums))
    out = np.empty(len(starts), U64)
    for at in range(0, len(starts), RUN):
        s, e = starts[at : at + RUN], ends[at : at + RUN]
        raw = times(reduced(sums[e] + PRIME - sums[s]), scale[s])
        out[at : at + RUN] = mix(raw + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


_wrapped: dict[int, np.ndarray] = _Cache()
#: An odd base of runs' hashes modulo 2^64, and what stands for each byte in them.
STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64))


def wrapped_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept while not far longer than a slice."""
    have = _wrapped.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, U64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 32 * SLICE_BYTES:
            _wrapped[base] = have
    return have[:n]


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size values, which are bytes or numbers.

    Modulo 2^64 they take a fraction of the time of span_hashes, but structured texts can collide: they choose places and filter, and never tell that runs are equal.
    """
    terms = (_BYTE[values] if values.dtype == np.uint8 else values) * wrapped_powers(STEP, len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    out = sums[size:] - sums[: len(sums) - size]
    out *= wrapped_powers(pow(STEP, -1, 1 << 64), len(out))
    out ^= out >> U64(32)
    out *= U64(0x94D049BB133111EB)
    out ^= out >> U64(31)
    return out


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(low), starts, ends)


def long_lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list column out of flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind) if kind is not None else pa.array(values))
