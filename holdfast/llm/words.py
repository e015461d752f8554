"""Words and hashes of Arrow text columns, for use inside tasks.

A word is a run of bytes other than space and \\x09-\\x0D. A null text has no words. Everything works on slices of a
batch that are bounded in bytes, so memory does not follow the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
SLICE_ROWS = 4096


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about `limit` text bytes and at most `rows` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit, side="right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each the index of its text. `lower` changes A-Z only."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owner.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the position of each word among them."""
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes, the same in every task."""
    raw = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; shorter by k - 1 than the input (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def starts_of(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of the items of each of n owners, whose items are in order."""
    counts = np.bincount(owner, minlength=n)
    return np.cumsum(counts) - counts, counts
