"""Words of texts as integer arrays, a chunk of texts at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, giving free memory back to the system at its end.

    Python workers are used again and idle ones stay: what their allocators hold on to counts for the executor all the time.
    """

    def run(batches):
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
            if trim is not None:
                trim(0)

    return run


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where a column of the table has them."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        out.append(n)
    return out


def tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, offsets, dictionary)``: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, as positions in the dictionary of distinct
    words; text ``i`` has ``codes[offsets[i]:offsets[i+1]]``. A null text has no words."""
    if texts.offset:  # the lower-casing kernel misreads slices: copy them
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():  # white space at an end gives an empty word
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """0 .. parts-1 by the upper half of the hash: grows with it, so sorted hashes give ordered parts."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
