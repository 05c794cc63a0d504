"""Word and shingle hashes of many texts at once, in numpy: the shared helper of the similarity operators.

Texts are read as UTF-8 bytes. A word's hash is a polynomial over its bytes, taken from prefix sums of a whole block of
bytes, so no Python object is made for a word. Blocks are bounded; a longer text is cut into blocks at its blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that one numpy block covers; what a block needs besides is about 60 times that.
BLOCK_BYTES = 1 << 20
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of each value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        n = max(n, BLOCK_BYTES + (1 << 16))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def _words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a block of bytes; A-Z count as a-z."""
    low = np.where((block >= 65) & (block <= 90), block + np.uint8(32), block)
    inside = np.concatenate([[False], ~((low == 32) | ((low >= 9) & (low <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(low))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], dtype=np.uint64)])
    return mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)), first


def word_hashes(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, words of each text) for runs of texts of about a block's bytes."""
    at, n = 0, len(texts)
    while at < n:
        to, size = at, 0
        while to < n and (to == at or size + len(texts[to] or b"") <= BLOCK_BYTES):
            size += len(texts[to] or b"") + 1
            to += 1
        if to == at + 1 and size > BLOCK_BYTES:
            text, hashes, lo = texts[at], [], 0
            while lo < len(text):
                hi = min(len(text), lo + BLOCK_BYTES)
                while hi < len(text) and text[hi] not in b" \t\n\v\f\r":  # to the end of the word
                    hi += 1
                hashes.append(_words(np.frombuffer(text, np.uint8, hi - lo, lo))[0])
                lo = hi
            words = np.concatenate(hashes)
            yield at, words, np.array([len(words)])
        else:
            run = [t or b"" for t in texts[at:to]]
            words, first = _words(np.frombuffer(b" ".join(run) + b" ", np.uint8))
            ends = np.cumsum([len(t) + 1 for t in run])
            yield at, words, np.diff(np.searchsorted(first, ends), prepend=0)
        at = to


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, sorted distinct shingle hashes text by text, number of them in each text).

    A text of fewer than n words has its whole sequence as one shingle; without words it has none.
    """
    for at, words, counts in word_hashes(texts):
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        h = np.zeros(len(words), np.uint64)
        length = np.minimum(np.repeat(counts, counts), n)
        for k in range(n):  # the shingle that begins at each word, or as many words as there are
            nxt = np.zeros(len(words), np.uint64)
            nxt[: max(0, len(words) - k)] = words[k:]
            use = length > k
            h[use] = mixed(h[use] * np.uint64(3) + nxt[use] + np.uint64(k + 1))
        keep = (place + n <= np.repeat(counts, counts)) | ((np.repeat(counts, counts) < n) & (place == 0))
        h, owner = h[keep], owner[keep]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield at, h, np.bincount(owner, minlength=len(counts))


def binary(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes, None for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def slices(batch, most: int = 8 * BLOCK_BYTES, text: str = "text"):
    """An Arrow batch in runs of rows of at most `most` bytes of text, so that what is made of them stays bounded."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        to, size = at, 0
        while to < batch.num_rows and (to == at or size + sizes[to] <= most):
            size += sizes[to]
            to += 1
        yield batch.slice(at, to - at)
        at = to
