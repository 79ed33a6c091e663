"""Words of many texts at once, by Arrow: runs of characters other than space and the ASCII controls 9 to 13."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_array(texts: pa.Array) -> pa.Array:
    """A contiguous string array with its own buffers, offsets from 0."""
    return pa.concat_arrays([texts, pa.array([], pa.string())]) if texts.offset else texts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets), copied and with no text before the first."""
    texts = as_array(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]


def coded_words(texts: pa.Array, lower: bool = False, lookup: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each token's word, tokens of each text); `lower` turns A-Z to a-z first, `lookup` bytes to others,
    of which those beyond 127 must stay as they are."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, offsets = buffers(texts)
    if lookup is not None:
        data = lookup[data]
    if lower:
        data[(data >= 65) & (data <= 90)] += 32
    data[(data >= 9) & (data <= 13)] = 32
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    lists = pc.split_pattern(plain, " ")
    ends = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty < 0:
        return coded.dictionary, codes, np.diff(ends).astype(np.int64)
    is_word = codes != empty
    upto = np.concatenate([[0], np.cumsum(is_word)])
    return coded.dictionary, codes[is_word], np.diff(upto[ends - ends[0]])


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
