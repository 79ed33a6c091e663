"""Byte-level BPE of whole texts with the tokenizers library, one encoding for each distinct word of a batch.

The pre-tokenizer always starts a new token group at a space that stands between two characters which are no white space. So a text
may be cut there, and the ids of its parts, encoded alone, follow one another as in the whole text. The parts are dictionary-encoded
by Arrow; the library sees each distinct part once, many of them joined to one string.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space next to white space, or at an end: such texts are cut by the slower, exact pattern.
ODD = r"\s\s|^\s|\s$|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = re.compile(r"(?<=\S) (?=\S)")
JOINED = 512
#: Words a worker remembers at most; further ones are encoded each time.
KNOWN = 300_000
MARKS = (".", ",")


@functools.lru_cache(maxsize=2)
def loaded(path: str):
    """The tokenizer of a worker, and for each id whether its bytes begin with a space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    opens = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
        opens[number] = token.startswith("Ġ")
    return tokenizer, opens


def encode_parts(tokenizer, opens: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each part with a space before it, one after another, and how many each part has."""
    ids, lengths = [np.zeros(0, np.uint32)], np.zeros(len(parts), np.int64)
    plain = [i for i, p in enumerate(parts) if p and " " not in p and not p[0].isspace()]
    alone = sorted(set(range(len(parts))).difference(plain))
    order: list[int] = []
    for at in range(0, len(plain), JOINED):
        some = plain[at : at + JOINED]
        got = np.array(tokenizer.encode("".join([" " + parts[i] for i in some]), add_special_tokens=False).ids, dtype=np.uint32)
        starts = np.flatnonzero(opens[got])
        if len(starts) == len(some) and starts[0] == 0:
            lengths[some] = np.diff(np.append(starts, len(got)))
            ids.append(got)
            order += some
        else:  # a special token within a part takes no space before it
            alone += some
    for i in alone:
        got = np.array(tokenizer.encode(" " + parts[i], add_special_tokens=False).ids, dtype=np.uint32)
        lengths[i] = len(got)
        ids.append(got)
        order.append(i)
    flat = np.concatenate(ids)
    if order != list(range(len(parts))):
        took = lengths[order]
        begins = np.zeros(len(parts), np.int64)
        begins[order] = np.cumsum(took) - took
        flat = flat[gathered(begins, lengths)]
    return flat, lengths


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of `length` places for each pair, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    kind = np.int32 if ends[-1] < 2**31 and starts.max() < 2**31 else np.int64
    return np.arange(ends[-1], dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


class Memory:
    """Ids of the words that a worker has met first, up to KNOWN of them."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def memory_of(tokenizer) -> Memory:
    return Memory()


def remembered(tokenizer, opens: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As encode_parts, with begins; parts met before are not encoded again."""
    own = memory_of(tokenizer)
    known = np.array([-1 if (k := own.number.get(p)) is None else k for p in parts], dtype=np.int64)
    new = np.flatnonzero(known < 0)
    ids, counts = encode_parts(tokenizer, opens, [parts[i] for i in new])
    begins, lengths = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    old = known >= 0
    begins[old], lengths[old] = own.begins[known[old]], own.lengths[known[old]]
    begins[new], lengths[new] = len(own.ids) + np.cumsum(counts) - counts, counts
    both = np.concatenate([own.ids, ids])
    room = new[: KNOWN - len(own.number)]
    if len(room):
        own.number.update(zip([parts[i] for i in room], range(len(own.number), len(own.number) + len(room))))
        own.begins, own.lengths = np.append(own.begins, begins[room]), np.append(own.lengths, lengths[room])
        own.ids = both[: int(begins[room[-1]] + lengths[room[-1]])].copy()
    return both, begins, lengths


def encode_words(tokenizer, opens: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where those of each word begin and how many they are; a last full stop or comma after a letter is a group of its own."""
    marked = [pc.match_substring_regex(words, rf"^[A-Za-z]+\{mark}$").to_numpy(zero_copy_only=False) for mark in MARKS]
    stems = pc.if_else(pa.array(marked[0] | marked[1]), pc.utf8_slice_codeunits(words, 0, stop=-1), words).dictionary_encode()
    ids, begins, lengths = remembered(tokenizer, opens, stems.dictionary.to_pylist())
    at = stems.indices.to_numpy()
    begins, lengths = begins[at], lengths[at]
    tails = [np.array(tokenizer.encode(mark, add_special_tokens=False).ids, np.uint32) for mark in MARKS]
    both, which = [ids], np.flatnonzero(marked[0] | marked[1])
    if len(which):
        longer = lengths[which] + np.where(marked[0][which], len(tails[0]), len(tails[1]))
        ends = np.cumsum(longer)
        new = np.zeros(int(ends[-1]), np.uint32)
        new[gathered(ends - longer, lengths[which])] = ids[gathered(begins[which], lengths[which])]
        for mark, tail in zip(marked, tails):
            for k, number in enumerate(tail):
                new[(ends - len(tail) + k)[mark[which]]] = number
        begins[which], lengths[which] = len(ids) + ends - longer, longer
        both.append(new)
    return np.concatenate(both), begins, lengths


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, ids of each text), equal to the library's own on each whole text."""
    tokenizer, opens = loaded(path)
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    words, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
    if odd.any():
        own = {int(i): CUT.split(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        pieces, at, offsets = [], 0, lists.offsets.to_numpy()
        for i, parts in own.items():
            pieces += [words.slice(int(offsets[at] - offsets[0]), int(offsets[i] - offsets[at])), pa.array(parts, pa.string())]
            counts[i], at = len(parts), i + 1
        pieces.append(words.slice(int(offsets[at] - offsets[0])))
        words = pa.concat_arrays(pieces)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    ids, begins, lengths = encode_words(tokenizer, opens, coded.dictionary)
    firsts = np.cumsum(counts) - counts
    first_words = words.take(pa.array(firsts)).dictionary_encode()
    heads = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(first_words.dictionary.to_pylist(), add_special_tokens=False)]
    head_lengths = np.array([len(h) for h in heads], np.int64)
    head_begins = len(ids) + np.cumsum(head_lengths) - head_lengths
    ids = np.concatenate([ids, *heads])
    begin, length = begins[codes], lengths[codes]
    first_codes = first_words.indices.to_numpy().astype(np.int64)
    begin[firsts], length[firsts] = head_begins[first_codes], head_lengths[first_codes]
    ends = np.concatenate([[0], np.cumsum(length)])
    return ids[gathered(begin, length)], ends[firsts + counts] - ends[firsts]


def encode_whole(texts: Iterable[str], path: str) -> list[list[int]]:
    """The library on each whole text; for tests and short inputs."""
    return [e.ids for e in loaded(path)[0].encode_batch(list(texts), add_special_tokens=False)]
