import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import bpe, orc_tokens, slack_packing
from tidewell.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'’sABcé日0!|\x1c 　"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=8))
def test_encoding_equals_library(texts):
    ids, lengths = bpe.encode(pa.array(texts, pa.string()), tokenizer_path())
    ends = np.concatenate([[0], np.cumsum(lengths)])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == bpe.encode_whole(texts, tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(spark, documents, odd_documents, no_documents, tmp_path):
    path = f"file://{tmp_path}/orc"
    out = orc_tokens.tokens_written_and_read(documents, tokenizer_path(), path).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    want, at = {}, 0
    for i in sorted(texts):
        ids = [*bpe.encode_whole([texts[i]], tokenizer_path())[0], 2]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out} == want
    some = orc_tokens.lookup(spark, path, [3, 150])
    assert {r["doc_id"]: crc(r["tokens"]) for r in some.collect()} == {i: want[i][2] for i in (3, 150)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    odd = orc_tokens.tokens_written_and_read(odd_documents, tokenizer_path()).collect()
    assert len(odd) == 12 and sorted(r["start"] for r in odd) == [sum(sorted_n) for sorted_n in prefixes(sorted(odd, key=lambda r: r["start"]))]
    assert orc_tokens.tokens_written_and_read(no_documents, tokenizer_path()).count() == 0


def prefixes(rows):
    return [[r["n_tokens"] for r in rows[:k]] for k in range(len(rows))]


def test_packing(spark, odd_documents, no_documents):
    rows = slack_packing.pack_documents(odd_documents, tokenizer_path(), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    text = next(r["text"] for r in odd_documents.collect() if r["doc_id"] == 6)
    ids = [*bpe.encode_whole([text], tokenizer_path())[0], 2]
    own = sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64))) and all(r["length"] == 64 for r in own[1:])
    assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own) and sum(r["length"] for r in own) == len(ids)
    assert slack_packing.pack_documents(no_documents, tokenizer_path()).count() == 0


def test_fullest_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 60)
        best, sums = 0, {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        best = max(s for s in sums if s <= room)
        chosen = slack_packing.fullest(room, counts)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())
