import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import order_minhash as om
from tidewell.llm.components import connected_components


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [shingles(t)[0] for _, t in rows]
    bags = [Counter(w) for w in words]
    for i in range(len(rows)):
        for j in range(i):
            a, b, most = words[i], words[j], int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if root(i) == root(j):  # joined already
                continue
            if max(len(a), len(b)) - sum((bags[i] & bags[j]).values()) > most:  # so many edits at least
                continue
            if (rows[i][1] or "") == (rows[j][1] or "") or edit_distance(a, b) <= most:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), set()).add(rows[i][0])
    return {frozenset(g) for g in groups.values()}


def classes(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert all(k == min(v) for k, v in groups.items() if k is not None)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(60))
def test_banded_alignment_equals_edit_distance(seed):
    rng = random.Random(seed)
    a = [rng.randrange(5) for _ in range(rng.randrange(1, 60))]
    b = list(a)
    for _ in range(rng.randrange(12)):
        k = rng.randrange(len(b) + 1)
        rng.choice([lambda: b.insert(k, 9), lambda: b.pop(min(k, len(b) - 1)) if len(b) > 1 else None, lambda: b.__setitem__(min(k, len(b) - 1), 7)])()
    true = edit_distance(a, b)
    assert om.edit_distance_within(np.array(a), np.array(b), 60) == true
    for band in range(true + 4):
        assert om.edit_distance_within(np.array(a), np.array(b), band) == min(true, band + 1)
        assert om.edit_distance_within(np.array(b), np.array(a), band) == min(true, band + 1)


def test_classes_equal_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rng = random.Random(3)
    extra, base = [], [w for _, t in rows[:3] for w in t.split()][:300]
    for k in range(40):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
        extra.append((10_000 + k, " ".join(own)))
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    assert classes(om.near_duplicate_classes(df)) == brute_classes(rows + extra)


def test_odd_rows(odd_documents, no_documents):
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicate_classes(odd_documents).collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == got[7] == 3 and got[6] == 6 and got[None] is None
    assert om.near_duplicate_classes(odd_documents).count() == 12
    assert om.near_duplicate_classes(no_documents).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and {got[k] for k in range(200, 260)} == {200}


def test_hot_family_of_near_copies(spark):
    """A family whose members differ from one another more than from its middle, and outliers: as by brute force."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 260):
        own = list(base)
        for _ in range(rng.randrange(1, 8)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10_000)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(om.near_duplicate_classes(df)) == brute_classes(rows)


def test_common_counts():
    from tidewell.llm.linking import common_counts

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(9000, size=rng.integers(1, 9000))) for _ in range(7)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = common_counts(sets)
    assert all(got[i][j] == want[i][j] for i in range(7) for j in range(i + 1, 7))
    many = [np.unique(rng.integers(400, size=60)) for _ in range(50)]
    got = common_counts(many)
    assert all(got[i][j] == len(np.intersect1d(many[i], many[j])) for i in range(50) for j in range(i + 1, 50))


@pytest.mark.parametrize("similarity, least", [(0.95, 0.99), (0.9, 0.99), (0.85, 0.97), (0.8, 0.9)])
def test_recall_over_the_range_of_the_limit(similarity, least):
    """Pairs of 200 words with substitutions at random places: how many share a sketch, so that the alignment sees them."""
    import pyarrow as pa

    rng = random.Random(int(similarity * 100))
    a, b = [], []
    for _ in range(300):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        a.append(" ".join(words))
        for k in rng.sample(range(200), round((1 - similarity) * 200)):
            words[k] = f"x{rng.randrange(3000)}"
        b.append(" ".join(words))
    keys = om.sketches(pa.array(a + b))
    assert all(om.aligned(x, y) for x, y in zip(a, b))
    assert (keys[:300] == keys[300:]).any(axis=1).mean() >= least


def test_a_tile_splits_its_texts_once(monkeypatch):
    """Texts of the same words in other orders pass every bound, so all pairs are aligned: their words are split once for the tile, not for each pair."""
    import pyarrow as pa

    from tidewell.llm import linking

    rng = random.Random(4)
    members = []
    for k in range(30):
        words = [f"w{i}" for i in range(60)]
        rng.shuffle(words)
        members.append({"component": k, "body": " ".join(words)})
    near = members[7]["body"].split()
    near[20:25] = ["other"] * 5
    members.append({"component": 30, "body": " ".join(near)})
    kind = pa.list_(pa.struct([("component", pa.int64()), ("body", pa.string())]))
    tile = pa.RecordBatch.from_arrays([pa.array([members], kind), pa.array([None], kind)], names=["members_i", "members_j"])
    calls, split = [], om.word_sets
    monkeypatch.setattr(om, "word_sets", lambda texts: calls.append(len(texts)) or split(texts))
    (found,) = linking.tile_links(om.labelled_words, linking.of_larger, om.LIMIT)([tile])
    assert found.to_pydict() == {"a": [7], "b": [30]} and calls == [31]


def test_components_of_few_links_take_few_tasks(spark):
    """Tables of a round are no longer written by a task for each partition of a shuffle; beyond the rows of a task and the bytes of a broadcast the components are the same."""
    from tidewell.llm import components

    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(300, size=(160, 2))]
    parent = list(range(300))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = {k: root(k) for pair in links if pair[0] != pair[1] for k in pair}
    df = spark.createDataFrame(links, "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    kept = components.TASK_ROWS, components.POINTER_BYTES
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for components.TASK_ROWS, components.POINTER_BYTES, most in ((*kept, 1), (1, 0, 7)):
            out = connected_components(df)
            assert {r["node"]: r["component"] for r in out.collect()} == want
            assert len(out.inputFiles()) <= most
    finally:
        components.TASK_ROWS, components.POINTER_BYTES = kept
        for k, v in before.items():
            spark.conf.set(k, v)
