"""Word sets, bit-sliced comparison, near-duplicate search, deduplication against history."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyfold.llm import bitslice, blocks, neardup, wordsets
from tallyfold.llm.components import components
from tallyfold.llm.history import FingerprintStore, bloom, in_bloom
from tallyfold.storage import materialize

SCHEMA = "ord long, id string, title string, body string, extra string"
TEXTS = ["title", "body"]


def jaccard(a, b):
    x, y = wordsets.words_of(a), wordsets.words_of(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def rows_of(seed, n=120):
    """Texts over a small vocabulary, edited copies, exact copies, nulls, blanks, one very long text."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            title, body = out[r.randrange(len(out))][2:4]
            tokens = (body or "").split()
            for _ in range(r.randrange(0, 8)):
                if tokens:
                    tokens[r.randrange(len(tokens))] = r.choice(words)
            body = " ".join(tokens) or None
        else:
            title, body = r.choice(["A title", None, "Zürich İÇ ñandú"]), " ".join(r.choices(words, k=r.choice([3, 8, 30, 60])))
        if r.random() < 0.05:
            body = r.choice([None, "", "   "])
        out.append((i, f"ID{i % 50}" if r.random() < 0.8 else None, title, body, "x"))
    out.append((n, None, None, " ".join(r.choices(words, k=20_000)), None))
    out.append((n + 1, None, None, "... --- !!!", None))  # no word at all
    return out


def truth(rows, threshold=0.7):
    ok = [r for r in rows if r[3] is not None and r[3].strip() and wordsets.words_of(r[2:4])]
    return {(a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :] if jaccard(a[2:4], b[2:4]) >= threshold - 1e-9}


def test_bit_slices_against_popcount():
    rng = np.random.default_rng(1)
    sk = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    sk[50:90] = sk[0:40] ^ np.uint64(5)
    size = rng.integers(5, 200, 300)
    for limit in (lambda t: np.asarray(t) * 0 + 3, lambda t: np.asarray(t) // 4, lambda t: np.asarray(t) * 0 + 128):
        i, j = bitslice.close_pairs(sk, size, limit)
        d = bitslice.distances(sk[:, None], sk[None])
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if d[a, b] <= limit(size[a] + size[b])}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint32)) for _ in range(2))
        x, y = (wordsets.sketches(s, np.zeros(len(s), np.int64), 1) for s in (a, b))
        assert bitslice.distances(x, y)[0] <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_against_brute_force(spark, seed):
    rows = rows_of(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "ord", TEXTS, "body").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == truth(rows)


@pytest.mark.parametrize("split", [1, 7, 40])
def test_hot_blocks_are_dealt_out_as_tiles(spark, split):
    """Near-copies that all share their common words: every block is hot for so small a split."""
    r = random.Random(split)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, None, "t", " ".join(r.sample(base, 38) + [f"own{i}"]), None) for i in range(120)]
    sets = materialize(wordsets.word_sets(spark.createDataFrame(rows, SCHEMA), "ord", TEXTS, "body"), "sets")
    key = {x["set_id"]: x["key"] for x in sets.collect()}
    got = {tuple(sorted((key[p["a"]], key[p["b"]]))) for p in neardup.set_pairs(sets, 0.7, split).collect()}
    assert got == truth(rows) and len(got) > 1000


def test_hot_copies_cost_one_set(spark):
    rows = [(i, None, "t", "one two three four five six seven", None) for i in range(40)] + [(99, None, "t", "one two three four five six eight", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert neardup.near_duplicates(df, "ord", TEXTS, "body").count() == 40 * 39 // 2 + 40
    got = {r["key"]: (r["class_key"], r["n_links"]) for r in neardup.classes(df, "ord", TEXTS, "body").collect()}
    assert got == {i: (0, 40) for i in [*range(40), 99]}


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", 8)], "key long, words string, set_id int")
    assert [tuple(r) for r in neardup.near_duplicates(df, "key", ["words"], "words").collect()] == [(1, 2)]
    assert neardup.near_duplicates(df.limit(0), "key", ["words"], "words").count() == 0
    assert neardup.classes(df.limit(0), "key", ["words"], "words").count() == 0


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3), (1, 2), (1, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 32, 5000).astype(np.uint32)
    f = bloom(np.unique(key))
    assert in_bloom(key, f).all()
    other = np.setdiff1d(rng.integers(0, 1 << 32, 20_000).astype(np.uint32), key)
    assert in_bloom(other, f).mean() < 0.03


def seen_truth(history, batches, threshold=0.7):
    rows = history + batches
    near = truth(rows, threshold)
    new = {r[0] for r in batches}
    same = {(a[0], b[0]) for a in rows for b in batches if a[0] < b[0] and a[1] and b[1] and a[1].strip().lower() and a[1].strip().lower() == b[1].strip().lower()}
    return {p for p in near if p[1] in new} | same


def test_batches_one_by_one_equal_all_at_once(spark):
    rows = [(i, f" {r[1]} " if r[1] and k % 3 == 0 else r[1], *r[2:]) for k, r in enumerate(rows_of(9, 150)) for i in [r[0]]]
    history, batches = rows[:100], rows[100:]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    want = seen_truth(history, batches)
    whole = FingerprintStore.create(df(history), "ord", "id", TEXTS, "body")
    assert set(map(tuple, whole.ingest(df(batches)).collect())) == want
    steps = FingerprintStore.create(df(history), "ord", "id", TEXTS, "body")
    got = []
    for i in range(0, len(batches), 20):
        again = FingerprintStore(spark, steps.path)  # reopened: nothing is kept but the folder
        got += map(tuple, again.ingest(df(batches[i : i + 20])).collect())
    assert set(got) == want and len(got) == len(want)


def test_empty_history_and_empty_batch(spark):
    df = spark.createDataFrame([(1, "A", "t", "one two three", None), (2, " a", None, None, None)], SCHEMA)
    store = FingerprintStore.create(df.limit(0), "ord", "id", TEXTS, "body")
    assert store.ingest(df.limit(0)).count() == 0
    assert [tuple(r) for r in store.ingest(df).collect()] == [(1, 2)]


@pytest.mark.parametrize("common, rare", [(100, 5), (400, 5), (1000, 9)])
def test_pairs_without_a_shared_rare_word_meet(common, rare):
    """Pairs at the threshold; one set has rare words of its own, the other none: all bands count."""
    rng = np.random.default_rng(common)
    blobs, sizes = [], []
    cells = np.full(1 << wordsets.DF_BITS, 1000, np.int64)
    lone = np.arange(rare, dtype=np.uint32) << (32 - wordsets.DF_BITS)
    cells[:rare] = 3
    for _ in range(300):
        union = common - rare
        shared = int(np.ceil(0.7 * (union + rare)))
        words = np.unique(rng.integers(1 << 20, 1 << 32, 2 * common, dtype=np.uint32))
        words = rng.permutation(words)[:union]
        cut = shared + (union - shared) // 2
        a, b = np.concatenate([lone, words[:cut]]), np.concatenate([words[:shared], words[cut:]])
        assert shared / (union + rare) >= 0.7
        for x in (a, b):
            blobs.append(np.sort(x).astype(np.uint32).tobytes())
            sizes.append(len(x))
    row, key, _ = wordsets.keys_of(blobs, np.array(sizes), cells, 16, 0.7, 2)
    keys = [set(key[row == i].tolist()) for i in range(len(blobs))]
    missed = sum(not keys[i] & keys[i + 1] for i in range(0, len(blobs), 2))
    assert missed <= 2, missed


def test_store_commits_names_and_compacts(spark, tmp_path):
    rows = rows_of(12, 60)
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    store = FingerprintStore.create(df(rows[:40]), "ord", "id", TEXTS, "body")
    first = set(map(tuple, store.ingest(df(rows[40:50]), "one").collect()))
    # under its name a batch is reported again and adds nothing
    assert set(map(tuple, store.ingest(df(rows[40:50]), "one").collect())) == first
    assert len(store._manifest()) == 2
    # what an ingest leaves behind that fails before its manifest is never read
    commit, store._commit = store._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.ingest(df(rows[50:]), "two")
    store._commit = commit
    whole = set(map(tuple, FingerprintStore.create(df(rows[:40]), "ord", "id", TEXTS, "body").ingest(df(rows[40:])).collect()))
    store.compact()
    assert len({f for _, f, _ in store._manifest()}) == 1
    assert first | set(map(tuple, store.ingest(df(rows[50:]), "two").collect())) == whole


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_postings_are_packed_without_loss_and_below_their_size(n):
    import zlib

    rng = np.random.default_rng(n)
    rec = np.zeros(n, blocks.POSTING)
    rec["key"], rec["id"], rec["n"] = rng.integers(0, 1 << blocks.KEY_BITS, n), rng.integers(-(1 << 62), 1 << 62, n), blocks.noted(rng.integers(1, 200, n), n % 2)
    rec["s"] = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    blob = blocks.packed(rec)
    both = blocks.unpacked([blob, blob])
    assert len(both) == 2 * n
    for half in (both[:n], both[n:]):
        assert half[np.argsort(half["id"])].tobytes() == rec[np.argsort(rec["id"])].tobytes()
    assert len(blob) == 29 * n and (n < 5000 or len(zlib.compress(blob, 1)) < 27.5 * n)
