"""The Jaccard join, against all pairs."""

import re
import sys
from itertools import combinations
from math import comb
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from cueloom.llm import partenum
from cueloom.llm.components import components


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)}


def corpus(seed):
    """Random texts with exact and near copies at all distances, a passage that many share, and short texts."""
    rng = Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \t", "one", "One", "a b c d e", "A b  c d\ne", "a b c d e f"]
    for _ in range(25):
        words = [word() for _ in range(rng.choice([6, 12, 30, 80, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            near = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, len(words) // 40, len(words) // 25])):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    texts += [" ".join([*(word() for _ in range(rng.choice([10, 25, 40]))), passage]) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(spark, seed, monkeypatch):
    if seed > 1:
        monkeypatch.setattr(partenum, "BROADCAST_IDS", 0)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, key string").repartition(3)
    got = partenum.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows) and len(got) == len(rows)
    kept = {r["doc_id"] for r in partenum.drop_near_copies(docs).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string"
    assert partenum.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, "long " + "x y z w v " * 30_000)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["component_size"]) for r in partenum.jaccard_components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 3, 1, 3), (None, 3, 1, 3), (2, 0, 2, 1), (3, 6, 3, 1)}
    assert sorted(str(r["doc_id"]) for r in partenum.drop_near_copies(spark.createDataFrame(rows, schema)).collect()) == ["1", "2", "3", "None"]


@pytest.mark.parametrize("few", [200_000, 0])
def test_repeated_ids_lose_near_copies_only(spark, monkeypatch, few):
    monkeypatch.setattr(partenum, "BROADCAST_IDS", few)
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    lone, twin = " ".join(f"x{i}" for i in range(30)), [" ".join([*(f"y{i}" for i in range(40)), last]) for last in ("a", "b", "c")]
    rows = [
        (1, text), (5, near), (5, lone), (6, lone),  # 5 goes with its near copy of 1 only; its other text leads 6
        (7, twin[0]), (7, twin[1]), (7, twin[1].upper()), (8, twin[2]),  # one row of 7
        (None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 N6"), (9, None), (9, ""), (9, "z"), (None, None),
    ]
    docs = spark.createDataFrame([(*r, ["t"]) for r in rows], "doc_id long, text string, tags array<string>").repartition(3)
    out = partenum.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"] and r["text"].lower()) for r in out.collect()]
    assert sum(i == 7 and t in map(str.lower, twin) for i, t in kept) == 1
    rest = [(i, t) for i, t in kept if i != 7]
    assert sorted(rest, key=str) == sorted([(1, text), (5, lone), (None, "n1 n2 n3 n4 n5 n6"), (9, None), (9, ""), (9, "z"), (None, None)], key=str)


def test_linked_sets_always_share_signatures():
    rng = np.random.default_rng(4)
    pairs = []
    for trial in range(900):
        n = int(rng.choice([1, 2, 4, 5, 6, 7, 9, 10, 12, 15, 19, 25, 40, 80, 150, 400]))
        both = int(rng.integers(max(1, (4 * n + 4) // 5), n + 1)) if n > 4 else n
        extra = int(rng.integers(0, both * 5 // 4 - n + 1)) if both * 5 // 4 >= n else 0
        features = np.unique(rng.integers(0, 1 << 63, n + extra, np.uint64) * np.uint64(2))
        if trial % 3 == 0:
            features = np.unique(features >> np.uint64(rng.integers(1, 9)))  # they crowd in few parts
        rng.shuffle(features)
        a, b = np.sort(features[:n]), np.sort(np.concatenate([features[:both], features[n:]]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            pairs.append((a, b))
    sigs, owner = partenum.signatures([x for p in pairs for x in p])
    order = np.argsort(owner, kind="stable")
    own = np.split(sigs[order], np.cumsum(np.bincount(owner, minlength=2 * len(pairs)))[:-1])
    for n, (a, b) in enumerate(pairs):
        assert np.intersect1d(own[2 * n], own[2 * n + 1]).size, (n, len(a), len(b))
        if n % 50 == 0:
            assert set(own[2 * n].tolist()) == set(partenum.signatures([a])[0].tolist())


def test_signatures_are_those_of_subsets_of_parts():
    """Changing one feature changes exactly the signatures whose subset holds its part."""
    rng = np.random.default_rng(5)
    features = np.sort(rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2))
    i = partenum.band(300)
    first, second, out, _ = partenum.scheme(i)
    assert (second, out) == (partenum.SECOND, partenum.LEFT_OUT) and 0 < out < second and first > partenum.most_differing(i) // (out + 1)
    one, _, _ = partenum._sign([features], i, 0, True)
    assert len(one) == first * comb(second, out)
    for at in (0, 150, 299):
        changed = features.copy()
        changed[at] ^= np.uint64(1)
        other, _, _ = partenum._sign([changed], i, 0, True)
        place = int((int(features[at]) >> 32) * first * second >> 32)
        touched = {place // second * comb(second, out) + n for n, c in enumerate(combinations(range(second), out)) if place % second not in c}
        assert set(np.flatnonzero(one != other).tolist()) == touched and len(touched) == comb(second - 1, out)


def test_texts_with_one_hash_half_stay_apart(spark, monkeypatch):
    """Unequal texts get one key: the second reading turns their hashes round."""
    shared = pa.table({"key": [7, 7, 8], "shared": [2, 2, 2], "doc_id": [0, 1, 2], "check": [11, 12, 13], "n": [4, 4, 4]})
    readings = []

    def reading(ranges, clashing):
        readings.append(clashing)
        return None

    class Texts:
        def select(self, *_):
            return self

        def mapInArrow(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, *_):
            turned = shared if len(readings) == 1 else shared.set_column(0, "key", pa.array([11, 12, 8])).set_column(3, "check", pa.array([7, 7, 13]))
            return spark.createDataFrame(turned.to_pandas(), partenum._SHARED)

    monkeypatch.setattr(partenum, "_read", reading)
    met, clashing = partenum._looked_up_docs(Texts(), 64)
    assert readings == [frozenset(), frozenset({7})] and clashing == {7} and {r["key"] for r in met.collect()} == {11, 12, 8}
    words = np.arange(9, dtype=np.uint64)
    key, check = partenum._key(words, frozenset())
    assert partenum._key(words, frozenset({key})) == (check, key)


def test_sets_with_lone_features_are_left_out_only_if_they_cannot_link():
    """Whatever pruning leaves out links with nothing."""
    rng = Random(3)
    sets = []
    for _ in range(40):
        base = rng.sample(range(1000), rng.choice([5, 20, 60]))
        sets += [set(base)] + [set(rng.sample(base, len(base) - rng.randint(0, len(base) // 3))) | {10_000 + rng.randrange(10**6) for _ in range(rng.randint(0, len(base) // 4))} for _ in range(rng.randint(0, 4))]
    owners = {}
    for x in sets:
        for f in x:
            owners[f] = owners.get(f, 0) + 1
    for i, a in enumerate(sets):
        alone = sum(owners[f] == 1 for f in a)
        for j, b in enumerate(sets):
            if i != j and 100 * len(a & b) >= 80 * len(a | b):
                assert 100 * alone <= 20 * len(a) and 180 * (len(a) - alone) >= 80 * (len(a) + len(b))


def test_components_that_do_not_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["cueloom.llm.components"], "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
