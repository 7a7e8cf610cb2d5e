"""Near-duplicates and set joins against brute force, with every awkward case."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import _vec as V
from paperloom.llm import near_duplicates as N
from paperloom.llm import set_join as J
from paperloom.llm.normalize import consistent_text
from tests.conftest import rows

CHUNKS = "chunk_key long, text string, sig long, key string, grams string"


def shingle_set(text):
    w = re.findall(r"[^\W_]+", consistent_text(text).lower())
    return set(zip(w, w[1:], w[2:]))


def brute(data):
    sets = {k: shingle_set(t) for k, t in data if t is not None and k is not None}
    out = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 10 * len(x & y) >= 6 * len(x | y):
            out.append((a, b))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    data = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 40, 150, 700]))]
        data.append((len(data), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            edit = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                at = rng.randrange(len(edit))
                edit[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
                if not edit:
                    edit = ["x"]
            data.append((len(data), " ".join(edit)))
    hot = " ".join(f"hot{i}" for i in range(30))
    data += [(1000 + i, hot) for i in range(12)] + [(2000, hot.replace("h", "һ").upper()), (2001, hot + " tail")]
    return data


def pairs(spark, data):
    df = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in data], CHUNKS)
    return N.near_duplicate_pairs(df)


def test_all_pairs_equal_brute_force(spark, corpus):
    assert rows(pairs(spark, corpus)) == sorted(brute(corpus), key=repr)


def test_small_blocks_and_hot_buckets_lose_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_POSTINGS", 150)
    monkeypatch.setattr(N, "HOT_BUCKET", 3)
    monkeypatch.setattr(N, "BROADCAST_KEYS", 0)
    assert rows(pairs(spark, corpus)) == sorted(brute(corpus), key=repr)


def test_nulls_short_texts_and_repeats(spark):
    data = [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "one two three"), (6, "One,  two THREE!"), (6, "One,  two THREE!"), (None, "one two three"), (7, "ｏｎｅ two thr​ee")]
    assert rows(pairs(spark, data)) == [(5, 6), (5, 7), (6, 7)]
    assert rows(pairs(spark, [])) == []
    assert rows(pairs(spark, [(1, None)])) == []


def test_classes(spark, corpus):
    df = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in corpus] + [(9999, None, 1, None, None)], CHUNKS)
    got = {r["chunk_key"]: (r["class_key"], r["links"]) for r in N.near_duplicate_classes(df).collect()}
    parent = {k: k for k, _ in corpus} | {9999: 9999}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(corpus):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: c for k, (c, _) in got.items()} == {k: find(k) for k in parent}
    assert got[9999] == (9999, 0) and got[2001][1] >= 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(rows(N.components(spark.createDataFrame(edges, "src long, dst long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert rows(N.components(spark.createDataFrame([], "src long, dst long"))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é1_\n²日", max_size=30), max_size=6))
def test_word_hashes_follow_the_words(texts):
    h, doc = V.word_hashes(texts) if texts else ([], [])
    words = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"(?:(?!_)\w)+", t)]
    assert [d for d in doc] == [i for i, _ in words]
    assert len({w for _, w in words}) == len(set(np.asarray(h).tolist()))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: n - n // 4], rng.integers(0, 2**63, n // 4 + 1, dtype=np.uint64)]))
        a = np.unique(a)
        x, y = N._bitmaps(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_accumulated_counts_never_discard_a_similar_pair(spark):
    """Balances of random pairs whose classes' prefixes are compared by hand."""
    rng = random.Random(11)
    data, similar = [], set()
    for p in range(120):
        universe = [(rng.random(), i) for i in range(rng.choice([6, 20, 60]))]
        a = {x for x in universe if rng.random() < 0.85}
        b = {x for x in universe if rng.random() < 0.85}
        if a and b and 8 * len(a & b) >= 3 * (len(a) + len(b)):
            similar.add(p)
        for c in range(4):
            x, y = (sorted(e for e in s if e[1] % 4 == c) for s in (a, b))
            prefix = lambda s: set(s[: len(s) - -(-3 * len(s) // 5) + 1])
            common = prefix(x) & prefix(y)
            for k, e in enumerate(sorted(common)):  # each count from a block of its own
                data.append((p, p, c, 1, len(x), len(y)))
    got = {r["a_sig"] for r in N.accumulated(spark.createDataFrame(data, N.PAIR_SCHEMA)).collect()}
    assert similar <= got and len(similar) > 20


TAGS = "chunk_key long, entities array<string>, paper_title string, title string, values string"


def test_set_join(spark, monkeypatch):
    rng = random.Random(2)
    names = [f"E{i}" for i in range(25)] + ["HOT1", "HOT2"]
    data = []
    for k in range(250):
        e = rng.sample(names, rng.randint(2, 7)) + (["HOT1"] if rng.random() < 0.6 else [])
        data.append((k, e + [None, " ", e[0].lower() + " "], f"Title {k % 40}", None, None))
    data += [(900, ["A1", "B2", "Ｃ３"], " My  Title ", None, None), (901, ["a1 ", "b2", "c3", "c3"], "my title", None, None), (902, ["А1", "B2", "C3"], "Other", None, None)]
    data += [(903, ["A1", "B2", "C3"], None, None, None), (904, None, "x", None, None), (905, ["A1", "B2"], "y", None, None), (902, ["А1", "B2", "C3"], "Other", None, None), (None, ["A1", "B2", "C3"], "z", None, None), (906, ["A1", "B2", "C3"], " ", None, None)]
    form = lambda e: e.translate(str.maketrans("ＡＣ３А", "AC3A")).strip().lower()
    seen = {}
    for k, e, t, *_ in data:
        s = {form(x) for x in e or [] if x and x.strip()}
        if k is not None and t and t.strip() and len(s) >= 3:
            seen[k] = (s, " ".join(t.split()).lower())
    want = [(a, b) for a, b in itertools.combinations(sorted(seen), 2) if seen[a][1] != seen[b][1] and 10 * len(seen[a][0] & seen[b][0]) >= 6 * len(seen[a][0] | seen[b][0])]
    got = rows(J.similar_tag_pairs(spark.createDataFrame(data, TAGS)))
    assert got == sorted(want, key=repr)
    assert (900, 902) in got and (900, 901) not in got
    monkeypatch.setattr(J, "HOT_BUCKET", 3)  # hot buckets in slices, many blocks
    monkeypatch.setattr(J, "BLOCK_POSTINGS", 500)
    assert rows(J.similar_tag_pairs(spark.createDataFrame(data, TAGS))) == got
    kinds = {}
    for k, v in seen.items():
        kinds.setdefault((frozenset(v[0]), v[1]), []).append(k)
    alike = lambda x, y: x[1] != y[1] and 10 * len(x[0] & y[0]) >= 6 * len(x[0] | y[0])
    links = {min(ks): sum(alike(x, y) for y in kinds) for x, ks in kinds.items()}
    classes = rows(J.similar_tag_classes(spark.createDataFrame(data, TAGS)))
    assert classes == sorted(((k, min(ks), links[min(ks)]) for ks in kinds.values() for k in ks), key=repr)
    assert rows(J.similar_tag_pairs(spark.createDataFrame([], TAGS))) == []


def test_band_recall():
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(300):
        v = V.mix(rng.integers(0, 2**63, 5, dtype=np.uint64))
        a, b = v[:4], v[1:]  # 3 of 5 in common: similarity 0.6
        x = J.band_buckets(np.concatenate([a, b]), np.array([0, 4, 8]))
        hit += bool((x[0] == x[1]).any())
    assert hit >= 298
