"""Consistent form, tokens, packing and splitting."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.functions import consistent as C
from paperloom.llm import normalize as M
from paperloom.llm import packing as P
from paperloom.llm import splitting as S
from paperloom.llm import tokens as T
from paperloom.session import tokenizer_path
from tests.conftest import rows

ODD = "aé Ｋk3Аосбёшαβοι​­  ﬁ‑–'´́̈ß²日"


@pytest.mark.parametrize(
    "text, want",
    [
        ("НН-α", "HH-α"), ("«контроль» wеrе", "«контроль» were"), ("Ｎｏｃ　ｋｉｎａｓｅ", "Noc kinase"), ("Xüfaﬁn", "Xüfafin"), ("u​̈x", "üx"), ("μM² ±5 ° × ≥ – “a” α Δ", "μM² ±5 ° × ≥ – “a” α Δ"),
        ("Dр́x", "Dṕx"), ("µg", "μg"), ("а test", "a test"), ("хор поёт", "хор поёт"), ("ехtent", "extent"), ("α‐isoform", "α-isoform"), ("", ""), ("plain\ttext\n", "plain\ttext\n"),
    ],
)
def test_consistent_text(text, want):
    assert M.consistent_text(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=25))
def test_consistent_form_is_stable(text):
    once = M.consistent_text(text)
    assert M.consistent_text(once) == once
    assert M.consistent_entity(M.consistent_entity(text)) == M.consistent_entity(text)


def test_mapping_conflicts_are_found():
    t = M.transducer(True)
    with pytest.raises(C.MappingConflict):
        t._add("А", "B")
    assert all(not any(c in t.table for c in v) for v in t.table.values())


CHUNKS = "chunk_key long, text string, entities array<string>, field string, pos int"


def test_inconsistent_values(spark):
    data = [(1, "ﬁne", ["PL84", "ＰL84", None, " "], "x", 0), (1, "ﬁne", ["PL84", "ＰL84", None, " "], "x", 0), (2, None, None, None, None), (3, " ​ ", ["​"], None, None), (4, "fine", [" pl84 ", "\xa0BL12"], None, None), (None, "ﬁne", None, None, None), (5, "x" * 300_000 + "\u2028", [], None, None)]
    df = spark.createDataFrame(data, CHUNKS)
    assert rows(M.inconsistent_values(df)) == sorted([(1, "text", -1), (1, "entities", 1), (4, "entities", 1), (5, "text", -1)], key=repr)
    assert rows(M.inconsistent_values(df.limit(0))) == []
    whole = M.consistent_chunks(df).where("chunk_key = 1").first()
    assert whole["text"] == "fine" and whole["entities"] == ["PL84", "PL84", None, " "] and M.consistent_chunks(df).count() == 7
    catalog = spark.createDataFrame([(7, "PL84")], "entity_id int, name string")
    assert rows(M.catalogued_entities(df, catalog).where("chunk_key = 4").select("pos", "spelling", "entity_id")) == [(0, " pl84 ", 7), (1, " BL12", -1)]


@pytest.fixture(scope="module")
def enc():
    return T.encoding(tokenizer_path(T.VOCABULARY))


def joined(text, limit, enc):
    assert "".join(p for p, _ in T.segments(text, limit)) == text
    with ThreadPoolExecutor(2) as pool:
        return T.encode_text(text, enc, pool, limit).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "1", "23", "'", "'s", "!", "…", "é", "日本", "😀", "‍", "=", "-", "aaaaaaaa", "        ", "00000"]), max_size=120), st.sampled_from([16, 40, 100]))
def test_tree_concatenation_is_exact(parts, limit):
    e = T.encoding(tokenizer_path(T.VOCABULARY))
    text = "".join(parts)
    assert joined(text, limit, e) == e.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "日本語" * 1500, "0123456789" * 600, "=-" * 3000, "the" * 2000, "é" * 3000])
def test_long_unsplit_text(text, enc):
    assert joined(text, 300, enc) == enc.encode_ordinary(text)


def test_encode(spark, enc):
    long = " ".join(f"Word{i} of a long text." for i in range(4000)) + "a" * 40_000
    texts = [None, "", "   ", "Hello world", "<|endoftext|>", long, "x" * 50_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, "Hello world", "k"), (None, "null id", "k")], "doc_id long, text string, key string")
    got = {(r["doc_id"], tuple(r["ids"])) for r in T.encode(df).collect()}
    want = {(i, tuple(enc.encode_ordinary(t) if t else ())) for i, t in enumerate(texts)} | {(None, tuple(enc.encode_ordinary("null id")))}
    assert got == want
    counts = {r["doc_id"]: r["n_tokens"] for r in T.encode(df, counts_only=True).collect()}
    assert counts[0] == counts[1] == 0 and counts[6] == len(enc.encode_ordinary(texts[6]))
    assert T.encode(df.limit(0)).count() == 0
    assert enc.decode(enc.encode_ordinary(long)) == long


def test_repeated_and_conflicting_rows_stay(spark, enc):
    a, b = "Word one of a long text. " * 2_000, "z" * 40_000
    texts = [(1, "short"), (1, "short"), (2, a), (2, a), (3, a), (3, b), (None, b)]
    got = sorted(((r["doc_id"] or 0, tuple(r["ids"])) for r in T.encode(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert got == sorted((k or 0, tuple(enc.encode_ordinary(t))) for k, t in texts)


def lower_bound(counts, capacity):
    return -(-int((counts * np.arange(len(counts))).sum()) // capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_uses_every_item_once(sizes):
    counts = np.bincount(sizes, minlength=21) if sizes else np.zeros(21, int)
    used, bins = np.zeros(21, int), 0
    for m, content in P.plan(counts, 20):
        assert m > 0 and 0 < sum(s * k for s, k in content) <= 20
        bins += m
        for s, k in content:
            used[s] += m * k
    assert (used == counts).all() and bins >= lower_bound(counts, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_loses_no_container(sizes):
    """What the reduction fixes is part of some best packing."""
    def best(items):
        items = sorted(items, reverse=True)
        for n in range(1, len(items) + 1):
            if fits(items, [12] * n):
                return n
        return 0

    def fits(items, room):
        if not items:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= items[0] and r not in tried:
                tried.add(r)
                room[i] -= items[0]
                if fits(items[1:], room):
                    room[i] += items[0]
                    return True
                room[i] += items[0]
        return False

    counts = np.bincount(sizes, minlength=13)
    fixed = sum(m for m, _ in P.reduce_dominated(counts, 12))
    rest = [s for s in range(13) for _ in range(int(counts[s]))]
    assert fixed + (best(rest) if rest else 0) == best(sizes)


def test_pack(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 3, 40, 55, 60, 99, 100, 101, 250])) for i in range(400)] + [(1000 + i, 50) for i in range(200)] + [(5000, None), (None, 5)]
    got = P.pack(spark.createDataFrame(items, "key long, size int"), 100).collect()
    load = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    whole = {}
    for r in got:
        whole[r["key"]] = whole.get(r["key"], 0) + r["size"]
    assert whole == {k: s for k, s in items if k is not None and s}
    assert all(r["size"] == 100 or r["piece"] == whole[r["key"]] // 100 for r in got if whole[r["key"]] > 100)
    assert len(got) == len({(r["key"], r["piece"]) for r in got})
    assert P.pack(spark.createDataFrame([], "key long, size int"), 100).count() == 0


def test_most_words():
    for limit in (1, 7, 50, 650):
        n = S.most_words(limit)
        assert n * 4 // 3 <= limit < (n + 1) * 4 // 3


def random_text(rng, n, seps):
    return "".join(rng.choice(["Alpha", "beta", "Gamma,", "x", "end.", "Stop!", "(Fig.", "no"]) + rng.choice(seps) for _ in range(n))


@pytest.mark.parametrize("seps", [[" "], [" ", " ", "\n"], [" ", "  ", "\n\n", "\r\n", " ", " "]])
def test_pieces_cover_every_word_in_order(seps):
    rng = random.Random(4)
    texts = [random_text(rng, n, seps) for n in (1, 30, 100, 101, 900, 2500)] + ["", " \n", "w" * 5000, "w " * 3000]
    for text, pieces in zip(texts, S.split_texts(texts, 133, 20)):
        words = text.split()
        rebuilt, shared = [], []
        for k, (start, new, end, n) in enumerate(pieces):
            part = text[start:end].split()
            assert len(part) == n and n * 4 // 3 <= 133
            fresh = text[new:end].split()
            shared.append(n - len(fresh))
            rebuilt += fresh
        assert rebuilt == words
        assert not shared or (shared[0] == 0 and max(shared) * 4 // 3 <= 20)


def test_cuts_stand_at_natural_boundaries():
    rng = random.Random(9)
    text = " ".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(11)).capitalize() + "." for _ in range(300))
    pieces = S.split_texts([text])[0]
    assert len(pieces) > 5 and all(text[e - 1] == "." for _, _, e, _ in pieces) and all(text[s].isupper() for s, *_ in pieces)
    assert all(n - len(text[new:e].split()) > 0 for _, new, e, n in pieces[1:])


def test_an_edit_changes_neighbours_only():
    rng = random.Random(3)
    sentences = [" ".join(rng.choice(["cell", "gene", "fold", "beta", "rise", "loss", "site", "gate"]) + str(rng.randint(0, 99)) for _ in range(9)).capitalize() + "." for _ in range(600)]
    before = [" ".join(sentences)[a:e] for _, a, e, _ in S.split_texts([" ".join(sentences)])[0]]
    sentences.insert(60, "One new sentence stands here now.")
    after = [" ".join(sentences)[a:e] for _, a, e, _ in S.split_texts([" ".join(sentences)])[0]]
    assert len(set(after) - set(before)) <= 8 < len(after)


def test_long_last_sentences_are_shared_in_part():
    text = " ".join(" ".join(f"w{i}x{j}" for j in range(90)).capitalize() + "." for i in range(30))
    pieces = S.split_texts([text])[0]
    assert len(pieces) > 3
    for _, new, e, n in pieces[1:]:
        assert 0 < (n - len(text[new:e].split())) * 4 // 3 <= S.OVERLAP


def test_split_oversized(spark):
    big = "Sentence one is here. " * 400
    data = [(1, big, 0, "t"), (1, big, 0, "t"), (2, "short", 0, "t"), (3, None, 0, "t"), (4, " \n ", 0, "t"), (None, big, 0, "t"), (5, " ".join("x" * 488), 0, "t"), (6, "ab " * 489, 0, "t")]
    df = spark.createDataFrame(data, "id long, text string, piece int, key string")
    got = S.split_oversized(df, "id", "text")
    assert rows(got.select("item_key").distinct()) == [(1,), (6,)]
    assert got.count() == got.select("item_key", "piece").distinct().count() and got.where("n_tokens > 650").count() == 0
    assert S.split_oversized(df.limit(0), "id", "text").count() == 0
