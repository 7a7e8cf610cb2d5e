"""Defects of answers and residue in documents: awkward cases and held-out accuracy."""

import random

import numpy as np
import pytest

from paperloom.llm import qa_defects as Q
from paperloom.llm import residue as R
from tests.conftest import rows

EN = ["The loss of XAB12 raised cell growth in the liver and was not seen without it.", "We found that the response of the cells to QRS77 was weak in all of the samples.", "These data show that DEF45 is needed for the transport of zinc by the cells."]
DE = ["Der Verlust von XAB12 hat die Zellteilung in der Leber nicht verändert und wurde bestätigt.", "Diese Daten zeigen, dass die Zellen ohne QRS77 nicht wachsen und das Gewebe reift."]
FR = ["La perte de XAB12 a réduit la division des cellules dans le foie, mais pas sans elle.", "Ces résultats montrent que les cellules ne sont pas sensibles à QRS77 dans le tissu."]
ES = ["La pérdida de XAB12 ha reducido la división de las células en el hígado y no se recupera.", "Estos datos muestran que las células no responden a QRS77 en los tejidos del animal."]
QUESTION = "How does the loss of XAB12 affect the growth of cells in the liver?"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        for q, answers in ((QUESTION, EN), ("Wie verändert der Verlust von XAB12 die Zellen in der Leber und wie nicht?", DE), ("Comment la perte de XAB12 a-t-elle réduit les cellules dans le foie ?", FR), ("¿Cómo ha reducido la pérdida de XAB12 las células en el hígado?", ES)):
            data.append((len(data), q, " ".join(rng.sample(answers, rng.randint(1, len(answers))))))
    for _ in range(60):
        data.append((len(data), QUESTION, "I'm afraid the text supplied is silent on XAB12; more context would be needed."))
    cases = {
        10_001: (None, "empty"), 10_002: (" \n", "empty"), 10_003: ("N/A", "empty"), 10_004: ("Answer:", "empty"), 10_005: ("—", "empty"), 10_006: ("{}", "empty"),
        10_007: (QUESTION, "copies_question"), 10_008: (QUESTION.upper().rstrip("?"), "copies_question"), 10_009: ("Question: " + QUESTION, "copies_question"), 10_010: (QUESTION + " " + EN[1], None),
        10_011: ("I cannot answer this from the passages given.", "refusal"), 10_012: ("Sorry - the sources at hand do not address XAB12.", "refusal"), 10_013: ("Cells lacking XAB12 cannot repair the lesion and do not recover within 8 h.", None),
        10_014: (DE[0], "other_language"), 10_015: (FR[0], "other_language"), 10_016: ("Потеря XAB12 замедляет деление клеток.", "other_language"),
        10_017: ("The loss of XAB12 raised cell growth in the liver and was not seen without", "truncated"), 10_018: ("We found that the response of the cells to QRS77 was weak in all of the ...", "truncated"), 10_019: ("These data show that DEF45 is needed for the (", "truncated"),
        10_020: ("Yes", None), 10_021: ("51 min", None), 10_022: ("XAB12 and QRS77", None), 10_023: (EN[0] + "\n\nReferences:\n- [12]", None), 10_024: ("- XAB12\n- QRS77", None), 10_025: ("“" + EN[1] + "”", None),
    }
    data += [(k, QUESTION, a) for k, (a, _) in cases.items()]
    data += [(10_001, QUESTION, None), (None, QUESTION, None), (20_001, None, EN[0]), (20_002, None, None), (20_003, " ", DE[0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "question_id long, question string, answer string, defect string")
    return df, {k: d for k, (_, d) in cases.items() if d} | {20_002: "empty"}


def test_defects(table):
    df, want = table
    got = {r["question_id"]: r["defect"] for r in Q.defects(df).collect()}
    assert {k: d for k, d in got.items() if k >= 10_000} == want
    assert {d for k, d in got.items() if k < 10_000} == {"refusal"} and sum(k < 10_000 for k in got) == 60


def test_defects_of_an_empty_table(spark):
    assert rows(Q.defects(spark.createDataFrame([], "question_id long, question string, answer string"))) == []


def test_long_answers_are_read_whole(spark):
    long = " ".join(EN) + " " + "The cells grow. " * 20_000
    df = spark.createDataFrame([(1, QUESTION, long), (2, QUESTION, long + "We then saw that the")] + [(3 + i, QUESTION, EN[i % 3]) for i in range(50)], "question_id long, question string, answer string")
    assert rows(Q.defects(df)) == [(2, "truncated")]


def test_refusals_are_counted_over_all_answers(spark):
    df = spark.range(70_000).selectExpr("id AS question_id", "'Why?' AS question", "CASE WHEN id % 10 = 0 THEN 'I cannot answer this.' ELSE 'Cells grow.' END AS answer")
    got = {r["setting"]: r for r in Q.refusal_validation(df).collect()}["all phrases"]
    assert (got["n"], got["found"], got["precision"], got["recall"]) == (7_000, 7_000, 1.0, 1.0)


CLEAN = ["The loss of XAB{n} raised growth in the liver.", "An error rate of {n} was tolerated; service intervals were not altered.", "We ran the script with ${{PATH}} unset.", "Of the {n} donors contacted, 17 were not found at follow-up.", "The set {{XAB{n}, QRS7}} was excluded.", "Template DNA was filled in with polymerase.", "Levels of QRS{n} rose in mice [{n}].", "The variable __name__ and the pattern %d appear in the code."]
DIRTY = {
    "placeholder": ["Cite as: {{{{ author list }}}}.", "The lower panel shows [insert figure id].", "Correspondence about <enter doi here> should be sent.", "We thank ${{author}} for reagents."],
    "filler": ["Lorem ipsum dolor sit amet.", "Dummy text dummy text dummy text", "Text goes here."],
    "error_page": ["Error {n} - the database cannot be reached right now.", "502 Bad Gateway", "Request timed out after {n} s.", "Seite nicht gefunden."],
    "script_notice": ["Please enable JavaScript to view this page.", "Veuillez activer JavaScript pour continuer.", "Your browser does not support scripts, which this viewer depends on."],
}


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    data, want = [], {}
    fill = lambda s: s.format(n=rng.randint(1, 999))
    for i in range(900):
        text = [fill(rng.choice(CLEAN)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            kind = rng.choice(list(DIRTY))
            text.insert(rng.randint(0, len(text)), fill(rng.choice(DIRTY[kind])))
            want[i] = kind
        data.append((i, rng.choice(["\n", "\n\n"]).join(text), f"host{i % 23}", "x"))
    data += [(5000, None, "h", None), (5001, "", None, None), (5002, " \n", "h", None), (0, data[0][1], "host0", "x"), (5003, "A clean sentence stands here. " * 20_000 + "\nPlease enable JavaScript to view this page.", "h", None), (None, "Lorem ipsum dolor", "h", None)]
    want[5003] = "script_notice"
    return spark.createDataFrame(data, "doc_id long, text string, source string, residue string"), want


def test_residue(documents):
    df, want = documents
    assert {r["doc_id"]: r["residue"] for r in R.residue(df).collect()} == want
    left = {r["doc_id"] for r in R.clean_documents(df.where("doc_id IS NOT NULL")).collect()}
    assert left.isdisjoint(want) and {5000, 5001, 5002} <= left


def test_unseen_hosts(documents):
    got = {(r["setting"], r["kind"]): r for r in R.validation(documents[0]).collect()}
    for kind in R.KINDS[1:]:
        r = got["unseen hosts", kind]
        assert r["recall"] > 0.95 and r["precision"] > 0.95, r


def test_only_the_weights_decide(documents):
    nothing = (np.zeros((R.BUCKETS, len(R.KINDS)), np.float32), 0.05)
    assert rows(R.residue(documents[0], nothing)) == []
    assert "FAMILIES" not in R.residue.__code__.co_names + tuple(n for c in R.residue.__code__.co_consts if hasattr(c, "co_names") for n in c.co_names)


def test_residue_does_not_depend_on_partitions(documents):
    df = documents[0].where("doc_id < 300")
    (w1, t1), (w2, t2) = R.fit(df.repartition(1)), R.fit(df.repartition(16))
    assert t1 == t2 and (w1 == w2).all()
    assert rows(R.residue(df.repartition(1), (w1, t1))) == rows(R.residue(df.repartition(16), (w1, t1)))


def test_missing_and_null_titles_and_sources(spark, documents):
    model = R.fit(documents[0])
    df = spark.createDataFrame([(1, "Lorem ipsum dolor sit amet.", None, None), (2, "Dummy text", "Dummy text", None)], "doc_id int, text string, paper_title string, source string")
    assert {r["doc_id"] for r in R.residue(df.select("doc_id", "text"), model).collect()} >= {1} and {r["doc_id"] for r in R.residue(df, model).collect()} >= {1}


def test_residue_of_an_empty_table(spark):
    assert rows(R.residue(spark.createDataFrame([], "doc_id long, text string, source string"))) == []


def test_segments_cover_the_text():
    s = R.Segments(["One. Two!\nthree", "", "x"], [None, "t", ""])
    assert [s.text(i) for i in range(s.count)] == ["One.", "Two!", "three", "x"] and list(s.text_index) == [0, 0, 0, 2]
    assert R.Segments([" ", ""], [None, None]).count == 0


def test_windows_cover_every_token_of_any_segment():
    long = " ".join(f"w{i}" for i in range(5_003))
    s = R.Segments([long, "a b c"], ["w", None])
    seen = np.zeros(len(s.starts), bool)
    for a, b in zip(s.a, s.b):
        assert 0 < b - a <= R.SIZE
        seen[a:b] = True
    assert seen.all() and s.count == 2
    w = np.random.default_rng(0).normal(size=(R.BUCKETS, 5)).astype(np.float32)
    w[0] = 0
    z = s.scores(w)
    assert np.allclose(z, [w[s.features(i)].sum(0) for i in range(len(z))], atol=1e-3)


def test_a_label_is_found_anywhere_in_a_long_segment():
    s = R.Segments(["word " * 3_000 + "{{ author list }} " + "word " * 3_000], [None])
    kind, _, hit = s.labels()
    assert hit[0] and (kind > 0).sum() in (1, 2) and (kind == 0).sum() == 0


def test_training_learns_and_is_repeatable():
    rng = np.random.default_rng(0)
    data = [(int(c), np.array([c * 10 + int(rng.integers(1, 5)), 99])) for c in rng.integers(0, 5, 400)]
    w = R.train(data)
    assert np.mean([np.argmax(w[f].sum(0) + R.BIAS) == y for y, f in data]) > 0.99 and (w == R.train(data)).all()
    assert not w[7].any() and not R.train([(0, np.array([1, 2]))]).any() and not R.train([]).any()


def test_training_sees_every_document(spark):
    word = "concat('w', translate(cast(id AS string), '0123456789', 'abcdefghij'))"
    text = f"CASE WHEN id % 1500 = 7 THEN concat('Lorem ipsum ', {word}, ' dolor.') ELSE 'Cells grow.' END"
    df = spark.range(60_000).selectExpr("id AS doc_id", f"{text} AS text", "concat('host', id % 23) AS source")
    w, _ = R.fit(df)
    held_out = {r["source"] for r in df.select("source").distinct().where(R.F.crc32(R.F.encode("source", "utf-8")) % R.UNSEEN == 0).collect()}
    own = [r["text"].split()[2] for r in df.where("doc_id % 1500 = 7").collect() if r["source"] not in held_out]
    s = R.Segments(own, [None] * len(own))
    assert len(own) > 20 and w[s.grams[:, 0]].any(1).all()


def test_thresholds_count_all_windows_of_unseen_hosts(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 0 THEN 'Lorem ipsum dolor.' ELSE 'Cells grow. Mice do.' END AS text")
    judged = R._judged(R._rows(df), np.zeros((R.BUCKETS, len(R.KINDS)), np.float32))
    assert judged.sum((0, 2, 3)).tolist() == [2 * 29_700, 0, 300, 0, 0]


def test_shards_give_the_same_whatever_the_partitions(documents, monkeypatch):
    monkeypatch.setattr(R, "SHARD", 100_000)
    df, want = documents
    (w1, t1), (w2, t2) = R.fit(df.repartition(1)), R.fit(df.repartition(16))
    assert t1 == t2 and (w1 == w2).all()
    assert {r["doc_id"]: r["residue"] for r in R.residue(df, (w1, t1)).collect()} == want
