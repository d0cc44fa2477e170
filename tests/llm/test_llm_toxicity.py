import os
import zlib

import numpy as np
import pytest

from corpuscope.llm.toxicity import Lexicon, calibrated, fold, learn_lexicon, toxicity_scores, words_of
from tests.llm.test_llm_quality import SF, auc


def matches(lexicon, text):
    return lexicon.matches(lexicon.automaton(), words_of(text))


def test_fold():
    assert fold("1D10T") == "idiot" and fold("іdiоt") == "idiot" and fold("st\u200bupid") == "stupid"
    assert fold("Ｉｄｉｏｔ") == "idiot" and fold("m0r0n!") == "moron!"
    assert fold("in 2021, 17 cats") == "in 2021, 17 cats" and fold("Réel") == "réel"


def test_matches_and_exceptions():
    lexicon = Lexicon({"idiot": 2.0, "stu*": 1.0, "trash": 1.5}, ("trash can", "student"))
    assert matches(lexicon, "You IDIOT, idiot idiots") == ["idiot", "idiot"]
    assert matches(lexicon, "stupid Stuff restud student") == ["stu*", "stu*"]
    assert matches(lexicon, "a trash can, trash day") == ["trash"]
    assert matches(lexicon, "1d10t tr4sh") == ["idiot", "trash"]
    assert matches(lexicon, "") == [] and matches(Lexicon({}), "idiot") == []


def brute(lexicon, text):
    words, n = words_of(text), 0
    spared = set()
    for e in lexicon.exceptions:
        own = e.split(" ")
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                spared.update(range(i, i + len(own)))
    for i, w in enumerate(words):
        if i not in spared and any(w.startswith(e[:-1]) if e.endswith("*") else w == e for e in lexicon.entries):
            n += 1
    return n


def test_matches_equal_brute_force():
    rng = np.random.default_rng(3)
    lexicon = Lexicon({"aa": 1.0, "ab*": 1.0, "b": 2.0, "bb*": 1.0}, ("aa b", "abc", "b bb aa"))
    for _ in range(400):
        text = " ".join(rng.choice(["aa", "ab", "abc", "abcd", "b", "bb", "bba", "c"], rng.integers(0, 12)))
        assert len(matches(lexicon, text)) == brute(lexicon, text), text


def test_scores_and_names(spark):
    lexicon = Lexicon({"idiot": 2.0})
    kind = "doc_id bigint, text string, score string, row int, n_words int"
    df = spark.createDataFrame([(1, "idiot", "s", 1, 1), (2, None, "s", 2, 2), (3, "", "s", 3, 3), (4, "fine " * 2000 + "idiot", "s", 4, 4),
                                (1, "idiot", "s", 1, 1)], kind)
    got = toxicity_scores(df, lexicon)
    assert got.columns == ["doc_id", "score", "row", "n_words", "_score", "weight", "n_matches", "_n_words"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1]._score > by[4]._score > by[2]._score == by[3]._score and by[4]._n_words == 2001 and by[1].n_matches == 1
    assert got.count() == 5 and toxicity_scores(df.limit(0), lexicon).count() == 0


def test_calibration_orders_densities():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 500).astype(float)
    lengths = rng.integers(5, 500, 500)
    total = y * rng.integers(1, 9, 500)
    lexicon = calibrated(Lexicon({"x": 1.0}), total, lengths, y)
    s = np.array([lexicon.score(t, n) for t, n in zip(total, lengths)])
    assert (s[y == 1] > 0.5).mean() > 0.9 and (s[y == 0] < 0.3).all()


def test_learned_on_a_fixture(spark):
    rows = []
    for i in range(200):
        words = [f"w{(i * 7 + k) % 50}" for k in range(30)]
        if i % 5 == 0:
            words[3] = "grobian"
        if i % 5 == 1:
            words[4:6] = [f"schurk{i}", f"schurk{i}en"]
        rows.append((i, " ".join(words), int(i % 5 < 2)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = learn_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "grobian" in lexicon.entries and any(e.endswith("*") and "schurk".startswith(e[:-1]) for e in lexicon.entries)
    assert lexicon.entries["grobian"] > 0
    none = learn_lexicon(df.select("doc_id", "text"), df.where("toxic = 0").select("doc_id", "toxic"))
    assert none.entries == {} and none.score(0.0, 10) < 0.3
    assert learn_lexicon(df.limit(0), df.select("doc_id", "toxic")).entries == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = labels.collect()
    lexicon = learn_lexicon(docs, spark.createDataFrame([r for r in rows if not held(r.doc_id)], labels.schema))
    score = {r.doc_id: r.score for r in toxicity_scores(docs.select("doc_id", "text"), lexicon).collect()}
    test = [r for r in rows if held(r.doc_id)]
    s, y = np.array([score[r.doc_id] for r in test]), np.array([r.toxic for r in test])
    assert auc(s, y) > 0.9 and (s[y == 1] >= 0.3).mean() > 0.8 and (s[y == 0] < 0.3).mean() > 0.98


def test_equal_texts_with_both_labels(spark):
    """The label of most rows counts, whatever the partitions."""
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["vile", "scum", "tree", "lake", "road", "bird"]) for _ in range(8)) for _ in range(50)]
    rows = [(k, texts[k % 50], rng.randrange(2)) for k in range(400)]
    learned = []
    for parts in (1, 4, 16):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(parts)
        lexicon = learn_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        learned.append((round(lexicon.bias, 6), {k: round(v, 6) for k, v in lexicon.entries.items()}, lexicon.exceptions))
    assert learned[0] == learned[1] == learned[2]
