import random
import re
from dataclasses import replace

import numpy as np

from corpuscope.llm import lm
from corpuscope.llm.lm import Trainer, decisions, flat, forward, huffman, lm_scores, shaped, start_weights, train, vocabulary
from corpuscope.llm.words import ALNUM, documents_words
import pyarrow as pa


def documents(seed, n=120):
    """Words come in fixed pairs, so both sides tell what stands between."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(5, 60)):
            k = rng.randrange(12)
            own += [f"a{k}", f"b{k}", f"c{k}"]
        rows.append((i, " ".join(own)))
    return rows


def brute(model, text):
    """Word by word."""
    out = list(documents_words(pa.array([text]), ALNUM))
    hashes = out[0][1] if out else []
    e, b, u, c = (w.astype(np.float64) for w in model.weights)
    tokens = [int(model.tokens(np.array([h], np.uint64))[0]) for h in hashes]
    classes = [int(model.class_of[t]) for t in tokens]
    total = 0.0
    for i, t in enumerate(tokens):
        sum_ = b.copy()
        for k, shift in enumerate([-2, -1, 1, 2]):
            j = i + shift
            sum_ = sum_ + e[k][classes[j] if 0 <= j < len(classes) else e.shape[1] - 1]
        logits = np.tanh(sum_) @ u + c
        total += logits[classes[i]] - np.log(np.exp(logits).sum()) + model.inside[t]
    return len(tokens), total


def test_scores_equal_brute_force(spark):
    rows = documents(1) + [(900, None), (901, ""), (902, "!?"), (903, "unseen words"), (904, "A0 b0"), (0, documents(1)[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = train(df, vocabulary(df, size=20))
    got = lm_scores(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        n, total = brute(model, dict(rows)[r.doc_id] or "")
        assert r.n_words == n and np.isclose(r.log_probability, total, atol=1e-3 * max(1, n))
        assert np.isclose(r.per_word, total / n if n else 0.0, atol=1e-3)


def test_training_learns_from_both_sides(spark):
    df = spark.createDataFrame(documents(2, 400), "doc_id bigint, text string").repartition(2)
    new = spark.createDataFrame(documents(3, 60), "doc_id bigint, text string")
    start = vocabulary(df)
    before = lm_scores(new, start).agg({"per_word": "avg"}).first()[0]
    model = start
    for _ in range(3):
        model = train(df, model)
    after = lm_scores(new, model).agg({"per_word": "avg"}).first()[0]
    assert after > before + 0.3
    shuffled = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in documents(3, 60)], new.schema)
    assert lm_scores(shuffled, model).agg({"per_word": "avg"}).first()[0] < after - 0.2


def test_probabilities_add_up(spark):
    df = spark.createDataFrame(documents(4, 30), "doc_id bigint, text string")
    model = vocabulary(df, size=10)
    for c in range(len(model.weights[3])):
        own = model.class_of == c
        words_, rare = len(model.words), own[len(model.words):]
        # Each token's share of its class; a bucket's is spread over its words and one unseen.
        each = np.exp(model.inside[own])
        assert (each > 0).all() and each[:int(own[:words_].sum())].sum() <= 1 + 1e-9 and rare.size


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(5)
    weights = start_weights(6, np.full(6, 1 / 6), 2, 8)
    around, classes = rng.integers(0, 7, (4, 500)), None
    classes = around[1] % 6
    trainer = Trainer(weights)

    def loss():
        from corpuscope.llm.lm import forward
        _, z = forward(trainer.weights, around)
        return -np.mean(z[np.arange(500), classes] - np.log(np.exp(z).sum(axis=1)))

    first = loss()
    for _ in range(60):
        trainer.step(around, classes)
    assert loss() < 0.3 * first
    again = shaped(flat(trainer.weights), weights)
    assert all(np.allclose(a, b) for a, b in zip(again, trainer.weights))


def test_names_and_empty(spark):
    kind = "doc_id bigint, text string, per_word int, row string"
    df = spark.createDataFrame([(1, "a b a", 1, "r")], kind)
    model = train(df, vocabulary(df))
    got = lm_scores(df, model)
    assert got.columns == ["doc_id", "per_word", "row", "n_words", "log_probability", "_per_word"] and got.first()._per_word < 0
    empty = df.limit(0)
    assert lm_scores(empty, train(empty, vocabulary(empty))).count() == 0


def test_words_of_a_bucket_have_their_own_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 2)
    monkeypatch.setattr(lm, "BUCKET_BITS", 1)
    names = [f"w{k}" for k in range(20)]
    halves = [int(list(documents_words(pa.array([w]), ALNUM))[0][1][0] >> np.uint64(63)) for w in names]
    often, seldom, once, unseen = [w for w, h in zip(names, halves) if h == 0][:4]
    text = " ".join(["the", "of"] * 90 + [often] * 40 + [seldom] * 3 + [once])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text.split() * 2)], "doc_id bigint, text string").repartition(3)
    model = train(df, vocabulary(df))
    asked = spark.createDataFrame([("o", often), ("s", seldom), ("1", once), ("u", unseen), ("o", often), ("m", f"{often} {seldom} {often}")],
                                  "doc_id string, text string")
    rows = lm_scores(asked, model).collect()
    got = {r.doc_id: r.log_probability for r in rows}
    assert len(rows) == 6 and all(np.isclose(r.log_probability, got["o"]) for r in rows if r.doc_id == "o")
    assert np.isclose(got["o"] - got["s"], np.log(80 / 6)) and np.isclose(got["s"] - got["1"], np.log(6 / 2))
    assert np.isclose(got["1"] - got["u"], np.log(2))
    again = lm_scores(asked.where("doc_id = 'm'"), vocabulary(df, size=2)).first().log_probability
    assert np.isfinite(again) and np.isfinite(got["m"])


def brute_words(model, text):
    """Word by word over tokens: class, then each decision on the way to the token."""
    hashes = list(documents_words(pa.array([text]), ALNUM))[0][1]
    e, b, u, c, v, d = (w.astype(np.float64) for w in model.weights)
    tokens = [int(t) for t in model.tokens(hashes)]
    total = 0.0
    for i, t in enumerate(tokens):
        around = [tokens[i + s] if 0 <= i + s < len(tokens) else e.shape[1] - 1 for s in (-2, -1, 1, 2)]
        hidden = np.tanh(b + sum(e[k][j] for k, j in enumerate(around)))
        logits = hidden @ u + c
        total += logits[model.class_of[t]] - np.log(np.exp(logits).sum()) + model.inside[t]
        for level in range(model.tree.lengths[t]):
            node = model.tree.nodes[level, t]
            total -= np.log(1 + np.exp(model.tree.signs[level, t] * (hidden @ v[node] + d[node])))
    return total


def test_words_of_one_class_are_told_apart_by_their_neighbours(spark):
    """200 pairs, all equally frequent: which word follows which is all there is to learn."""
    rng = random.Random(6)
    text = [(i, " ".join(f"x{k} y{k}" for k in rng.choices(range(200), k=40))) for i in range(1500)]
    df = spark.createDataFrame(text, "doc_id bigint, text string").repartition(2)
    start = vocabulary(df)
    model = start
    for _ in range(3):
        model = train(df, model)
    right = [(i, " ".join(f"x{k} y{k}" for k in rng.choices(range(200), k=40))) for i in range(50)]
    wrong = [(i, " ".join(f"x{k} y{(k + 77) % 200}" for k in rng.choices(range(200), k=40))) for i in range(50)]
    mean = [lm_scores(spark.createDataFrame(rows, df.schema), m).agg({"per_word": "avg"}).first()[0] for rows, m in
            ((right, start), (wrong, start), (right, model), (wrong, model))]
    assert abs(mean[0] - mean[1]) < 0.1 and mean[2] > mean[0] + 0.5 and mean[2] > mean[3] + 0.5
    hashes = np.concatenate([h for _, h, _ in documents_words(pa.array([t for _, t in right]), ALNUM)])
    assert model.tokens(hashes).max() < len(model.words)
    got = lm_scores(spark.createDataFrame(right[:3], df.schema), replace(model, lexicon=None)).collect()
    assert all(np.isclose(r.log_probability, brute_words(model, right[r.doc_id][1]), atol=0.05) for r in got)


def test_tokens_add_up_in_any_surroundings(spark):
    df = spark.createDataFrame(documents(7, 60), "doc_id bigint, text string")
    model = train(df, vocabulary(df))
    tokens = np.arange(len(model.class_of))
    around = np.repeat(np.array([[3], [0], [5], [len(tokens)]]), len(tokens), axis=1)
    hidden, logits = forward(model.weights, around)
    classes = np.exp(logits[0]) / np.exp(logits[0]).sum()
    p = classes[model.class_of].astype(np.float64)
    order = model.tree.longest_first(tokens)
    for n, node, sign in model.tree.levels(tokens[order]):
        p[order[:n]] /= 1 + np.exp(sign * decisions(model.weights, hidden[:n], node)[0])
    assert np.isclose(p.sum(), 1, atol=1e-4)


def test_gradients_of_decisions():
    """The change of the embeddings follows the slope of the loss."""
    rng = np.random.default_rng(8)
    mass = rng.integers(1, 50, 40).astype(float)
    class_of = np.arange(40) % 4
    tree, odds = huffman(mass, class_of, 4)
    weights = start_weights(4, np.full(4, 0.25), 2, 6, tokens=40, odds=odds)
    weights = (*weights[:4], rng.normal(0, 0.5, weights[4].shape).astype(np.float32), odds)
    around, tokens = rng.integers(0, 41, (4, 64)), rng.integers(0, 40, 64)

    def loss(w):
        hidden, logits = forward([x.astype(np.float64) for x in w], around)
        total = np.log(np.exp(logits).sum(axis=1)).sum() - logits[np.arange(64), class_of[tokens]].sum()
        order = tree.longest_first(tokens)
        for n, node, sign in tree.levels(tokens[order]):
            total += np.log(1 + np.exp(sign * decisions([x.astype(np.float64) for x in w], hidden[order][:n], node)[0])).sum()
        return total

    trainer = Trainer(weights, tree)
    trainer.step(around, class_of[tokens], tokens)
    trainer.finish()
    for i, at in ((0, (1, int(around[1, 0]), 2)), (4, (int(tree.nodes[0, tokens[0]]), 1)), (5, (int(tree.nodes[0, tokens[0]]),))):
        moved = [w.astype(np.float64) for w in weights]
        moved[i][at] += 1e-5
        slope = (loss(moved) - loss(weights)) / 1e-5
        step = trainer.weights[i][at] - weights[i][at]
        assert np.isclose(step, -lm.RATE * slope / np.sqrt(1 + slope * slope), rtol=2e-2, atol=1e-4)
