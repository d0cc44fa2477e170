"""Masked pseudo-likelihood: a small window network, trained in numpy on all documents, predicts each word from both sides."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import ALNUM, documents_words
from corpuscope.session import staged

# Frequent words with a token of their own, and buckets for the others; these have their counts in the lexicon.
VOCABULARY = 16384
BUCKET_BITS = 10
# Classes of tokens that the network predicts first; words on either side that it sees; its hidden units.
CLASSES = 32
SIDE = 2
HIDDEN = 16
# Words of a training step, and rounds; each round trains on another part of the documents.
STEP = 4096
ROUNDS = 2
# Steps between two changes of the embeddings of tokens.
PAUSE = 8
RATE = 0.3
# Words that a task of a round trains on at most, about; weights that are averaged together.
TASK_WORDS = 1 << 25
SLICE = 1 << 14
# Words counted together before they leave a task.
CHUNK = 1 << 21


@dataclass(frozen=True)
class Tree:
    """Decisions that lead from a class to a token: of token ``t`` the first ``lengths[t]`` rows of column ``t``; yes is -1, no 1."""

    lengths: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray

    def longest_first(self, tokens: np.ndarray) -> np.ndarray:
        return np.argsort(-self.lengths[tokens].astype(np.int16), kind="stable")

    def levels(self, tokens: np.ndarray):
        """Decisions of tokens in the order of :meth:`longest_first`, row by row: (how many tokens have it, nodes, signs)."""
        lengths = -self.lengths[tokens]
        for level in range(-lengths.min(initial=0)):
            n = int(np.searchsorted(lengths, -level))
            yield n, np.take(self.nodes[level], tokens[:n]), np.take(self.signs[level], tokens[:n])


@dataclass(frozen=True)
class WindowModel:
    """Tokens, classes and weights.

    With a ``tree``: P(word | both sides) = P(class | sides) * P(token | class, sides) * P(word | token). The sides are the
    tokens of the SIDE words before and after, in ``h = tanh(sum of one embedding per place and token + b)``; the first factor
    is ``softmax(h @ u + c)``, the second the product of ``sigmoid(h @ v[node] + d[node])`` (or one minus it) along the path of
    the token, the third is 1 but for buckets, whose words have the shares that counts give them. Without a tree the sides are
    the classes of these words, and P(word | class) comes from counts. With a ``lexicon`` (word, n) of all words counted more
    than once, ``inside`` of a bucket is the share of a word counted once, and :func:`lm_scores` adds the logarithms of the
    counts by a join.
    """

    words: np.ndarray
    token_of: np.ndarray
    class_of: np.ndarray
    inside: np.ndarray
    weights: tuple
    side: int = SIDE
    lexicon: DataFrame | None = None
    tree: Tree | None = None
    counted: int = 0

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each word hash."""
        n = len(self.words)
        rare = n + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if not n:
            return rare
        spot = np.minimum(np.searchsorted(self.words, hashes), n - 1)
        return np.where(self.words[spot] == hashes, self.token_of[spot], rare)

    def contexts(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What the network sees at each place around each word; the last number stands for beyond the document."""
        seen = tokens if self.tree else self.class_of[tokens]
        beyond = self.weights[0].shape[1] - 1
        lengths = np.diff(bounds)
        begins, ends = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
        out = np.full((2 * self.side, len(seen)), beyond, np.int64)
        spots = np.arange(len(seen))
        for k, shift in enumerate([s for s in range(-self.side, self.side + 1) if s]):
            at = spots + shift
            real = (at >= begins) & (at < ends)
            out[k, real] = seen[at[real]]
        return out

    def log_probabilities(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each word given both sides."""
        tokens = self.tokens(hashes)
        classes = self.class_of[tokens]
        around = self.contexts(tokens, bounds)
        out = self.inside[tokens].astype(np.float64)
        for i in range(0, len(hashes), STEP):
            hidden, logits = forward(self.weights, around[:, i:i + STEP])
            logits -= logits.max(axis=1, keepdims=True)
            right = logits[np.arange(len(logits)), classes[i:i + STEP]]
            out[i:i + STEP] += right - np.log(np.exp(logits) @ np.ones(logits.shape[1], logits.dtype))
            if self.tree:
                order = self.tree.longest_first(tokens[i:i + STEP])
                hidden, cost = np.take(hidden, order, axis=0), np.zeros(len(order))
                for n, node, sign in self.tree.levels(tokens[i:i + STEP][order]):
                    z = decisions(self.weights, hidden[:n], node)[0]
                    z *= sign
                    cost[:n] += np.maximum(z, 0)
                    cost[:n] += np.log(1 + np.exp(-np.abs(z)))
                out[i + order] -= cost
        return out


def forward(weights, around):
    """Hidden units and class scores for contexts (places x words)."""
    e, b, u, c = weights[:4]
    total = np.take(e[0], around[0], axis=0)
    for k in range(1, len(around)):
        total += np.take(e[k], around[k], axis=0)
    total += b
    hidden = np.tanh(total, out=total)
    logits = hidden @ u
    logits += c
    return hidden, logits


def decisions(weights, hidden, node):
    """Scores of decisions, each of a row of ``hidden`` at a node, and the weights of the nodes."""
    v, d = weights[4:]
    own = np.take(v, node, axis=0)
    return np.einsum("ij,ij->i", own, hidden) + np.take(d, node), own


def huffman(mass: np.ndarray, class_of: np.ndarray, classes: int) -> tuple[Tree, np.ndarray]:
    """A Huffman tree in each class, and per node the logarithm of how much likelier its answer 1 is by the masses."""
    above, answer, odds = {}, {}, []
    for k in range(classes):
        own = np.flatnonzero(class_of == k)
        # Leaves are numbered -1 - token.
        heap = [(float(mass[t]), -1 - int(t)) for t in own]
        heapq.heapify(heap)
        while len(heap) > 1:
            (small, no), (large, yes) = heapq.heappop(heap), heapq.heappop(heap)
            for child, bit in ((no, False), (yes, True)):
                above[child], answer[child] = len(odds), bit
            heapq.heappush(heap, (small + large, len(odds)))
            odds.append(np.log(large / small))
    paths = []
    for t in range(len(mass)):
        at, path = -1 - t, []
        while at in above:
            path.append((above[at], answer[at]))
            at = above[at]
        paths.append(path)
    lengths = np.array([len(path) for path in paths], np.int64)
    nodes, signs = np.zeros((lengths.max(initial=0), len(mass)), np.int64), np.ones((lengths.max(initial=0), len(mass)), np.float32)
    for t, path in enumerate(paths):
        for level, (node, yes) in enumerate(path):
            nodes[level, t], signs[level, t] = node, -1 if yes else 1
    return Tree(lengths, nodes, signs), np.array(odds, np.float32)


def start_weights(classes: int, shares: np.ndarray, side: int = SIDE, hidden: int = HIDDEN, seed: int = 11, tokens: int | None = None,
                  odds: np.ndarray | None = None) -> tuple:
    """Small random embeddings (of ``tokens``, or of the classes); the output starts at the shares of classes and branches."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (2 * side, (classes if tokens is None else tokens) + 1, hidden)).astype(np.float32)
    u = rng.normal(0, 0.1, (hidden, classes)).astype(np.float32)
    dense = e, np.zeros(hidden, np.float32), u, np.log(np.maximum(shares, 1e-9)).astype(np.float32)
    return dense if odds is None else (*dense, np.zeros((len(odds), hidden), np.float32), odds)


def flat(weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def shaped(values: np.ndarray, like) -> tuple:
    out, at = [], 0
    for w in like:
        out.append(values[at:at + w.size].reshape(w.shape).astype(np.float32))
        at += w.size
    return tuple(out)


def _sums(keys: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    """Sums of each of ``columns`` by key, for all keys below ``size``."""
    return np.array([np.bincount(keys, column, size) for column in columns], np.float32)


class Trainer:
    """Adagrad steps on the cross-entropy of the classes and, with a tree, of the decisions behind them.

    Embeddings of tokens and weights of nodes take the sum of the gradients of PAUSE steps, all else the mean of each.
    """

    def __init__(self, weights, tree: Tree | None = None):
        self.weights = [w.copy() for w in weights]
        self.tree = tree
        self.squares = [np.full(w.shape, 1e-2, np.float32) for w in weights]
        if tree:
            # Of embeddings and nodes the other way round, as their sums are made.
            for i in (0, 4, 5):
                self.squares[i] = np.ones(weights[i].swapaxes(-1, -2).shape if i < 5 else weights[i].shape, np.float32)
            self.waiting, self.decided = [], []

    def _change(self, i: int, g: np.ndarray) -> None:
        self.squares[i] += g * g
        g /= np.sqrt(self.squares[i])
        g *= RATE
        self.weights[i] -= g.swapaxes(-1, -2 if i in (0, 4) else -1)

    def _words(self, around, classes, tokens) -> None:
        n, u = len(classes), self.weights[2]
        hidden, logits = forward(self.weights, around)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits, out=logits)
        p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
        p[np.arange(n), classes] -= 1.0
        back = p @ u.T
        seen = np.ascontiguousarray(hidden.T)
        for k, node, sign in self.tree.levels(tokens):
            z, own = decisions(self.weights, hidden[:k], node)
            z *= -sign
            with np.errstate(over="ignore"):
                wrong = sign / (1 + np.exp(z))
            own *= wrong[:, None]
            back[:k] += own
            self.decided.append((node, wrong, seen[:, :k] * wrong))
        back *= 1 - hidden * hidden
        each = np.full(n, 1 / n, np.float32)
        for i, g in ((1, each @ back), (2, hidden.T @ p / n), (3, each @ p)):
            self._change(i, g)
        self.waiting.append((around, back))
        if len(self.waiting) == PAUSE:
            self.finish()

    def finish(self) -> None:
        """Change the embeddings of tokens and the nodes by what waits."""
        if self.tree and self.waiting:
            around, back = np.concatenate([a for a, _ in self.waiting], axis=1), np.concatenate([b for _, b in self.waiting])
            columns = np.ascontiguousarray(back.T)
            self._change(0, np.array([_sums(place, columns, self.weights[0].shape[1]) for place in around]))
        if self.tree and self.decided:
            node, wrong, products = (np.concatenate(x, axis=-1) for x in zip(*self.decided))
            nodes = len(self.weights[5])
            self._change(4, _sums(node, products, nodes))
            self._change(5, np.bincount(node, wrong, nodes).astype(np.float32))
        self.waiting, self.decided = [], []

    def step(self, around: np.ndarray, classes: np.ndarray, tokens: np.ndarray | None = None) -> None:
        """One step over words with their classes and, with a tree, their tokens."""
        if self.tree:
            order = self.tree.longest_first(tokens)
            self._words(around[:, order], classes[order], tokens[order])
            return
        e, _, u, _ = self.weights
        n, kinds = len(classes), e.shape[1]
        hidden, logits = forward(self.weights, around)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), classes] -= 1.0
        p /= n
        back = (p @ u.T) * (1 - hidden * hidden)
        grad_e = np.empty_like(e)
        names = np.arange(kinds)[:, None]
        for k in range(len(around)):
            grad_e[k] = (around[k][None, :] == names).astype(np.float32) @ back
        for w, s, g in zip(self.weights, self.squares, (grad_e, back.sum(axis=0), hidden.T @ p, p.sum(axis=0))):
            s += g * g
            w -= RATE * g / np.sqrt(s)


def _count(batches):
    """Arrow function: different words with their numbers, chunk by chunk."""
    held, size = [], 0

    def out():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for _, hashes, _ in documents_words(batch.column("text"), ALNUM):
            held.append(hashes)
            size += len(hashes)
            if size >= CHUNK:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def vocabulary(docs: DataFrame, text_col: str = "text", size: int | None = None, classes: int = CLASSES, side: int = SIDE) -> WindowModel:
    """Tokens and classes from the counts of all words of all documents; weights at their start.

    The VOCABULARY most frequent words have tokens of their own, which the network sees and predicts; all others share the
    token of their hash bucket, and each is as likely in it as its own count says: the table of counts is the model's lexicon.
    With a ``size`` that many words have tokens, the network sees and predicts classes only, and there is no lexicon, so that
    each different word of a bucket is as likely as the next. Only the counts of words with tokens and one pair of numbers
    per bucket reach the driver.
    """
    whole = size is None
    size = VOCABULARY if whole else size
    counts = staged(docs.select(col(text_col).alias("text")).mapInArrow(_count, "word bigint, n bigint")
                    .groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()
    bucket = F.shiftrightunsigned("word", 64 - BUCKET_BITS)
    buckets = counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toArrow()
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.float64)
    in_bucket, kinds = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    in_bucket[buckets["bucket"].to_numpy()] = buckets["n"].to_numpy()
    kinds[buckets["bucket"].to_numpy()] = buckets["kinds"].to_numpy()
    own = (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    np.subtract.at(in_bucket, own, n)
    np.subtract.at(kinds, own, 1)
    # A bucket holds one word that was never seen, so that new texts can be scored.
    mass = np.concatenate([n, in_bucket + 1.0])
    order = np.argsort(-mass, kind="stable")
    alone = min(classes // 2, len(mass))
    rest = np.cumsum(mass[order[alone:]])
    spread = alone + np.minimum((rest / max(rest[-1], 1e-9) * (classes - alone)).astype(np.int64), classes - alone - 1) if len(rest) else rest.astype(np.int64)
    class_of = np.empty(len(mass), np.int64)
    class_of[order] = np.concatenate([np.arange(alone), spread])
    total = np.bincount(class_of, weights=mass, minlength=classes)
    by_hash = np.argsort(words)
    shares, counted = (total + 1.0) / (total.sum() + classes), int(mass.sum())
    if not whole:
        each = np.concatenate([n, (in_bucket + 1.0) / (kinds + 1.0)])
        return WindowModel(words[by_hash], by_hash, class_of, np.log(each / total[class_of]), start_weights(classes, shares, side), side,
                           counted=counted)
    tree, odds = huffman(mass, class_of, classes)
    inside = np.concatenate([np.zeros(len(n)), -np.log(in_bucket + 1.0)])
    weights = start_weights(classes, shares, side, tokens=len(mass), odds=odds)
    return WindowModel(words[by_hash], by_hash, class_of, inside, weights, side, counts.where("n > 1"), tree, counted)


def _train(model: WindowModel):
    """Arrow function: weights, in slices, after one pass over the partition's documents, and the number of their words."""

    def run(batches):
        trainer, seen = Trainer(model.weights, model.tree), 0
        left_around, left_tokens = [], []
        size = 0
        for batch in batches:
            for _, hashes, bounds in documents_words(batch.column("text"), ALNUM):
                tokens = model.tokens(hashes)
                left_around.append(model.contexts(tokens, bounds))
                left_tokens.append(tokens)
                size += len(tokens)
                seen += len(tokens)
                if size >= 16 * STEP:
                    around, wanted = np.concatenate(left_around, axis=1), np.concatenate(left_tokens)
                    cut = size // STEP * STEP
                    # Words of a step come from all over the run of documents.
                    mixed = np.random.default_rng(seen).permutation(size)
                    for i in range(0, cut, STEP):
                        pick = mixed[i:i + STEP]
                        trainer.step(around[:, pick], model.class_of[wanted[pick]], wanted[pick])
                    rest = mixed[cut:]
                    left_around, left_tokens, size = [around[:, rest]], [wanted[rest]], size - cut
        if size:
            wanted = np.concatenate(left_tokens)
            trainer.step(np.concatenate(left_around, axis=1), model.class_of[wanted], wanted)
        trainer.finish()
        if seen:
            values = flat(trainer.weights)
            ends = np.append(np.arange(0, len(values), SLICE), len(values)).astype(np.int32)
            yield pa.record_batch([pa.array(np.arange(len(ends) - 1)), pa.array(np.full(len(ends) - 1, seen)),
                                   pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["slice", "n", "weights"])

    return run


def _average(own: pa.Table) -> pa.Table:
    """Mean of the same slice of several tasks' weights, by the words that each has seen."""
    n = own.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((own.column("weights").combine_chunks().flatten().to_numpy().reshape(len(n), -1)[:, 0], n))
    values = own.column("weights").combine_chunks().flatten().to_numpy().reshape(len(n), -1)[order]
    mean = n[order] @ values.astype(np.float64) / n.sum()
    return pa.table({"slice": own.column("slice")[:1], "weights": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def train(docs: DataFrame, model: WindowModel, text_col: str = "text", rounds: int = ROUNDS) -> WindowModel:
    """Train over every document once, in ``rounds`` parts by a hash of the text.

    In a round each task starts from the same weights and makes steps over its documents; the weights are then
    averaged slice by slice, weighted by the words seen, so the driver gets as many numbers as the network has weights,
    whatever the number of tasks. There is a task for each core, or more where one would see more than about TASK_WORDS words.
    """
    spark = docs.sparkSession
    texts = docs.select(col(text_col).alias("text")).where("text is not null")
    tasks = max(spark.sparkContext.defaultParallelism, -(-model.counted // (rounds * TASK_WORDS)))
    for part in range(rounds):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part).coalesce(tasks)
        got = own.mapInArrow(_train(replace(model, lexicon=None)), "slice bigint, n bigint, weights array<float>")
        means = got.groupBy("slice").applyInArrow(_average, "slice bigint, weights array<float>").toArrow()
        if len(means):
            order = np.argsort(means["slice"].to_numpy())
            lists = means["weights"].combine_chunks()
            values = np.concatenate([lists[int(i)].values.to_numpy() for i in order])
            model = replace(model, weights=shaped(values, model.weights))
    return model


def _tail(model: WindowModel, hashes: np.ndarray, bounds: np.ndarray):
    """Different words without a token of their own by document: (words, times, cuts)."""
    at = np.flatnonzero(model.tokens(hashes) >= len(model.words))
    document, words = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at], hashes[at]
    order = np.lexsort((words, document))
    document, words = document[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (document[1:] != document[:-1]) | (words[1:] != words[:-1])
    starts = np.flatnonzero(new)
    return words[starts].view(np.int64), np.diff(np.append(starts, len(words))), np.searchsorted(document[starts], np.arange(len(bounds)))


def _score(model: WindowModel):
    def run(batches):
        # Numbers of rows, as monotonically_increasing_id gives them.
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            words, times, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            for first, hashes, bounds in documents_words(batch.column("text"), ALNUM):
                rows = slice(first, first + len(bounds) - 1)
                n[rows] = np.diff(bounds)
                sums = np.concatenate([[0.0], np.cumsum(model.log_probabilities(hashes, bounds))])
                total[rows] = sums[bounds[1:]] - sums[bounds[:-1]]
                own, k, cuts = _tail(model, hashes, bounds)
                words.append(own)
                times.append(k)
                sizes[rows] = np.diff(cuts)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            tail = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in (words, times)]
            yield pa.record_batch([batch.column("row"), pa.array(row + np.arange(batch.num_rows)), pa.array(n), pa.array(total), *tail],
                                  names=["row", "key", "n_words", "log_probability", "words", "times"])
            row += batch.num_rows

    return run


def lm_scores(docs: DataFrame, model: WindowModel, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, log_probability (sum over the words) and per_word (mean) added.

    Taken names get underscores in front. Null, empty and wordless texts have no words, a sum of 0 and a mean of 0.
    Each row is scored by itself, whole; with an untrained model the words are as likely as their counts say.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    packed = docs.select(row.alias("row"), col(text_col).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    scored = packed.mapInArrow(_score(replace(model, lexicon=None)),
                               f"row {kind}, key bigint, n_words bigint, log_probability double, words array<bigint>, times array<bigint>")
    if model.lexicon is not None:
        scored = staged(scored, "scored")
        tail = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("one")).select(
            "key", F.col("one.words").alias("word"), F.col("one.times").alias("times"))
        added = tail.join(model.lexicon, "word").groupBy("key").agg(F.sum(F.col("times") * F.log("n")).alias("added"))
        scored = scored.join(added, "key", "left").withColumn(
            "log_probability", F.col("log_probability") + F.coalesce("added", F.lit(0.0)))
    mean = F.coalesce(F.col("log_probability") / F.nullif("n_words", F.lit(0)), F.lit(0.0))
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in others], F.col("n_words").alias(fresh(docs, "n_words")),
        F.col("log_probability").alias(fresh(docs, "log_probability")), mean.alias(fresh(docs, "per_word")))
