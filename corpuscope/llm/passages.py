"""Substring dedup: paragraphs (lines, blocks, runs of words from content-defined places), MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.components import components
from corpuscope.llm.ngram_join import links_in_blocks
from corpuscope.llm.sieve import BITS, bitmap, passes
from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import SPACED, documents_lines, grams, mix
from corpuscope.session import drop_shuffles, release, staged

# Words of a shingle, similarity of two paragraphs, words of a run, and places among which one begins.
SHINGLE = 5
SIMILARITY = 0.8
LENGTH = 20
PLACES = 32
# Share of similar paragraphs that have to collide, and values of a band.
RECALL = 0.98
ROWS = 2
# Entries collected in a task before they are sent off, and about how many a bucket gets.
CHUNK = 1 << 21
BUCKET = 1 << 20

_SEEDS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of ``rows`` values in one of which a share ``recall`` of pairs at ``similarity`` collide."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def anchors(hashes: np.ndarray, ends: np.ndarray, shingles: np.ndarray, places: int, length: int) -> np.ndarray:
    """Where paragraphs begin: at shingles that are the smallest of some ``places`` neighbouring ones.

    A run of ``places + length - 1`` words that two texts share has the same beginnings in both, and from the first of
    them ``length`` words fit into it.
    """
    n = len(shingles)
    windows = n - places + 1
    if windows <= 0:
        return np.zeros(0, np.int64)

    def slide(values, pick):
        width = 1
        while width < places:
            by = min(width, places - width)
            values = pick(values[:len(values) - by], values[by:])
            width += by
        return values

    low = slide(shingles, np.minimum)
    whole = np.arange(windows) + (places + SHINGLE - 1) <= ends[:windows]
    low = np.where(whole, low, np.uint64(0))
    padded = np.zeros(windows + 2 * (places - 1), np.uint64)
    padded[places - 1:places - 1 + windows] = low
    smallest = slide(padded, np.maximum)[:n]
    chosen = smallest == shingles
    chosen[1:] &= shingles[1:] != shingles[:-1]
    spots = np.flatnonzero(chosen)
    return spots[spots + length <= ends[spots]]


LINE, RUN = 0, 1


def paragraphs(batch: pa.RecordBatch, length: int, places: int):
    """Yield the paragraphs of runs of documents: (kind, document keys, first words, numbers of words, shingles, cuts).

    Lines of ``SHINGLE`` words or more; blocks, that is lines between empty ones, where they have several, so that a
    hard-wrapped paragraph is one whole and may be like a line; and runs of ``length`` words from the :func:`anchors` on. The
    shingles of paragraph i are ``shingles[cuts[i]:cuts[i + 1]]``, at least one.
    """
    keys = batch.column("key").to_numpy()
    for first, hashes, bounds, feeds in documents_lines(batch.column("text"), SPACED):
        shingles = grams(hashes, SHINGLE)
        if not len(shingles):
            continue
        counts = np.diff(bounds)
        document = np.repeat(np.arange(len(counts)), counts)
        step = np.full(len(hashes), 2)
        step[1:] = np.where(document[1:] != document[:-1], 2, np.diff(feeds))
        lines, blocks = np.flatnonzero(step > 0), np.flatnonzero(step > 1)
        line_sizes, sizes = np.diff(np.append(lines, len(hashes))), np.diff(np.append(blocks, len(hashes)))
        several = feeds[blocks + sizes - 1] > feeds[blocks]
        begins = np.concatenate([lines, blocks[several]])
        sizes = np.concatenate([line_sizes, sizes[several]])
        begins, sizes = begins[sizes >= SHINGLE], sizes[sizes >= SHINGLE]
        for i in range(0, len(begins), 1 << 14):
            part, n = begins[i:i + (1 << 14)], sizes[i:i + (1 << 14)]
            cuts = np.concatenate([[0], np.cumsum(n - SHINGLE + 1)])
            at = np.arange(cuts[-1]) + np.repeat(part - cuts[:-1], n - SHINGLE + 1)
            yield LINE, keys[first + document[part]], part - bounds[document[part]], n, shingles[at], cuts
        spots = anchors(hashes, np.repeat(bounds[1:], counts), shingles, places, length)
        wide = length - SHINGLE + 1
        for i in range(0, len(spots), 1 << 16):
            part = spots[i:i + (1 << 16)]
            rows = shingles[part[:, None] + np.arange(wide)]
            yield RUN, keys[first + document[part]], part - bounds[document[part]], np.full(len(part), length), rows.ravel(), np.arange(len(part) + 1) * wide


def contents_of(kind: int, shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit number for the shingles of each paragraph in their order; equal paragraphs have equal numbers, never 0."""
    places = np.arange(len(shingles)) - np.repeat(cuts[:-1], np.diff(cuts))
    sums = np.add.reduceat(mix(shingles + mix(places.astype(np.uint64))), cuts[:-1])
    return mix(2 * sums + np.uint64(kind)) | np.uint64(1)


def band_keys(kind: int, shingles: np.ndarray, cuts: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """MinHash keys, paragraphs x bands; lines and runs never collide."""
    out = np.empty((len(cuts) - 1, bands), np.uint64)
    for j in range(bands):
        key = np.full(len(cuts) - 1, 2 * j + kind + 1, np.uint64)
        for i in range(per_band):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shingles * _SEEDS[j * per_band + i], cuts[:-1]))
        out[:, j] = key
    return out


def edges_of_runs(length: int, similarity: float) -> int:
    """Shingles that similar runs of ``length`` words may lack, where these are too few for a word to change inside.

    A word inside a run is in SHINGLE shingles, so runs that lack fewer can only begin or end differently. Else 0.
    """
    wide = length - SHINGLE + 1
    lack = math.floor(wide * (1 - similarity) / (1 + similarity) + 1e-9)
    return lack if lack < min(SHINGLE, wide) else 0


def edge_keys(shingles: np.ndarray, wide: int, lack: int) -> np.ndarray:
    """Keys of the ``lack + 1`` stretches of a run that are ``lack`` shingles shorter: similar runs have one in common."""
    rows = shingles.reshape(-1, wide)
    shifts = mix(np.arange(wide - lack, dtype=np.uint64))
    return np.stack([mix(2 * mix(rows[:, j:j + wide - lack] + shifts).sum(axis=1, dtype=np.uint64)) for j in range(lack + 1)], axis=1)


def _pairs(tokens: np.ndarray, holders: np.ndarray):
    """Different (token, holder) pairs by token: (tokens, holders, starts, lengths)."""
    order = np.lexsort((holders, tokens))
    tokens, holders = tokens[order], holders[order]
    if len(tokens):
        same = np.zeros(len(tokens), bool)
        same[1:] = (tokens[1:] == tokens[:-1]) & (holders[1:] == holders[:-1])
        tokens, holders = tokens[~same], holders[~same]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(new)
    return tokens, holders, starts, np.diff(np.append(starts, len(tokens)))


def _ties(holders, starts, lengths):
    """(first holder of the group, other holder) for all groups."""
    first = np.repeat(holders[starts], lengths)
    other = first != holders
    return first[other], holders[other]


def _send(tokens, band_contents, contents, keys, bits: int) -> pa.RecordBatch:
    """Entries of one chunk, packed by bucket: band keys with contents, and contents with documents.

    Contents of the chunk that collide are tied to the first of them here, and only that one goes on; a content that
    several documents of the chunk have is marked here, and goes on once, with document 0. So what very many
    documents share is one entry per chunk.
    """
    buckets = 1 << bits
    limits = np.arange(buckets, dtype=np.uint64) << np.uint64(64 - bits)

    def blobs(values, at):
        return pa.array([values[at[i]:at[i + 1]].tobytes() for i in range(buckets)], pa.binary())

    def by_token(tokens, holders):
        cuts = np.append(np.searchsorted(tokens, limits), len(tokens))
        return blobs((tokens >> np.uint64(32 - bits)).astype(np.uint32), cuts), blobs(holders, cuts)

    def spread(values):
        return blobs(values, np.linspace(0, len(values), buckets + 1).astype(np.int64))

    tokens, holders, starts, lengths = _pairs(tokens, band_contents)
    a, b = _ties(holders, starts, lengths)
    band = by_token(tokens[starts], holders[starts])
    contents, holders, starts, lengths = _pairs(contents, keys)
    several = lengths > 1
    slots = (contents[starts][several] >> np.uint64(64 - BITS)).astype(np.uint32)
    single = by_token(contents[starts], np.where(several, np.uint64(0), holders[starts]))
    return pa.record_batch([pa.array(np.arange(buckets, dtype=np.int32)), *band, spread(a), spread(b), *single, spread(np.unique(slots))], names=PACKED)


PACKED = ["bucket", "tokens", "band_contents", "a", "b", "contents", "documents", "slots"]


def _bands(length: int, places: int, bands: int, per_band: int, lack: int, bits: int):
    def run(batches):
        held, size = {LINE: [], RUN: []}, 0

        def out():
            tokens, holders, contents, keys = [], [], [], []
            for some in held.values():
                if some:
                    own, numbers, documents = (np.concatenate(x) for x in zip(*some))
                    _, first = np.unique(numbers, return_index=True)
                    tokens.append(own[first].ravel())
                    holders.append(np.repeat(numbers[first], own.shape[1]))
                    contents.append(numbers)
                    keys.append(documents)
                some.clear()
            return _send(*(np.concatenate(x) for x in (tokens, holders, contents, keys)), bits)

        for batch in batches:
            for kind, keys, _, _, shingles, cuts in paragraphs(batch, length, places):
                if kind == RUN and lack:
                    own = edge_keys(shingles, length - SHINGLE + 1, lack)
                else:
                    own = band_keys(kind, shingles, cuts, bands, per_band)
                held[kind].append((own, contents_of(kind, shingles, cuts), keys.view(np.uint64)))
                size += own.size + len(keys)
                if size >= CHUNK:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _collisions(rows: pa.Table) -> pa.Table:
    """For one bucket: ties between contents that collide, and the slots of contents that several documents have."""
    def flat(name, dtype):
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype)

    _, holders, starts, lengths = _pairs(flat("tokens", np.uint32), flat("band_contents", np.uint64))
    a, b = _ties(holders, starts, lengths)
    pairs = np.unique(np.stack([np.concatenate([a, flat("a", np.uint64)]), np.concatenate([b, flat("b", np.uint64)])], axis=1), axis=0)
    bucket, bits = int(rows.column("bucket")[0].as_py()), int(rows.column("bits")[0].as_py())
    contents, holders, starts, lengths = _pairs(flat("contents", np.uint32), flat("documents", np.uint64))
    # Document 0 stands for several; it comes first.
    several = contents[starts][(lengths > 1) | (holders[starts] == 0)] if len(starts) else contents
    own = ((np.uint64(bucket) << np.uint64(64 - bits)) | (several.astype(np.uint64) << np.uint64(32 - bits))) >> np.uint64(64 - BITS)
    slots = np.unique(np.concatenate([own.astype(np.uint32), flat("slots", np.uint32)]))
    n, m = len(pairs), len(slots)
    return pa.table({
        "a": pa.array(np.concatenate([pairs[:, 0], np.zeros(m, np.uint64)]).view(np.int64), mask=np.arange(n + m) >= n),
        "b": pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.uint64)]).view(np.int64), mask=np.arange(n + m) >= n),
        "slot": pa.array(np.concatenate([np.zeros(n, np.int64), slots.astype(np.int64)]), mask=np.arange(n + m) < n)})


def _wanted(sieve, tied, length: int, places: int):
    """Arrow function: the paragraphs whose content passes the sieve, marked where it passes that of the ties.

    The first one of such a content in a task carries its shingles (31 bits of each).
    """

    def run(batches):
        seen: set = set()
        for batch in batches:
            row_of = {}
            for kind, keys, firsts, n, shingles, cuts in paragraphs(batch, length, places):
                contents = contents_of(kind, shingles, cuts)
                slots = contents >> np.uint64(64 - BITS)
                keep = passes(sieve, slots)
                if not keep.any():
                    continue
                if not row_of:
                    row_of = {k: i for i, k in enumerate(batch.column("key").to_pylist())}
                shown = passes(tied, slots)[keep]
                sizes, contents = np.diff(cuts), contents[keep]
                kept = shingles[np.repeat(keep, sizes)]
                sizes = sizes[keep]
                first = np.zeros(len(contents), bool)
                first[np.unique(contents, return_index=True)[1]] = True
                first &= shown
                first[first] = [c not in seen for c in contents[first].tolist()]
                seen.update(contents[first].tolist())
                # Shingles of different kinds differ, so that lines and runs are never similar.
                kept = kept[np.repeat(first, sizes)] >> np.uint64(33) << np.uint64(1) | np.uint64(kind)
                ends = np.concatenate([[0], np.cumsum(np.where(first, sizes, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(kept.astype(np.uint32).view(np.int32)), mask=pa.array(~first))
                ids = batch.column("id").take(pa.array([row_of[k] for k in keys[keep].tolist()], pa.int64()))
                yield pa.record_batch([ids, pa.array(contents.view(np.int64)), pa.array(keys[keep]), pa.array(firsts[keep]),
                                       pa.array(n[keep].astype(np.int64)), pa.array(shown), lists],
                                      names=["id", "content", "key", "first", "n_words", "tied", "shingles"])

    return run


def _classes(ties: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Class of each content that is like another one: (content, component).

    ``ties`` only connect the contents that collide, one of them with each other one. Those that are similar are links.
    What failed ties hold together beyond the links is a block, and the contents of a block of three or more are
    searched exactly, each with each: no collision leaves a block, so every similar pair that collides is connected.
    """
    both = ties.join(sets.select(F.col("content").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("content").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    checked = staged(both.select("a", "b", (shared >= similarity * (F.size("sa") + F.size("sb") - shared)).alias("alike")), "checked")
    drop_shuffles(sets.sparkSession)
    alike = components(checked.where("alike").select("a", "b"))
    first = alike.select(F.col("node").alias("content"), "component")

    def contracted(edges):
        """``edges`` between what the links connect already."""
        for end in ("a", "b"):
            of = first.select(F.col("content").alias(end), "component")
            edges = edges.join(of, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        return edges.select("a", "b").where("a <> b").distinct()

    held = components(contracted(checked.where("not alike").select("a", "b")))
    blocks = held.select("node", F.col("component").alias("block"))
    # Contents of the blocks, whether or not a link has them.
    linked = first.join(blocks, F.col("component") == F.col("node")).select("content", "block")
    alone = blocks.join(first, F.col("node") == F.col("content"), "left_anti").select(F.col("node").alias("content"), "block")
    members = staged(linked.unionByName(alone), "blocks")
    large = members.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 2").select("block")
    share = Fraction(str(similarity))
    searched = staged(sets.join(members.join(large, "block"), "content").select("block", F.col("content").alias("cls"), F.col("s").alias("tokens")), "searched")
    drop_shuffles(sets.sparkSession)
    links = links_in_blocks(searched, share.numerator, of=share.denominator)
    whole = components(contracted(links))
    second = whole.withColumnRenamed("component", "whole")
    linked = first.join(second, F.col("component") == F.col("node"), "left").select("content", F.coalesce("whole", "component").alias("component"))
    added = second.join(first, F.col("node") == F.col("content"), "left_anti")
    classes = staged(linked.unionByName(added.select(F.col("node").alias("content"), F.col("whole").alias("component"))), "contents")
    release(checked, alike, held, members, searched, links, whole)
    return classes


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, places: int = PLACES,
                      similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Paragraphs that stand in more than one document.

    A paragraph is a line of SHINGLE words or more (runs of non-space, A-Z as a-z), a block of lines between empty ones, or
    ``length`` words from a content-defined place on (a run), as passages need not begin or end with a line. Lines and
    blocks, and runs among each other, are linked when their sets of SHINGLE-word shingles have a Jaccard similarity of
    ``similarity`` or more; what collisions hold together is a block of contents, searched exactly. Lines and blocks
    collide in MinHash bands, similar ones with a chance of ``recall``; runs, which can then only begin or end
    differently, in what is left without their first or last shingles. Every passage of ``places + length - 1`` words (51)
    that documents share word by word is found (in a run of one word over and over only the beginning of the run
    counts). Linked paragraphs form classes (components), and classes within one document are left out.

    Returns one row per paragraph: ``<id_col>, first_word, n_words, class_id, class_size, kept_in, removed``. ``class_id``
    is a number of the class, ``kept_in`` the smallest id in it; the first paragraph of that document stays, the others
    are ``removed``. Null and empty texts and those of fewer than SHINGLE words have no paragraphs. Rows that repeat id and text are one document;
    null ids count as documents and come last in the order of ids. An empty table gives an empty result.
    """
    bands = tuned_bands(similarity, recall)
    own = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    keyed = own.select("id", "text", F.xxhash64(F.col("id"), F.xxhash64("text")).alias("key"))
    lack = edges_of_runs(length, similarity)
    # About six bytes a word, a run for every (places + 1) / 2 words, and a line for every 25.
    words = (docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0) / 6
    entries = words * ((lack + 1 if lack else bands) / ((places + 1) / 2) + bands / 25)
    bits = max(1, math.ceil(math.log2(max(1.0, entries / BUCKET))))
    kinds = ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in PACKED)
    packed = keyed.select("key", "text").mapInArrow(_bands(length, places, bands, ROWS, lack, bits), kinds).withColumn("bits", F.lit(bits))
    found = staged(packed.groupBy("bucket").applyInArrow(_collisions, "a bigint, b bigint, slot bigint"), "collisions")
    ties = staged(found.where("a is not null").select("a", "b").distinct(), "ties")
    slot = F.shiftrightunsigned("content", 64 - BITS).alias("slot")
    of_ties = ties.select(F.col("a").alias("content")).union(ties.select("b")).select(slot)
    tied = bitmap(of_ties)
    sieve = tied | bitmap(found.where("slot is not null").select("slot"))
    release(found)
    id_type = keyed.schema["id"].dataType.simpleString()
    drop_shuffles(docs.sparkSession)
    wide = staged(keyed.mapInArrow(
        _wanted(sieve, tied, length, places),
        f"id {id_type}, content bigint, key bigint, first bigint, n_words bigint, tied boolean, shingles array<int>"), "paragraphs")
    sets = staged(wide.where("shingles is not null").select("content", F.array_distinct("shingles").alias("s"))
                  .dropDuplicates(["content"]), "sets")
    units = staged(wide.drop("shingles"), "units")
    release(wide)
    drop_shuffles(docs.sparkSession)
    classes = _classes(ties, sets, similarity)
    release(ties, sets)
    rest = ["id", "key", "first", "n_words"]
    if not keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # rows that repeat id and text
        units = units.dropDuplicates(["content", "key", "first"])
    # Only contents with their shingles can be in a tie; all others are classes of their own.
    plain = units.where("not tied").select(F.col("content").alias("class_id"), *rest)
    members = plain.unionByName(units.where("tied").select("content", *rest).join(classes, "content", "left").select(
        F.coalesce("component", "content").alias("class_id"), *rest))
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("key"), F.col("first"))
    facts = staged(members.groupBy("class_id").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("class_size"), F.min(place).alias("kept")
    ).where("low <> high").drop("low", "high"), "classes")
    return members.join(facts, "class_id").select(
        F.col("id").alias(id_col), F.col("first").alias("first_word"), "n_words", "class_id", "class_size", F.col("kept.id").alias("kept_in"),
        ((F.col("key") != F.col("kept.key")) | (F.col("first") != F.col("kept.first"))).alias("removed"))


def _cut(batches):
    """Arrow function: texts without the words of the given paragraphs."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts = []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            gone = set()
            for place in places:
                gone.update(range(place["first_word"], place["first_word"] + place["n_words"]))
            parts, end = [], 0
            for i, m in enumerate(word.finditer(text)):
                if i in gone:
                    parts.append(text[end:m.start()] if i - 1 not in gone else "")
                    end = m.end()
            parts.append(text[end:])
            texts.append("".join(parts))
        yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs of :func:`repeated_passages` cut out of their texts; ids are taken as unique."""
    key, places = fresh(docs, "key"), fresh(docs, "places")
    gone = found.where("removed").groupBy(F.col(id_col).alias(key)).agg(F.collect_set(F.struct("first_word", "n_words")).alias(places))
    joined = docs.join(gone, col(id_col).eqNullSafe(col(key)), "left")
    row = F.struct(*[col(c) for c in docs.columns])
    cut = joined.where(col(places).isNotNull()).select(row.alias("row"), col(text_col).alias("text"), col(places).alias("places"))
    kind = cut.schema["row"].dataType.simpleString()
    cut = cut.mapInArrow(_cut, f"row {kind}, text string").select(
        *[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return joined.where(col(places).isNull()).select(*[col(c) for c in docs.columns]).unionByName(cut)
