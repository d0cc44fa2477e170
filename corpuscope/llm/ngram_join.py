"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of the documents that can have a partner."""

from __future__ import annotations

import hashlib
import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.components import components
from corpuscope.llm.sieve import bitmap, passes, slot_of
from corpuscope.llm.tables import col, fresh
from corpuscope.llm.words import SPACED, documents_words, grams
from corpuscope.session import release, staged

# Words of a shingle; a link needs 100 * |A and B| >= PERCENT * |A or B|.
SHINGLE = 4
PERCENT = 85
# Shingles collected in a task before they are sent off, and about how many a bucket gets.
CHUNK = 1 << 21
BUCKET = 1 << 20
# Documents and shingles searched in one task; a larger block is searched as all pairs of its parts.
SHARD = 2000
SHARD_TOKENS = 1 << 22
# Long lists probed before candidates that can no longer reach the threshold are dropped.
PROBE = 64


def least_overlap(n, percent: int, of: int = 100):
    """Shingles a partner has to share with a set of ``n``, as the union has at least ``n``."""
    return -(-percent * n // of)


def shingle_sets(batch: pa.RecordBatch, shingle: int):
    """Yield (row, number of shingles, class, sorted distinct shingle hashes) for each text that has words.

    The class is a 64-bit hash of the set, never 0.
    """
    for first, hashes, bounds in documents_words(batch.column("text"), SPACED):
        whole = grams(hashes, shingle)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                continue
            if b - a < shingle:
                own = grams(hashes[a:b], b - a) + np.uint64(b - a)
            else:
                own = np.unique(whole[a:b - shingle + 1])
            key = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) or 1
            yield first + i, len(own), key, own


def _classes(shingle: int):
    """Arrow function: id, set size and class of every text."""

    def run(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            keys = np.zeros(batch.num_rows, np.int64)
            for row, n, key, _ in shingle_sets(batch, shingle):
                sizes[row], keys[row] = n, key
            yield pa.record_batch([batch.column("id"), pa.array(sizes), pa.array(keys, mask=sizes == 0)], names=["id", "n", "cls"])

    return run


def _send(tokens, holders, bits: int):
    """Rows for the buckets of one chunk of (shingle, class) pairs, all different.

    A shingle that two classes of the chunk have is known to be shared: its holders are counted here, and it goes on
    once, with holder 0. So a shingle that very many documents have is one entry per chunk.
    """
    order = np.argsort(tokens)
    tokens, holders = tokens[order], holders[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(tokens)))
    shared = np.repeat(lengths > 1, lengths)
    counted, times = np.unique(holders[shared], return_counts=True)
    one = tokens[starts]
    holder = np.where(lengths > 1, 0, holders[starts])
    buckets = 1 << bits
    cuts = np.searchsorted(one, np.arange(buckets, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.append(cuts, len(one))
    rest = (one >> np.uint64(32 - bits)).astype(np.uint32)
    parts = np.linspace(0, len(counted), buckets + 1).astype(np.int64)

    def blobs(values, at):
        return pa.array([values[at[i]:at[i + 1]].tobytes() for i in range(buckets)], pa.binary())

    return pa.record_batch(
        [pa.array(np.arange(buckets, dtype=np.int32)), blobs(rest, cuts), blobs(holder, cuts),
         blobs(counted, parts), blobs(times.astype(np.int64), parts)],
        names=["bucket", "tokens", "holders", "counted", "times"])


def _examined(shingle: int, percent: int, bits: int):
    """Arrow function: the smallest shingle hashes of every class of a chunk, packed by bucket."""

    def run(batches):
        tokens, holders, size, seen = [], [], 0, set()
        for batch in batches:
            for _, n, key, own in shingle_sets(batch, shingle):
                if key in seen:
                    continue
                seen.add(key)
                take = min(n, 2 * (n - least_overlap(n, percent) + 1))
                tokens.append(own[:take])
                holders.append(np.full(take, key, np.int64))
                size += take
                if size >= CHUNK:
                    yield _send(np.concatenate(tokens), np.concatenate(holders), bits)
                    tokens, holders, size, seen = [], [], 0, set()
        if size:
            yield _send(np.concatenate(tokens), np.concatenate(holders), bits)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """For one bucket, how many of its shingles each class has in common with another one."""
    def flat(name, dtype):
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype)

    tokens, holders = flat("tokens", np.uint32), flat("holders", np.int64)
    order = np.lexsort((holders, tokens))
    tokens, holders = tokens[order], holders[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(tokens)))
    if len(starts):
        # Of several classes, or of one and some that are counted already.
        several = holders[starts] != holders[starts + lengths - 1]
        held = holders[np.repeat(several, lengths)]
        own, times = np.unique(held[held != 0], return_counts=True)
    else:
        own, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.table({"cls": np.concatenate([own, flat("counted", np.int64)]),
                     "shared": np.concatenate([times.astype(np.int64), flat("times", np.int64)])})


def _sets(sieve, shingle: int):
    """Arrow function: shingle sets of the documents whose text passes the sieve."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(sieve, batch.column("slot").to_numpy())))
            found = [(n, key, own.tobytes()) for _, n, key, own in shingle_sets(batch, shingle)]
            if found:
                n, key, own = zip(*found)
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary())],
                                      names=["cls", "n", "tokens"])

    return run


def _token_rows(batches):
    """Arrow function: one row per class and shingle."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.int64)
        yield pa.record_batch([pa.array(np.repeat(batch.column("cls").to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(tokens)],
                              names=["cls", "n", "token"])


def t_occurrence(sizes, sets, sides, percent: int, of: int = 100):
    """Links among sets of shingles, without those between sets that are connected already: pairs of positions.

    ``sizes[i]`` is the whole size of set i and ``sets[i]`` the shingles in it that any other set has, rarest first.
    With ``sides`` only sets of different sides are compared. Sets are taken by size; for each, the inverted lists of
    its shingles over the smaller sets are divided as DivideSkip does: a link needs ``t`` common shingles, so a
    partner is in at least one of the lists left when the ``t - 1`` longest are put aside. The short lists are merged
    on a heap; what comes out is looked up in the long lists by binary search and dropped as soon as it can no
    longer reach its threshold.
    """
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    place = np.array([sizes[i] for i in order], np.int64)
    side = np.array([sides[i] for i in order]) if sides is not None else None
    lengths = [len(sets[i]) for i in order]
    flat = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.int64)
    names, token = np.unique(flat, return_inverse=True)
    token = token.astype(np.int64)
    owner = np.repeat(np.arange(len(order)), lengths)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    count = len(order)
    # Inverted lists one after the other: list number * number of sets + set.
    entries = np.sort(token * count + owner)
    begin = np.searchsorted(entries, np.arange(len(names) + 1) * count)
    parent = list(range(count))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in range(count):
        n = int(place[x])
        t = least_overlap(n, percent, of)
        own = token[at[x]:at[x + 1]]
        if len(own) < t:
            continue
        smallest = int(np.searchsorted(place, t))
        if smallest >= x:
            continue
        low = np.searchsorted(entries, own * count + smallest)
        high = np.searchsorted(entries, own * count + x)
        by_length = np.argsort(high - low, kind="stable")
        aside = min(t - 1, len(own) - 1)
        short, long = by_length[:len(own) - aside], by_length[len(own) - aside:]
        lists = [(entries[low[j]:high[j]] - own[j] * count).tolist() for j in short if high[j] > low[j]]
        if not lists:
            continue
        mine = root(x)
        merged = [(y, sum(1 for _ in same)) for y, same in groupby(heapq.merge(*lists))]
        merged = [(y, c) for y, c in merged if (side is None or side[y] != side[x]) and root(y) != mine]
        if not merged:
            continue
        cand = np.array([m[0] for m in merged], np.int64)
        have = np.array([m[1] for m in merged], np.int64)
        # |A and B| >= percent / (of + percent) * (|A| + |B|)
        need = -(-percent * (n + place[cand]) // (of + percent))
        for i in range(0, len(long), PROBE):
            keep = have + (len(long) - i) >= need
            cand, have, need = cand[keep], have[keep], need[keep]
            if not len(cand):
                break
            wanted = own[long[i:i + PROBE]][:, None] * count + cand[None, :]
            spot = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            have = have + (entries[spot] == wanted).sum(axis=0)
        for y in cand[have >= need]:
            r, s = root(x), root(int(y))
            if r != s:
                parent[max(r, s)] = min(r, s)
                yield order[x], order[int(y)]


def _search(percent: int, of: int):
    """Links of one task's documents as (a, b) classes."""

    def run(rows: pa.Table) -> pa.Table:
        cls = rows.column("cls").to_numpy()
        tokens = rows.column("tokens").combine_chunks()
        flat, at = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        parts = rows.column("part").to_numpy()
        cross = bool((rows.column("i").to_numpy() != rows.column("j").to_numpy()).any())
        links = list(t_occurrence(rows.column("n").to_numpy().tolist(), sets, parts.tolist() if cross else None, percent, of))
        return pa.table({"a": pa.array([int(cls[x]) for x, _ in links], pa.int64()),
                         "b": pa.array([int(cls[y]) for _, y in links], pa.int64())})

    return run


def _search_blocks(percent: int, of: int):
    """Links within each of the blocks of one task, from whole sets."""

    def run(rows: pa.Table) -> pa.Table:
        block, cls = rows.column("block").to_numpy(), rows.column("cls").to_numpy()
        lists = rows.column("tokens").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        at = np.cumsum(sizes) - sizes
        order = np.argsort(block, kind="stable")
        a, b = [], []
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            holder = np.repeat(np.arange(len(own)), sizes[own])
            _, token, times = np.unique(np.concatenate([flat[at[i]:at[i] + sizes[i]] for i in own]), return_inverse=True, return_counts=True)
            shared = times[token] > 1
            holder, token = holder[shared], token[shared]
            by_rarity = np.lexsort((token, times[token], holder))
            cuts = np.searchsorted(holder, np.arange(1, len(own)))
            for x, y in t_occurrence(sizes[own].tolist(), np.split(token[by_rarity].astype(np.int64), cuts), None, percent, of):
                a.append(cls[own[x]])
                b.append(cls[own[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links_in_blocks(sets: DataFrame, percent: int, shard: int = SHARD, of: int = 100) -> DataFrame:
    """Links (a, b) of whole sets given as rows (block, cls, tokens: array<int>), within their blocks; as :func:`links_within`.

    Sets of blocks up to ``shard`` sets and ``SHARD_TOKENS`` tokens go to a task with their block, so nothing but the sets is
    sent; larger blocks are taken apart by their rare tokens first.
    """
    weight = F.sum(F.size("tokens"))
    blocks = staged(sets.groupBy("block").agg(F.count(F.lit(1)).alias("k"), weight.alias("weight")).where("k > 1"), "sizes")
    small = (F.col("k") <= shard) & (F.col("weight") <= SHARD_TOKENS)
    packs = 1 + (blocks.where(small).agg(F.sum("weight")).first()[0] or 0) // BUCKET
    near = sets.join(blocks.where(small).select("block"), "block").withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)))
    links = near.groupBy("pack").applyInArrow(_search_blocks(percent, of), "a bigint, b bigint")
    large = sets.join(blocks.where(~small).select("block"), "block")
    if not blocks.where(~small).isEmpty():
        rows = large.select("cls", F.size("tokens").cast("bigint").alias("n"), "block", F.explode("tokens").alias("token"))
        rows = staged(rows.select("cls", "n", F.xxhash64("block", "token").alias("token")), "tokens")
        links = links.unionByName(links_within(rows, percent, shard, of))
    links = staged(links, "links")
    release(blocks)
    return links


def links_between(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, shard: int = SHARD) -> DataFrame:
    """Links between classes of equal sets (a, b), enough of them to connect all that are linked.

    ``docs`` has texts, ``classes`` has (cls, n, hash), ``hash`` being that of the text of a document of the class.

    1. Of ``n`` shingles a link needs ``t = least_overlap(n)``, so a class of which more than ``n - t`` shingles are
       its own has no partner. The ``2 * (n - t + 1)`` smallest hashes of each class are sent to buckets of the hash
       range, as packed arrays, and classes with ``n - t + 1`` own ones among them are done.
    2. Of the others all shingles are counted exactly. Ordered from rare to frequent, linked sets share one of their
       first ``n - t + 1``; equal ones tie classes together, and the connected parts are the blocks. No link
       leaves a block.
    3. Blocks are searched by :func:`t_occurrence`: small ones packed together, those above ``shard`` classes or
       ``SHARD_TOKENS`` shingles as all pairs of their parts, so that a task holds two parts at most.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, 2 * (100 - percent) / 100)
    bits = max(1, math.ceil(math.log2(max(1, total * share / BUCKET))))
    packed = docs.select("text").mapInArrow(
        _examined(shingle, percent, bits), "bucket int, tokens binary, holders binary, counted binary, times binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared, "cls bigint, shared bigint")
    shared = shared.groupBy("cls").agg(F.sum("shared").alias("shared"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("bigint") + 1
    looked = F.least("n", 2 * spare)
    alive = staged(classes.join(shared, "cls").where(looked - F.col("shared") < spare).select("cls", slot_of("hash").alias("slot")), "alive")
    found = docs.select("text", slot_of(F.xxhash64("text")).alias("slot")).mapInArrow(
        _sets(bitmap(alive.select("slot")), shingle), "cls bigint, n bigint, tokens binary")
    sets = staged(found.join(alive.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    links = links_within(sets.mapInArrow(_token_rows, "cls bigint, n bigint, token bigint"), percent, shard)
    release(alive, sets)
    return links


def links_within(tokens: DataFrame, percent: int, shard: int = SHARD, of: int = 100) -> DataFrame:
    """Links (a, b) of sets given as rows (cls, n, token), steps 2 and 3 of :func:`links_between`.

    A link needs ``of * |A and B| >= percent * |A or B|``; all sets that such links connect are connected by the result.
    """
    spare = F.col("n") - F.ceil(F.col("n") * percent / of).cast("bigint") + 1
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(often, "token").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    ranked = staged(ranked.where(F.size("ranked") >= F.col("n") - spare + 1).select(
        "cls", "n", F.col("ranked.token").alias("tokens"), (spare - (F.col("n") - F.size("ranked"))).cast("int").alias("prefix")), "ranked")
    firsts = staged(ranked.select("cls", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")), "prefixes")
    star = firsts.groupBy("token").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = components(firsts.join(star, "token").select("a", F.col("cls").alias("b")))

    weighed = blocks.join(ranked.select(F.col("cls").alias("node"), F.size("tokens").alias("weight")), "node")
    counts = weighed.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / shard), F.ceil(F.sum("weight") / SHARD_TOKENS)).cast("int").alias("parts"))
    n, weight = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    n_packs = max(1, n // shard, weight // SHARD_TOKENS)
    placed = blocks.join(counts, "component").select(F.col("node").alias("cls"), "parts", "component")
    # Small blocks share a task; they have no shingle of a prefix in common, so the search keeps them apart.
    placed = placed.withColumn("pack", F.when(F.col("parts") > 1, F.col("component"))
                               .otherwise(F.pmod(F.xxhash64("component"), F.lit(n_packs))))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tasks = ranked.join(placed, "cls").select("cls", "n", "tokens", "pack", "parts", "part", other).select(
        "cls", "n", "tokens", "pack", "parts", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    links = staged(tasks.groupBy("pack", "parts", "i", "j").applyInArrow(_search(percent, of), "a bigint, b bigint"), "links")
    release(ranked, firsts, blocks)
    return links


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          percent: int = PERCENT, shard: int = SHARD) -> DataFrame:
    """Component of every row of ``docs`` under links of n-gram Jaccard similarity.

    Returns ``<id_col>, n_shingles, component_id``: the size of the row's set of ``shingle``-word shingles (words without
    white space, A-Z as a-z; fewer words are one shingle) and the smallest id that links lead to. Equal sets are
    one class and are never compared with each other. Texts without words are empty, linked with nothing, and
    their own component; null text is such a text. Rows with a null id are linked like any others, and links lead
    through them; their component is the smallest id that can be reached, null where there is none. Rows that repeat an id are
    all kept; each gets the component of its own text. Every link counts (64-bit hashes stand for words, shingles and sets).
    """
    return _grouped(docs, id_col, text_col, shingle, percent, shard).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, shard: int = SHARD) -> DataFrame:
    """Rows of :func:`near_duplicate_groups` as (id, hash of the text, n, component_id), with ``component``, the number of it."""
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    keyed = own.select(F.struct("id", F.xxhash64("text").alias("hash")).alias("id"), "text")
    id_type = keyed.schema["id"].dataType.simpleString()
    members = staged(keyed.mapInArrow(_classes(shingle), f"id {id_type}, n bigint, cls bigint").select("id.id", "id.hash", "n", "cls"), "members")
    classes = staged(members.where("n > 0").groupBy("cls", "n").agg(F.min("id").alias("rep"), F.min("hash").alias("hash")), "classes")
    links = links_between(own, classes, shingle, percent, shard)
    groups = components(links)
    release(links)
    joined = classes.join(groups, F.col("cls") == F.col("node"), "left")
    lowest = joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("lowest"))
    final = joined.join(lowest, "component", "left").select(
        F.col("cls").alias("of"), F.coalesce("component", "cls").alias("component"), F.coalesce("lowest", "rep").alias("component_id"))
    return members.join(final, F.col("cls") == F.col("of"), "left").select(
        "id", "hash", "n", "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
             by_text: bool = False) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id, all columns as they were.

    Rows that repeat that id stay together. With ``by_text`` a row goes only if its own text is in a component with a
    smaller id (or it has no id and one in its component has); an id with several texts stays in the components where it
    is the smallest, and of a component without any id the text with the smallest hash stays. Without it an id, or null,
    goes with all its rows once one of them does.
    """
    groups = _grouped(docs, id_col, text_col, shingle, percent)
    dropped = groups.where(F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "hash")
    name, text = fresh(docs, "dropped_id"), fresh(docs, "dropped_hash")
    same = col(id_col).eqNullSafe(F.col(name))
    if by_text:
        unnamed = groups.where("n > 0 and component_id is null")
        first = unnamed.groupBy(F.col("component").alias("of")).agg(F.min("hash").alias("first"))
        again = unnamed.join(first, F.col("component") == F.col("of")).where("hash <> first").select("id", "hash")
        dropped = dropped.unionByName(again).select(F.col("id").alias(name), F.col("hash").alias(text)).distinct()
        same = same & (F.xxhash64(col(text_col)) == F.col(text))
    else:
        dropped = dropped.select(F.col("id").alias(name)).distinct()
    return docs.join(dropped, same, "left_anti")
