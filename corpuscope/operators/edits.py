"""Applying an edits table to a documents table, and line deltas between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions.text import normal_breaks, split_lines, strip
from corpuscope.operators.sweep import edited

# Fixed value: longest added text that is put in without review.
MAX_ADDED_CHARS = 500
# Edits of a document up to which each is a step of its own, which costs a copy of the text.
STEPS = 32


def eligible(mods_action="action", old="old_code", new="new_code"):
    """False for modify/delete without old text and for very long additions."""
    blank_old = F.coalesce(F.col(old), F.lit("")) == ""
    long_new = F.length(F.coalesce(F.col(new), F.lit(""))) > MAX_ADDED_CHARS
    action = F.coalesce(F.col(mods_action), F.lit(""))
    return ~((action.isin("modify", "delete") & blank_old) | ((action == "add") & long_new))


def edit_eligible(mods: DataFrame, keys) -> DataFrame:
    """Per file: whether every modification can be applied directly."""
    return mods.groupBy(*keys).agg(F.min(eligible()).alias("eligible"), F.count(F.lit(1)).alias("n_modifications"))


def _insert(text, line, new):
    """Insert before a line; beyond the last line or without a line number append."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    before = F.call_function("substring_index", text, F.lit("\n"), (line - 1).cast("int"))
    rest = F.substr(text, F.length(before) + 1)
    return (
        F.when(line == 1, F.concat(new, F.lit("\n"), text))
        .when((line > 1) & (line <= lines), F.concat(before, F.lit("\n"), new, rest))
        .otherwise(F.concat(text, F.lit("\n"), new))
    )


def _swap(text, old, new):
    """Replace the first occurrence."""
    at = F.call_function("locate", old, text)
    return F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))


def _step(state, e):
    usable = (
        (e.action == "add")
        | ((e.action == "modify") & (e.old != "") & (e.new != ""))
        | ((e.action == "delete") & (e.old != ""))
    )
    swaps = e.action.isin("modify", "delete")
    missing = usable & swaps & ~F.contains(state.text, e.old)
    new_text = (
        F.when(~state.ok | missing | ~usable, state.text)
        .when(e.action == "add", _insert(state.text, e.line_number, e.new))
        .when(e.action == "modify", _swap(state.text, e.old, e.new))
        .otherwise(_swap(state.text, e.old, F.lit("")))
    )
    return F.struct(
        new_text.alias("text"),
        (state.ok & ~missing).alias("ok"),
        (state.applied + F.when(state.ok & usable & ~missing, 1).otherwise(0)).alias("applied"),
        (state.skipped + F.when(state.ok & ~usable, 1).otherwise(0)).alias("skipped"),
    )


def most_edits(edits: DataFrame, key: str) -> int:
    """Edits of the document that has most of them, counted now."""
    return edits.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] or 0


def apply_edits(docs: DataFrame, edits: DataFrame, key: str, text: str, keep=(), missing: bool = True, most: int | None = None) -> DataFrame:
    """Documents after their edits.

    ``edits``: key, seq, action (add / modify / delete), line_number, old_code, new_code. Line edits come first, last
    line first, the others follow by ``seq``. modify and delete change the first occurrence; when the text is missing
    the document is ``rejected`` and its content NULL. Documents with an edit that may not be applied directly are
    ``ineligible``, those without edits ``unchanged``. Unusable edits are counted in ``edits_skipped``. Edits whose key
    (NULL included) no document has give one row with the status ``missing_document``; without ``missing`` they are left out
    by the join, where a filter on ``status`` would have Spark make every edit a second time. ``keep`` names columns of the
    documents that stay.

    Each edit sees the result of the one before, so a document with its own edits is one row's work; nothing but the
    edits is grouped, and the plan is the same for any number of them. Up to ``STEPS`` edits are a fold in the JVM; longer
    lists go to Python with their text, where neighbouring additions are one pass over the lines and swaps that do not
    touch each other one pass over the text. Every row passes through Python for that, unless ``most`` (see
    :func:`most_edits`) says that no list is longer.
    """
    line = F.coalesce(F.col("line_number"), F.lit(0)).cast("bigint")
    edit = F.struct(
        (-F.greatest(line, F.lit(0))).alias("turn"),
        F.col("seq").alias("seq"),
        F.coalesce("action", F.lit("")).alias("action"),
        line.alias("line_number"),
        F.coalesce(strip("old_code"), F.lit("")).alias("old"),
        F.coalesce(strip("new_code"), F.lit("")).alias("new"),
    )
    lists = edits.groupBy(F.col(key).alias("__key")).agg(
        F.array_sort(F.collect_list(edit)).alias("__list"), F.min(eligible()).alias("__fit"))
    start = F.struct(
        F.col("__text").alias("text"), F.lit(True).alias("ok"), F.lit(0).alias("applied"), F.lit(0).alias("skipped")
    )
    joined = docs.select(key, *keep, F.col(text).alias("__text"), F.lit(True).alias("__found")).join(
        lists, F.col(key) == F.col("__key"), "full" if missing else "left")
    long = F.col("__text").isNotNull() & (F.size("__list") > STEPS)
    state = F.when(F.col("__found") & F.col("__list").isNotNull(), F.aggregate("__list", start, _step)).otherwise(start)
    if most is None or most > STEPS:
        swept = edited()(F.when(long, F.col("__text")), F.when(long, F.col("__list")))
        state = F.when(F.col("__found") & long, swept).otherwise(state)
    status = (
        F.when(F.col("__found").isNull(), "missing_document")
        .when(F.col("__list").isNull(), "unchanged")
        .when(~F.col("__fit"), "ineligible")
        .when(~F.col("__state.ok"), "rejected")
        .otherwise("edited")
    )
    done = joined.withColumn("__state", state).withColumn("status", status)
    counted = F.col("status") == "edited"
    return done.select(
        F.coalesce(key, "__key").alias(key),
        *keep,
        "status",
        F.when(F.col("status").isin("edited", "unchanged"), F.col("__state.text")).alias(text),
        F.when(counted, F.col("__state.applied")).otherwise(F.lit(0)).cast("bigint").alias("edits_applied"),
        F.when(counted, F.col("__state.skipped")).otherwise(F.lit(0)).cast("bigint").alias("edits_skipped"),
    )


def line_delta(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Lines of the new version in order, flagged ``+`` or unchanged.

    The n-th occurrence of a line is unchanged while the old version has at least n of them. Both versions are
    exploded into one stream and meet by (key, line), so no join is needed.
    """
    def numbered(c, is_new):
        return F.transform(
            split_lines(c),
            lambda x, i: F.struct(F.lit(is_new).alias("is_new"), (i + 1).cast("bigint").alias("line_no"), x.alias("line")),
        )

    normal = versions.select(key, normal_breaks(old).alias("__old"), normal_breaks(new).alias("__new"))
    lines = normal.select(
        key, F.explode(F.concat(numbered("__old", False), numbered("__new", True))).alias("l")
    ).select(key, "l.*")
    same = Window.partitionBy(key, "line").orderBy("is_new", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumns({
        "__had": F.sum(F.when(~F.col("is_new"), 1).otherwise(0)).over(same),
        "__seen": F.sum(F.when(F.col("is_new"), 1).otherwise(0)).over(same),
    })
    return seen.where("is_new").select(
        key, "line_no", F.when(F.col("__seen") > F.col("__had"), "+").otherwise(" ").alias("flag"), "line"
    )


def delta_counts(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Per document: added, unchanged and removed lines."""
    def marked(c, n, o):
        return F.transform(split_lines(c), lambda x: F.struct(x.alias("line"), F.lit(n).alias("n"), F.lit(o).alias("o")))

    normal = versions.select(key, normal_breaks(old).alias("__old"), normal_breaks(new).alias("__new"))
    lines = normal.select(key, F.explode(F.concat(marked("__old", 0, 1), marked("__new", 1, 0))).alias("l"))
    per_line = lines.select(key, "l.*").groupBy(key, "line").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    return per_line.groupBy(key).agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("added"),
        F.sum(F.least("n", "o")).alias("unchanged"),
        F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("removed"),
    )
