"""Scores, order, risks and roll-ups of change plans.

``plans``: one row per planned file (run_id, pos, file_path, priority, modification_type, needs_modification,
new_dependencies). ``mods``: one row per modification (run_id, pos of its file, seq, action, old_code, new_code,
explanation, ...). ``requests``: run_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import contains_any, file_name, words
from corpuscope.operators.topk import first_per_group, positions

PLAN_KEYS = ["run_id", "pos"]

# Words and weights of the alignment score.
ALIGNMENT_TECHNOLOGIES = ["pandas", "pyspark", "numpy", "flask", "django", "spark"]
ALIGNMENT_PACKAGES = ["pyspark", "pandas", "numpy"]
ALIGNMENT_ACTIONS = ["migrate", "convert", "add", "remove", "update"]
INTENT_WORDS = ["user", "request"]
INTENT_WEIGHT = 0.5
ACTION_WEIGHT = 0.8
NEUTRAL_ALIGNMENT = 0.5
# Averages are compared at this many decimals, so the order of summation cannot move a threshold.
AVERAGE_DECIMALS = 9

# Priorities in order, file-name words in order, query words used.
PRIORITIES = ["high", "medium", "low"]
ORDER_WORDS = ["config", "util", "load", "input", "process", "transform", "output", "write"]
QUERY_WORDS = 3
QUERY_WORD_LENGTH = 4
NO_WORD = 1000
# Places in the plan ordered together when positions are counted.
POSITIONS_PER_BLOCK = 100_000

# Thresholds and texts of the risk list.
HIGH_PRIORITY_LIMIT = 2
MODIFICATION_LIMIT = 15
LOW_ALIGNMENT = 0.3
RISK_TEXTS = {
    "high_priority": "Multiple high-priority files require modification",
    "modifications": "Large number of modifications detected",
    "migration": "Migration project detected - thorough testing recommended",
    "framework": "Big data/ML framework integration - performance testing needed",
    "scope": "Project-wide changes requested - staged rollout recommended",
    "performance": "Performance optimization requested - benchmark testing required",
}
RISK_WORDS = {
    "migration": ["migrate", "convert"],
    "framework": ["pyspark", "tensorflow", "pytorch"],
    "scope": ["entire project", "all files"],
    "performance": ["performance", "optimize"],
}

# Complexity weights and thresholds.
HIGH_FILE_WEIGHT = 5
CLEAR_ALIGNMENT = 0.8
CLEAR_FACTOR = 0.8
UNCLEAR_FACTOR = 1.3
COMPLEXITY_HIGH = 25
COMPLEXITY_MEDIUM = 10

# Roles by words in the file name, in the order they are tried, with impact and dependency texts.
FILE_ROLES = {
    "configuration": ["config", "setting"],
    "utility": ["util", "helper"],
    "main_application": ["main", "app"],
    "test": ["test"],
    "data_processing": ["data", "load"],
}
ROLE_IMPACT = {
    "configuration": "High - affects entire application",
    "utility": "Medium - affects dependent modules",
    "main_application": "High - affects application execution",
    "test": "Low - affects testing only",
    "data_processing": "Medium - affects data flow",
    "general": "Medium - standard impact",
}
DEPENDENCY_HINTS = {
    "config": "configuration dependency",
    "util": "utility dependency",
    "main": "main execution dependency",
    "load": "data loading dependency",
}


def _lower(c) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _total(columns) -> Column:
    return sum(columns, F.lit(0.0))


def alignment(plans: DataFrame, mods: DataFrame, requests: DataFrame) -> DataFrame:
    """Add ``user_alignment_score`` and ``n_modifications`` to every planned file.

    What the modifications mention is first reduced to one row of flags per file with map-side maxima; only those
    rows meet the plans and the request texts.
    """
    code, why = F.col("__code"), F.col("__why")
    flags = {
        **{f"m_{t}": F.contains(code, F.lit(t)) | F.contains(why, F.lit(t)) for t in ALIGNMENT_TECHNOLOGIES},
        **{f"a_{a}": F.contains(why, F.lit(a)) for a in ALIGNMENT_ACTIONS},
        "intent": contains_any(why, INTENT_WORDS),
    }
    lowered = mods.select(*PLAN_KEYS, _lower("new_code").alias("__code"), _lower("explanation").alias("__why"))
    seen = lowered.groupBy(*PLAN_KEYS).agg(
        F.count(F.lit(1)).alias("n_modifications"), *[F.max(c).alias(n) for n, c in flags.items()]
    )
    rows = plans.join(seen, PLAN_KEYS, "left").join(requests.select("run_id", F.col("text").alias("__text")), "run_id", "left")
    listed = F.coalesce("new_dependencies", F.array().cast("array<string>"))
    rows = rows.withColumns({"__asked": _lower("__text"), "__deps": F.lower(F.array_join(listed, " "))})
    text, deps, has_deps = F.col("__asked"), F.col("__deps"), F.size(listed) > 0

    def asked(word):
        return F.contains(text, F.lit(word))

    def hit(flag):
        return F.coalesce(F.col(flag), F.lit(False))

    def one(condition, weight=1.0):
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    dep_hit = contains_any(F.lit(""), [])
    for package in ALIGNMENT_PACKAGES:
        dep_hit = dep_hit | (asked(package) & F.contains(deps, F.lit(package)))
    score = (
        _total(one(asked(t) & hit(f"m_{t}")) for t in ALIGNMENT_TECHNOLOGIES)
        + one(has_deps & dep_hit)
        + one(hit("intent"), INTENT_WEIGHT)
        + _total(one(asked(a) & hit(f"a_{a}"), ACTION_WEIGHT) for a in ALIGNMENT_ACTIONS)
    )
    checks = (
        _total(one(asked(t)) for t in ALIGNMENT_TECHNOLOGIES)
        + one(has_deps)
        + F.lit(1.0)
        + _total(one(asked(a)) for a in ALIGNMENT_ACTIONS)
    )
    empty_plan = F.col("n_modifications").isNull() & F.col("new_dependencies").isNull()
    value = F.when((text == "") | empty_plan, F.lit(NEUTRAL_ALIGNMENT)).otherwise(F.least(score / checks, F.lit(1.0)))
    return rows.select(
        *plans.columns,
        F.coalesce("n_modifications", F.lit(0)).cast("bigint").alias("n_modifications"),
        value.alias("user_alignment_score"),
    )


def plan_entries(scored: DataFrame) -> DataFrame:
    """Planned files with the defaults of a plan entry."""
    return scored.withColumns({
        "file_path": F.coalesce("file_path", F.lit("unknown")),
        "priority": F.coalesce("priority", F.lit("medium")),
        "modification_type": F.coalesce("modification_type", F.lit("general")),
        "needs_modification": F.coalesce("needs_modification", F.lit(True)),
    })


def priority_rank(c="priority") -> Column:
    """1 high, 2 medium, 3 low, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col(c)).cast("int")


def order_words(text) -> Column:
    """First three long words of the request, then the fixed words."""
    long = F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.length(w) >= QUERY_WORD_LENGTH)
    own = F.transform(F.slice(long, 1, QUERY_WORDS), lambda w: F.lower(w))
    return F.concat(own, F.array(*[F.lit(w) for w in ORDER_WORDS]))


def execution_order(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Position of every distinct path of a run.

    Order: priority, first matching word of the file name, alignment (high first), place in the plan. Paths with an
    unknown priority are left out. Positions are counted over small cells, so a run of any size is spread.
    """
    asked = requests.select("run_id", order_words("text").alias("__words"))
    name = F.lower(file_name("file_path"))
    none = F.array(*[F.lit(w) for w in ORDER_WORDS])
    found = F.array_position(F.transform(F.coalesce("__words", none), lambda w: F.contains(name, w)), True)
    ranked = (
        entries.withColumn("__priority", priority_rank())
        .where(F.col("__priority") > 0)
        .join(asked, "run_id", "left")
        .withColumn("__word", F.when(found > 0, found).otherwise(F.lit(NO_WORD)).cast("int"))
        .withColumn("__misfit", -F.coalesce("user_alignment_score", F.lit(NEUTRAL_ALIGNMENT)))
        .withColumn("__block", F.floor(F.col("pos") / POSITIONS_PER_BLOCK))
        .select("run_id", "pos", "file_path", "__priority", "__word", "__misfit", "__block")
    )
    # Scores are ratios of small numbers, so they take few values; the block splits runs where many files share one.
    coarse = ["__priority", "__word", "__misfit", "__block"]
    distinct = first_per_group(ranked, ["run_id", "file_path"], [*coarse, "pos"], 1)
    placed = positions(distinct, ["run_id"], coarse, ["pos"], "execution_position")
    priority = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("__priority")).alias("priority")
    return placed.select("run_id", "execution_position", "file_path", priority)


def run_facts(entries: DataFrame) -> DataFrame:
    """Per run: files, high-priority files, modifications, weakly aligned files, mean alignment."""
    score = F.coalesce("user_alignment_score", F.lit(NEUTRAL_ALIGNMENT))
    return entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("priority") == "high").alias("high_priority_files"),
        F.coalesce(F.sum("n_modifications"), F.lit(0)).cast("bigint").alias("total_modifications"),
        F.count_if(score < LOW_ALIGNMENT).alias("low_alignment_files"),
        F.round(F.avg(score), AVERAGE_DECIMALS).alias("avg_alignment"),
    )


def risks(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per risk of a run, in list order; runs without a planned file only have those of their text."""
    facts = requests.select("run_id", "text").join(run_facts(entries), "run_id", "left")
    text = _lower("text")
    listed = [
        (F.coalesce(F.col("high_priority_files"), F.lit(0)) > HIGH_PRIORITY_LIMIT, F.lit(RISK_TEXTS["high_priority"])),
        (F.coalesce(F.col("total_modifications"), F.lit(0)) > MODIFICATION_LIMIT, F.lit(RISK_TEXTS["modifications"])),
        *[(contains_any(text, w), F.lit(RISK_TEXTS[k])) for k, w in RISK_WORDS.items()],
        (
            F.col("low_alignment_files") > 0,
            F.concat(F.lit("Low user query alignment detected in "), F.col("low_alignment_files"), F.lit(" files")),
        ),
    ]
    found = F.array_compact(F.array(*[F.when(c, t) for c, t in listed]))
    return facts.select("run_id", F.posexplode(found).alias("risk_no", "risk"))


def plan_complexity(entries: DataFrame) -> DataFrame:
    """Estimated complexity of every run."""
    base = F.col("total_modifications") + F.col("high_priority_files") * HIGH_FILE_WEIGHT
    factor = (
        F.when(F.col("avg_alignment") > CLEAR_ALIGNMENT, F.lit(CLEAR_FACTOR))
        .when(F.col("avg_alignment") < LOW_ALIGNMENT, F.lit(UNCLEAR_FACTOR))
        .otherwise(F.lit(1.0))
    )
    scored = run_facts(entries).withColumn("complexity_score", F.round(base * factor, AVERAGE_DECIMALS))
    return scored.select(
        "run_id", "total_modifications", "high_priority_files", "avg_alignment", "complexity_score",
        F.when(F.col("complexity_score") > COMPLEXITY_HIGH, "high")
        .when(F.col("complexity_score") > COMPLEXITY_MEDIUM, "medium")
        .otherwise("low").alias("estimated_complexity"),
    )


def plan_rollup(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Per run: number of files and mean alignment, 0 for a run without files."""
    facts = run_facts(entries).select("run_id", "n_files", "avg_alignment")
    return requests.select("run_id").join(facts, "run_id", "left").select(
        "run_id",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("avg_alignment", F.lit(0.0)).alias("overall_alignment_score"),
        F.lit(True).alias("backup_required"),
    )


def file_roles(df: DataFrame, path: str) -> DataFrame:
    """Role, impact and dependency hint of a file, from its name."""
    base = F.when(F.coalesce(F.col(path), F.lit("")) == "", F.lit("unknown")).otherwise(file_name(path))
    name = F.lower(base)
    role = F.lit("general")
    for r, w in reversed(FILE_ROLES.items()):
        role = F.when(contains_any(name, w), F.lit(r)).otherwise(role)
    hint = F.lit(None).cast("string")
    for w, text in reversed(DEPENDENCY_HINTS.items()):
        hint = F.when(F.contains(name, F.lit(w)), F.concat(base, F.lit(f" - {text}"))).otherwise(hint)
    impact = F.create_map(*[F.lit(v) for pair in ROLE_IMPACT.items() for v in pair])
    return df.withColumn("file_type", role).withColumns({
        "potential_impact": impact[F.col("file_type")],
        "dependency_hint": hint,
    })


# Lists of a target file that hold its cross-file dependencies.
DEPENDENCY_LISTS = ["depends_on", "affects", "imports_from", "imported_by"]


def prepare_targets(df: DataFrame, keys=("run_id",), pos: str = "pos") -> DataFrame:
    """Fill missing dependency lists, drop dependencies that say nothing, and place files by priority per run.

    ``pos`` is the number of the file in the run's list; positions are counted over blocks of it.
    """
    empty = F.array().cast("array<string>")
    filled = df.withColumns({
        **{c: F.coalesce(F.col(c), empty) for c in DEPENDENCY_LISTS},
        "dependency_reason": F.coalesce("dependency_reason", F.lit("")),
        "priority": F.coalesce("priority", F.lit("medium")),
    })
    says = F.col("dependency_reason") != ""
    for c in DEPENDENCY_LISTS:
        says = says | (F.size(c) > 0)
    kept = filled.withColumn(
        "cross_file_dependencies",
        F.when(says, F.struct(*DEPENDENCY_LISTS, "dependency_reason")),
    ).drop(*DEPENDENCY_LISTS, "dependency_reason")
    rank = F.when(priority_rank() > 0, priority_rank()).otherwise(F.lit(len(PRIORITIES) + 1))
    cells = kept.withColumns({"__rank": rank, "__block": F.floor(F.col(pos) / POSITIONS_PER_BLOCK)})
    return positions(cells, list(keys), ["__rank", "__block"], [pos], "target_position").drop("__rank", "__block")


def group_mods(mods: DataFrame, planned: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Modifications with the file they belong to: their own, else the run's first planned one.

    Stays one row per modification, keyed by (run_id, file_path), so a run or file of any size is never put in one
    cell; ``shared`` holds per-run lists that go to every file.
    """
    first = planned.groupBy("run_id").agg(F.min_by("file_path", "pos").alias("__first"))
    rows = mods.join(first, "run_id", "left").withColumn(
        "file_path", F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.col("__first"))
    ).drop("__first")
    return rows if shared is None else rows.join(shared, "run_id", "left")


def mods_per_file(grouped: DataFrame) -> DataFrame:
    """Modification counts per run and file."""
    return grouped.groupBy("run_id", "file_path").agg(
        F.count(F.lit(1)).alias("n_modifications"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("add", "modify", "delete")],
    )


def generation_summary(results: DataFrame) -> DataFrame:
    """Per run: success without a failed file, modifications of the files that worked, number of failed files.

    ``results``: run_id, file_path, modifications_applied (NULL for a failed file).
    """
    failed = F.col("modifications_applied").isNull()
    return results.groupBy("run_id").agg(
        (F.count_if(failed) == 0).alias("success"),
        F.coalesce(F.sum("modifications_applied"), F.lit(0)).cast("bigint").alias("total_modifications"),
        F.count_if(~failed).alias("modified_files"),
        F.count_if(failed).alias("failed_files"),
    )


def failed_files(results: DataFrame) -> DataFrame:
    """The failed files with their message, one row each."""
    return results.where(F.col("modifications_applied").isNull()).select(
        "run_id", "file_path", F.concat(F.lit("Failed to process file: "), "file_path").alias("error")
    )
