"""Declared steps: read, filter, join, custom_sql, derive and write, run as DataFrame calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.topk import positions

# Parameters each operation needs, and the steps sent together.
REQUIRED = {
    "read": ["path", "format"],
    "filter": ["input", "condition"],
    "join": ["left", "right", "on", "how"],
    "custom_sql": ["sql"],
    "derive": ["input", "column", "expression"],
    "write": ["input", "path", "format"],
}
STEPS_PER_BATCH = 10
TABLE_PATH = "./examples/%s.json"
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def resolve_tables(requested: DataFrame, known: DataFrame, name: str = "table_name", template: str = TABLE_PATH) -> DataFrame:
    """Requested tables that are known, with their path."""
    allowed = known.select(name).distinct()
    return requested.join(allowed, name, "left_semi").withColumn("path", F.format_string(template, F.col(name)))


def required_params() -> F.Column:
    """Needed parameters of the operation in column ``op``."""
    pairs = [x for op, names in REQUIRED.items() for x in (F.lit(op), F.array(*[F.lit(n) for n in names]))]
    return F.create_map(*pairs)[F.col("op")]


def check_steps(steps: DataFrame, keys=("config_id", "pos")) -> DataFrame:
    """One row per missing parameter, or ``unknown operation``. ``steps``: keys, op, params (map).

    The requirements are a literal map, so this is one projection without a join.
    """
    params = F.coalesce("params", F.create_map().cast("map<string,string>"))
    given = F.filter(F.map_keys(params), lambda k: F.length(F.trim(params[k])) > 0)
    problem = F.when(required_params().isNull(), F.array(F.lit("unknown operation"))).otherwise(
        F.transform(F.array_except(required_params(), given), lambda p: F.concat(F.lit("missing "), p))
    )
    return steps.select(*keys, "op", F.explode(problem).alias("problem"))


def batch_steps(steps: DataFrame, n: int = STEPS_PER_BATCH, pos: str = "pos", keys=("config_id",)) -> DataFrame:
    """Batch number of every step: the steps of a list in the order of ``pos``, ``n`` at a time, whatever the gaps."""
    cell = steps.withColumn("__cell", F.floor(F.col(pos) / 1000))
    placed = positions(cell, list(keys), ["__cell"], [pos], "__at")
    return placed.withColumn("batch", F.floor((F.col("__at") - 1) / n).cast("bigint")).drop("__cell", "__at")


def _need(step: dict) -> None:
    op = step.get("op")
    if op not in REQUIRED:
        raise ValueError(f"unknown operation {op!r}")
    missing = [p for p in REQUIRED[op] if not step.get(p)]
    if missing and not (op == "write" and missing == ["path"] and step.get("format") == "stdout"):
        raise ValueError(f"step {op}: missing {', '.join(missing)}")


def run_steps(spark: SparkSession, steps: list[dict], inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Run steps in order and return every named result.

    Nothing is executed before a write: each step only extends a DataFrame, so Catalyst sees the whole chain and
    pushes filters and columns into the reads. ``custom_sql`` sees the named results as temporary views.
    """
    frames = dict(inputs or {})
    for i, step in enumerate(steps):
        _need(step)
        name = step.get("name", f"step_{i}")
        match step["op"]:
            case "read":
                frames[name] = spark.read.options(**step.get("options", {})).format(step["format"]).load(step["path"])
            case "filter":
                frames[name] = frames[step["input"]].where(F.expr(step["condition"]))
            case "join":
                on = step["on"] if isinstance(step["on"], list) else [c.strip() for c in step["on"].split(",")]
                frames[name] = frames[step["left"]].join(frames[step["right"]], on, JOIN_KINDS[step["how"]])
            case "custom_sql":
                for view, frame in frames.items():
                    frame.createOrReplaceTempView(view)
                frames[name] = spark.sql(step["sql"])
            case "derive":
                frames[name] = frames[step["input"]].withColumn(step["column"], F.expr(step["expression"]))
            case "write":
                _write(frames[step["input"]], step)
    return frames


def _write(df: DataFrame, step: dict) -> None:
    columns = step.get("columns")
    out = df.select(*columns) if columns else df
    if step["format"] == "stdout":
        shown = int(step.get("rows", 20))
        out.show(shown, truncate=False)
        print(f"{max(0, out.count() - shown)} rows not shown")
    else:
        out.write.mode(step.get("mode", "errorifexists")).format(step["format"]).save(step["path"])
