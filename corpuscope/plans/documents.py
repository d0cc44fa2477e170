"""Config documents as plans: steps ordered by what they need, problems as rows, and runs of whole tables of documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.plans.steps import run_steps
from corpuscope.session import release, staged

# Transformation types and the parameters that each operation of `run_steps` takes from a document.
OPERATIONS = {"filter": ["condition"], "join": ["on", "how"], "custom_sql": ["sql"], "derive": ["column", "expression"], "custom": ["logic"]}
# Custom logic that is one new column from others of its row: df['new'] = expression over df['old'].
_LOGIC = re.compile(r"^\s*df\[\s*['\"](\w+)['\"]\s*\]\s*=(?!=)\s*(.+)$", re.DOTALL)
_COLUMN = re.compile(r"df\[\s*['\"](\w+)['\"]\s*\]")


def document_nodes(documents: DataFrame, key: str) -> DataFrame:
    """What the documents declare, one row each: key, kind, pos, name, makes, needs (array), problem.

    A source makes its name, a transformation its output target (else its name); an output needs what the last
    transformation makes, or the first source where there is none.
    """
    def listed(column, kind, name, makes, needs):
        rows = F.transform(F.coalesce(column, F.array().cast(documents.schema[column].dataType)), lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("bigint").alias("pos"), x["name"].alias("name"), makes(x).alias("makes"), needs(x).alias("needs")))
        return rows

    none = F.array().cast("array<string>")
    last = F.coalesce(
        F.try_element_at(F.transform("transformations", lambda t: F.coalesce(t["output_target"], t["name"])), F.lit(-1)),
        F.try_element_at(F.transform("data_sources", lambda s: s["name"]), F.lit(1)))
    sources = listed("data_sources", "source", "name", lambda x: x["name"], lambda x: none)
    steps = listed("transformations", "transformation", "name", lambda x: F.coalesce(x["output_target"], x["name"]),
                   lambda x: F.coalesce(x["input_sources"], none))
    outputs = listed("outputs", "output", "name", lambda x: F.lit(None).cast("string"),
                     lambda x: F.when(last.isNull(), none).otherwise(F.array(last)))
    return documents.select(key, F.explode(F.concat(sources, steps, outputs)).alias("n")).select(key, "n.*")


def plan_documents(documents: DataFrame, key: str) -> DataFrame:
    """Steps of every document with the layer they can run in: key, kind, pos, name, makes, layer, problem.

    Sources are layer 0; a step runs one layer after the last of what it needs. A step that needs a name nothing in its
    document makes has the problem ``unknown input: name``, what waits for such a step or for itself has no layer and
    the problem ``waits for: name`` or ``cycle``. A name made twice is the problem ``made twice`` of the later ones.
    One round of joins per layer, for all documents together; only the number of new rows comes to the driver.
    """
    nodes = staged(document_nodes(documents, key), "nodes")
    needs = nodes.where("kind <> 'source'").select(key, "kind", "pos", F.explode("needs").alias("need"))
    turn = F.struct(F.when(F.col("kind") == "source", 0).otherwise(1).alias("turn"), "pos")
    made = nodes.where("makes is not null").groupBy(key, F.col("makes").alias("need")).agg(F.min(turn).alias("first"))
    edges = staged(needs.join(made, [key, "need"], "left").select(
        key, "kind", "pos", "need", F.col("first").isNull().alias("unknown")).distinct(), "needs")
    # A name has its layer from the step that makes it first.
    first = staged(nodes.withColumnRenamed("makes", "need").join(made, [key, "need"]).where(turn == F.col("first")).select(
        key, "kind", "pos", F.col("need").alias("makes")), "makers")
    layers = staged(nodes.where(F.size("needs") == 0).select(key, "kind", "pos", F.lit(0).alias("layer")), "layers")
    n, before = layers.count(), -1
    while n != before:
        ready = first.join(layers, [key, "kind", "pos"]).select(key, F.col("makes").alias("need"), F.col("layer").alias("at"))
        found = edges.join(ready, [key, "need"], "left").groupBy(key, "kind", "pos").agg(
            F.count_if(F.col("at").isNull()).alias("open"), (F.max("at") + 1).alias("layer")).where("open = 0").drop("open")
        old, layers = layers, staged(layers.where("layer = 0").unionByName(found).groupBy(key, "kind", "pos").agg(F.max("layer").alias("layer")), "layers")
        release(old)
        n, before = layers.count(), n
    ready = first.join(layers, [key, "kind", "pos"]).select(key, F.col("makes").alias("need"), F.lit(True).alias("made"))
    lacks = edges.join(ready, [key, "need"], "left").where("made is null").groupBy(key, "kind", "pos").agg(
        F.min(F.when(F.col("unknown"), F.col("need"))).alias("unknown"), F.min("need").alias("waits"))
    # Waiting ends at an unknown name somewhere, or goes round.
    broken = staged(lacks.where("unknown is not null").select(key, "kind", "pos"), "broken")
    while True:
        held = first.join(broken, [key, "kind", "pos"]).select(key, F.col("makes").alias("need"))
        more = staged(edges.join(held, [key, "need"], "left_semi").select(key, "kind", "pos").union(broken).distinct(), "broken")
        grown = more.count() > broken.count()
        release(broken)
        broken = more
        if not grown:
            break
    twice = nodes.where("makes is not null").join(first.select(key, "kind", "pos", F.lit(True).alias("is_first")), [key, "kind", "pos"], "left").where(
        "is_first is null").select(key, "kind", "pos", F.lit(True).alias("twice"))
    told = nodes.join(layers, [key, "kind", "pos"], "left").join(lacks, [key, "kind", "pos"], "left").join(
        broken.withColumn("broken", F.lit(True)), [key, "kind", "pos"], "left").join(twice, [key, "kind", "pos"], "left")
    problem = (F.when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown input: "), "unknown"))
               .when(F.col("broken"), F.concat(F.lit("waits for: "), "waits")).when(F.col("waits").isNotNull(), F.lit("cycle"))
               .when(F.col("twice"), F.lit("made twice")))
    return told.select(key, "kind", "pos", "name", "makes", F.col("layer").cast("bigint").alias("layer"), problem.alias("problem"))


def custom_step(logic: str) -> dict:
    """Custom logic as a derive step; only one new column from columns of the same row can be said in it."""
    found = _LOGIC.match(logic or "")
    if not found:
        raise ValueError(f"custom logic is not one new column: {logic!r}")
    expression = _COLUMN.sub(lambda m: f"`{m[1]}`", found[2]).replace("==", "=")
    return {"op": "derive", "column": found[1], "expression": expression}


def _step(t, name: str) -> dict:
    parameters, inputs = dict(t["parameters"] or {}), list(t["input_sources"] or [])
    if t["type"] not in OPERATIONS:
        raise ValueError(f"unknown transformation type {t['type']!r}")
    step = custom_step(parameters.get("logic")) if t["type"] == "custom" else {"op": t["type"]} | {
        p: parameters[p] for p in OPERATIONS[t["type"]] if p in parameters}
    if step["op"] == "join":
        step |= dict(zip(("left", "right"), inputs))
    elif inputs:
        step["input"] = inputs[0]
    return step | {"name": name}


def run_documents(spark: SparkSession, documents: DataFrame, key: str, sources: dict[str, DataFrame] | None = None) -> dict:
    """Run every document without problems: key -> {name: DataFrame}; outputs with a location are written.

    ``sources`` are frames that documents may name instead of a path (``connection_params.path``, with ``format``). A path
    that several documents read is read by one DataFrame, columns and filters being pushed down for each; steps of a
    document run in the order of their layers. Documents are control data (each becomes calls on DataFrames here); their
    data never come to the driver. A document that fails says so in its error, unless its ``error_handling`` is
    ``continue``: then it is left out.
    """
    planned = plan_documents(documents, key)
    bad = {r[0] for r in planned.where("problem is not null").select(key).distinct().collect()}
    order: dict = {}
    for r in planned.where("problem is null and kind = 'transformation'").orderBy(key, "layer", "pos").collect():
        order.setdefault(r[key], []).append(r["pos"])
    frames, done = {}, {}
    for d in documents.collect():
        if d[key] in bad:
            continue
        named = {}
        for s in d["data_sources"] or []:
            where = dict(s["connection_params"] or {})
            if sources and s["name"] in sources:
                named[s["name"]] = sources[s["name"]]
                continue
            at = (where.get("path"), where.get("format", "parquet"))
            frames.setdefault(at, None)
            if frames[at] is None:
                frames[at] = spark.read.format(at[1]).load(at[0])
            named[s["name"]] = frames[at]
        try:
            steps, last = [], next(iter(named), None)
            for pos in order.get(d[key], []):
                t = d["transformations"][pos]
                last = t["output_target"] or t["name"]
                steps.append(_step(t, last))
            if d["transformations"]:
                last = d["transformations"][-1]["output_target"] or d["transformations"][-1]["name"]
            for o in d["outputs"] or []:
                columns = o["schema"]["columns"] if o["schema"] else None
                steps.append({"op": "write", "input": last, "path": o["location"], "format": o["format"], "columns": columns})
            done[d[key]] = run_steps(spark, steps, named)
        except Exception:
            if not d["processing_config"] or d["processing_config"]["error_handling"] != "continue":
                raise
    return done
