"""Registered step, config, ledger and source-tree queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.plans.documents import plan_documents, run_documents
from corpuscope.plans.steps import batch_steps, check_steps, resolve_tables, run_steps
from corpuscope.session import shared_dir
from corpuscope.sources.ledger import append_ledger, read_ledger
from corpuscope.sources.tree import read_config, scan_sources
from workload.tables import CTES, sql, table


def known_tables(spark, sf):
    """Requested names are the kinds of the events, known ones those of the larger purchases and signups."""
    requested = table(spark, sf, "events").select("event_id", F.col("event_type").alias("table_name"))
    known = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup", "view")).select(
        F.col("event_type").alias("table_name"))
    return resolve_tables(requested, known).select("event_id", "table_name", "path")


KNOWN_TABLES = """
    SELECT event_id, event_type AS table_name, './examples/' || event_type || '.json' AS path FROM events
    WHERE event_type IN ('purchase', 'signup', 'view')
"""

OPS = ["read", "filter", "join", "custom_sql", "derive", "write", "drop_all"]


def step_rows(spark, sf):
    """An order is a config, its line items are steps with some parameters."""
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("l_partkey") % 7 + 1).cast("int"))
    given = F.map_concat(
        F.create_map(F.lit("input"), F.lit("t"), F.lit("path"), F.when(F.col("l_linestatus") == "O", "p").otherwise("  ")),
        F.when(F.col("l_returnflag") == "A",
               F.create_map(F.lit("condition"), F.lit("x > 1"), F.lit("left"), F.lit("a"), F.lit("right"), F.lit("b"),
                            F.lit("sql"), F.lit("SELECT 1")))
        .otherwise(F.create_map(F.lit("format"), F.lit("csv"), F.lit("on"), F.lit("id"), F.lit("column"), F.lit("c"))),
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("config_id"), F.col("l_partkey").alias("pos"), "l_linenumber", op.alias("op"), given.alias("params"))


def step_problems(spark, sf):
    return check_steps(step_rows(spark, sf), ["config_id", "pos", "l_linenumber"])


STEP_PROBLEMS = """
    WITH required(op, param) AS (VALUES ('read', 'path'), ('read', 'format'), ('filter', 'input'), ('filter', 'condition'), ('join', 'left'),
        ('join', 'right'), ('join', 'on'), ('join', 'how'), ('custom_sql', 'sql'), ('derive', 'input'), ('derive', 'column'),
        ('derive', 'expression'), ('write', 'input'), ('write', 'path'), ('write', 'format')),
    steps AS (
        SELECT l_orderkey AS config_id, l_partkey AS pos, l_linenumber,
               ['read', 'filter', 'join', 'custom_sql', 'derive', 'write', 'drop_all'][l_partkey % 7 + 1] AS op,
               list_concat(['input'], list_concat(CASE WHEN l_linestatus = 'O' THEN ['path'] ELSE [] END,
                   CASE WHEN l_returnflag = 'A' THEN ['condition', 'left', 'right', 'sql'] ELSE ['format', 'on', 'column'] END)) AS given
        FROM lineitem)
    SELECT config_id, pos, l_linenumber, s.op, 'missing ' || param AS problem FROM steps s JOIN required r ON r.op = s.op
    WHERE NOT list_contains(given, param)
    UNION ALL SELECT config_id, pos, l_linenumber, op, 'unknown operation' FROM steps WHERE op = 'drop_all'
"""


def step_batches(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("turn", "pos")
    return batch_steps(turns, 3, keys=["conv_id"]).groupBy("conv_id", "batch").agg(
        F.count(F.lit(1)).alias("steps"), F.min("pos").alias("first_pos"))


STEP_BATCHES = """
    SELECT conv_id, batch, count(*) AS steps, min(turn) AS first_pos FROM (
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch, turn FROM conversations)
    GROUP BY ALL
"""


def declared(sf, *steps):
    reads = [{"op": "read", "name": t, "path": f"{sf}/{t}.parquet", "format": "parquet"}
             for t in ("orders", "customer", "nation")]
    return [*reads, *steps]


def read_filter(spark, sf):
    """read and filter."""
    frames = run_steps(spark, declared(sf, {
        "op": "filter", "name": "big", "input": "orders", "condition": "o_totalprice > 300000 AND o_orderstatus = 'F'"}))
    return frames["big"]


READ_FILTER = "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'"


def joined(spark, sf, how):
    return run_steps(spark, declared(
        sf,
        {"op": "custom_sql", "name": "c", "sql": "SELECT c_custkey AS key, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0"},
        {"op": "custom_sql", "name": "o", "sql": "SELECT o_custkey AS key, o_orderkey, o_totalprice FROM orders"},
        {"op": "join", "name": "out", "left": "o", "right": "c", "on": "key", "how": how},
    ))["out"]


def join_inner(spark, sf):
    return joined(spark, sf, "inner")


def join_left(spark, sf):
    return joined(spark, sf, "left")


def join_right(spark, sf):
    return joined(spark, sf, "right")


def join_full(spark, sf):
    return joined(spark, sf, "full")


def join_semi(spark, sf):
    return joined(spark, sf, "semi")


def join_anti(spark, sf):
    return joined(spark, sf, "anti")


CTES["step_c"] = "SELECT c_custkey AS key, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0"
CTES["step_o"] = "SELECT o_custkey AS key, o_orderkey, o_totalprice FROM orders"
JOINS = {h: sql(f"SELECT * FROM step_o {h.upper()} JOIN step_c USING (key)") for h in ("inner", "left", "right", "full", "semi", "anti")}


def step_sql(spark, sf):
    """custom_sql over the named results."""
    return run_steps(spark, declared(sf, {
        "op": "custom_sql", "name": "totals", "sql": """
            SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""}))["totals"]


STEP_SQL = """
    SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
"""


def derived_flag(spark, sf):
    """A passed flag written as a declared column list and read back."""
    out = shared_dir(spark, "steps")
    run_steps(spark, declared(
        sf,
        {"op": "derive", "name": "flagged", "input": "customer", "column": "passed", "expression": "c_acctbal > 800"},
        {"op": "write", "input": "flagged", "path": out, "format": "parquet", "columns": ["c_custkey", "c_name", "passed"]},
    ))
    return run_steps(spark, [{"op": "read", "name": "back", "path": out, "format": "parquet"}])["back"]


DERIVED_FLAG = "SELECT c_custkey, c_name, c_acctbal > 800 AS passed FROM customer"


def step_chain(spark, sf):
    """filter, join, derive and write in one chain."""
    out = shared_dir(spark, "steps")
    run_steps(spark, declared(
        sf,
        {"op": "filter", "name": "open", "input": "orders", "condition": "o_orderstatus = 'O'"},
        {"op": "custom_sql", "name": "keyed", "sql": "SELECT *, o_custkey AS c_custkey FROM open"},
        {"op": "join", "name": "both", "left": "keyed", "right": "customer", "on": ["c_custkey"], "how": "inner"},
        {"op": "derive", "name": "scored", "input": "both", "column": "passed", "expression": "o_totalprice > 10 * c_acctbal"},
        {"op": "write", "input": "scored", "path": out, "format": "parquet", "columns": ["o_orderkey", "c_name", "passed"]},
    ))
    return spark.read.parquet(out)


STEP_CHAIN = """
    SELECT o_orderkey, c_name, o_totalprice > 10 * c_acctbal AS passed FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'O'
"""


def ledger_entries(spark, sf):
    """Passed orders appended to the ledger and read back."""
    out = shared_dir(spark, "ledger")
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("user"), F.col("o_custkey") % 10).alias("user_id"),
        (F.col("o_orderstatus") == "F").alias("code_validator_success"),
        F.col("o_orderdate").cast("timestamp").alias("saved_at"),
        F.col("o_orderdate").cast("timestamp").alias("ordered"), "o_orderkey", "o_orderpriority")
    append_ledger(runs, out)
    return read_ledger(spark, out).select("user_id", "timestamp", "saved_at", "validation_status", "bot_state")


LEDGER_ENTRIES = """
    SELECT 'user' || (o_custkey % 10) AS user_id, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS timestamp,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS saved_at, 'PASSED' AS validation_status,
           '{"code_validator_success":true,"ordered":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderkey":' || o_orderkey
           || ',"o_orderpriority":"' || o_orderpriority || '"}' AS bot_state
    FROM orders WHERE o_orderstatus = 'F'
"""


def source_tree(spark, sf):
    """Documents written as text files per source, scanned as a tree, summed per folder."""
    out = shared_dir(spark, "tree")
    table(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(out)
    files = scan_sources(spark, out, [".txt"])
    folder = F.regexp_extract("file_path", "source=([^/]+)/", 1)
    return files.groupBy(folder.alias("folder")).agg(
        F.sum("size").alias("bytes"), F.sum(F.length("content")).alias("chars"),
        F.min("is_python").alias("is_python"), F.min("extension").alias("extension"),
        F.max("content_status").alias("content_status"))


SOURCE_TREE = """
    SELECT source AS folder, sum(strlen(text) + 1)::BIGINT AS bytes, sum(length(text) + 1)::BIGINT AS chars, false AS is_python,
           '.txt' AS extension, 'text' AS content_status
    FROM documents GROUP BY source
"""


def config_documents(spark, sf):
    """A config document per document source, written and read with the fixed schema."""
    out = shared_dir(spark, "configs")
    langs = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    # A document source has as many entries as languages.
    listed = langs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("langs"), F.sum("n").alias("n"))

    def step(x):
        return F.struct(
            F.concat(F.lit("keep_"), x["lang"]).alias("name"), F.lit("custom").alias("type"),
            F.create_map(F.lit("rows"), x["n"].cast("string")).alias("parameters"),
            F.array("source").alias("input_sources"), F.lit("out").alias("output_target"))

    configs = listed.select(
        "source",
        F.array(F.struct(F.col("source").alias("name"), F.lit("file").alias("type"),
                         F.create_map(F.lit("path"), F.col("source")).alias("connection_params"))).alias("data_sources"),
        F.transform("langs", step).alias("transformations"),
        F.struct(F.col("n").cast("int").alias("batch_size"), F.lit(False).alias("parallel_processing")).alias("processing_config"),
    )
    configs.repartition("source").write.partitionBy("source").json(out)
    read = read_config(spark, f"{out}/*")
    return read.select(
        F.col("data_sources")[0]["name"].alias("source"),
        F.col("processing_config.batch_size").cast("bigint").alias("batch_size"),
        F.col("processing_config.parallel_processing").alias("parallel"),
        F.array_join(F.transform("transformations", lambda t: F.concat(t["name"], F.lit("="), t["parameters"]["rows"])), ",").alias("steps"),
    )


CONFIG_DOCUMENTS = """
    SELECT source, sum(n)::BIGINT AS batch_size, false AS parallel, string_agg('keep_' || lang || '=' || n, ',' ORDER BY lang) AS steps
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source
"""


def order_documents(spark, sf, out):
    """A config document per order status: two sources, a join, a filter and a flag, declared last step first."""
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    def source(name):
        return F.struct(F.lit(name).alias("name"), F.lit("file").alias("type"), F.create_map(F.lit("path"), F.lit(f"{sf}/{name}.parquet")).alias("connection_params"))

    def step(name, kind, inputs, target, **parameters):
        pairs = [x for k, v in parameters.items() for x in (F.lit(k), text(v))]
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.create_map(*pairs).alias("parameters"),
                        F.array(*[F.lit(i) for i in inputs]).alias("input_sources"), F.lit(target).alias("output_target"))

    status = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("doc")).distinct()
    docs = status.select(
        "doc", F.array(source("orders"), source("customer")).alias("data_sources"),
        F.array(step("flag", "custom", ["both"], "flagged", logic="df['passed'] = df['o_totalprice'] > 10 * df['c_acctbal']"),
                step("both", "join", ["keyed", "customer"], "both", on="c_custkey", how="inner"),
                step("key", "derive", ["own"], "keyed", column="c_custkey", expression="o_custkey"),
                step("own", "filter", ["orders"], "own", condition=F.concat(F.lit("o_orderstatus = '"), "doc", F.lit("'"))),
                ).alias("transformations"))
    docs.repartition("doc").write.partitionBy("doc").json(out)
    return read_config(spark, out)


def run_order_documents(spark, sf):
    """Every document run from the table of documents; their flagged orders side by side."""
    done = run_documents(spark, order_documents(spark, sf, shared_dir(spark, "documents")), "doc")
    return reduce(DataFrame.unionByName, [
        frames["flagged"].select(F.lit(doc).alias("doc"), "o_orderkey", "c_name", "passed") for doc, frames in sorted(done.items())])


RUN_DOCUMENTS = """
    SELECT o_orderstatus AS doc, o_orderkey, c_name, o_totalprice > 10 * c_acctbal AS passed FROM orders JOIN customer ON c_custkey = o_custkey
"""


def conversation_documents(spark, sf):
    """Conversations as documents: turn n needs turn n - 1, the last needs turn 99, system turns are sources."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("turns"))
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    last = F.element_at("turns", -1)
    steps = F.transform(F.slice("turns", 2, 1 << 20), lambda t: F.struct(
        name(t).alias("name"), F.lit("custom").alias("type"), F.lit(None).cast("map<string,string>").alias("parameters"),
        F.array(F.when((t == last) & (F.col("conv_id") % 3 == 0), F.lit("t99")).otherwise(
            F.when((t == last) & (F.col("conv_id") % 3 == 1), name(t)).otherwise(name(t - 1)))).alias("input_sources"),
        F.lit(None).cast("string").alias("output_target")))
    first = F.struct(name(F.element_at("turns", 1)).alias("name"), F.lit("file").alias("type"),
                     F.lit(None).cast("map<string,string>").alias("connection_params"), F.lit(None).cast("array<string>").alias("tables_or_files"))
    outputs = F.lit(None).cast("array<struct<name:string,type:string,format:string,location:string,schema:struct<columns:array<string>>>>")
    docs = turns.select("conv_id", F.array(first).alias("data_sources"), steps.alias("transformations"), outputs.alias("outputs"))
    return plan_documents(docs, "conv_id").select("conv_id", "kind", "name", "layer", "problem")


PLAN_DOCUMENTS = """
    WITH t AS (SELECT conv_id, turn, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                      turn - row_number() OVER w = min(turn) OVER (PARTITION BY conv_id) - 1 AS joined
               FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, min(CASE WHEN NOT joined THEN turn END) OVER (PARTITION BY conv_id) AS gap,
                 CASE WHEN i > 0 AND i = n - 1 AND conv_id % 3 = 0 THEN 't99' WHEN i > 0 AND i = n - 1 AND conv_id % 3 = 1 THEN 't' || turn
                      WHEN i > 0 THEN 't' || (turn - 1) END AS need FROM t),
    k AS (SELECT s.*, need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = s.conv_id AND 't' || t.turn = need) AS unknown FROM s)
    SELECT conv_id, CASE WHEN i = 0 THEN 'source' ELSE 'transformation' END AS kind, 't' || turn AS name,
           CASE WHEN problem IS NULL THEN i END AS layer, problem
    FROM (SELECT *, CASE WHEN unknown THEN 'unknown input: ' || need WHEN i > 0 AND i = n - 1 AND conv_id % 3 = 1 THEN 'cycle'
                         WHEN i > 0 AND gap IS NOT NULL AND turn >= gap THEN 'waits for: ' || need END AS problem FROM k)
"""

QUERIES = {
    "resolve_tables": (known_tables, KNOWN_TABLES),
    "check_steps": (step_problems, STEP_PROBLEMS),
    "batch_steps": (step_batches, STEP_BATCHES),
    "step_read_filter": (read_filter, READ_FILTER),
    "step_join_inner": (join_inner, JOINS["inner"]),
    "step_join_left": (join_left, JOINS["left"]),
    "step_join_right": (join_right, JOINS["right"]),
    "step_join_full": (join_full, JOINS["full"]),
    "step_join_semi": (join_semi, JOINS["semi"]),
    "step_join_anti": (join_anti, JOINS["anti"]),
    "step_custom_sql": (step_sql, STEP_SQL),
    "step_derive_write": (derived_flag, DERIVED_FLAG),
    "step_chain": (step_chain, STEP_CHAIN),
    "ledger": (ledger_entries, LEDGER_ENTRIES),
    "scan_sources": (source_tree, SOURCE_TREE),
    "read_config": (config_documents, CONFIG_DOCUMENTS),
    "run_documents": (run_order_documents, RUN_DOCUMENTS),
    "plan_documents": (conversation_documents, PLAN_DOCUMENTS),
}
