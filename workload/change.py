"""Registered change-plan and edit queries with their SQL.

A customer is a run with one request text, an order a planned file, a line item a modification.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.operators import change
from corpuscope.operators.edits import apply_edits, delta_counts, edit_eligible, line_delta
from corpuscope.operators.requests import (
    classify_request,
    extract_files,
    mentions,
    missing_in_context,
    missing_mentions,
)
from workload.tables import CTES, sql, table


def lit(*parts):
    return F.concat(*[F.lit(p) if p.startswith(" ") or not p.isidentifier() else F.col(p) for p in parts])


def requests(spark, sf):
    key = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")
    text = (
        F.when(segment == "AUTOMOBILE", F.concat(F.lit("Migrate load_"), key, F.lit(".py and 'order_"), key,
                                                 F.lit(".py' to PySpark in all files")))
        .when(segment == "BUILDING", F.concat(F.lit("Add a config helper to util_"), key, F.lit(".py, build it quickly")))
        .when(segment == "FURNITURE", F.concat(F.lit('Fix the error in "main-'), key, F.lit('.py" please, update the src_'), key,
                                               F.lit(".py")))
        .when(segment == "HOUSEHOLD", F.lit("Optimize performance of flask and pandas jobs in the entire project"))
        .otherwise(F.concat(F.lit("Tell me about order "), key))
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), text.alias("text"))


CTES["requests"] = """
    SELECT c_custkey AS run_id, CASE c_mktsegment
        WHEN 'AUTOMOBILE' THEN 'Migrate load_' || c_custkey || '.py and ''order_' || c_custkey || '.py'' to PySpark in all files'
        WHEN 'BUILDING' THEN 'Add a config helper to util_' || c_custkey || '.py, build it quickly'
        WHEN 'FURNITURE' THEN 'Fix the error in "main-' || c_custkey || '.py" please, update the src_' || c_custkey || '.py'
        WHEN 'HOUSEHOLD' THEN 'Optimize performance of flask and pandas jobs in the entire project'
        ELSE 'Tell me about order ' || c_custkey END AS text
    FROM customer
"""

ROLES = ["config", "util", "load_data", "main", "test", "process", "misc"]


def plans(spark, sf):
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    status = F.col("o_orderstatus")
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("src/"), F.lower(status), F.lit("/"), role, F.lit("_"), F.col("o_orderkey") % 10, F.lit(".py")).alias("file_path"),
        F.when(rank.isin("1", "2"), "high").when(rank == "3", "medium").when(rank == "5", "low")
        .when(F.col("o_orderkey") % 2 == 0, "unspecified").alias("priority"),
        F.when(status == "F", "Migration").when(status == "O", "utility").alias("modification_type"),
        F.when(status != "P", status == "F").alias("needs_modification"),
        F.when(status == "F", F.array(F.lit("import pyspark"))).when(status == "O", F.array(F.lit("import numpy"), F.lit("import flask")))
        .when(rank == "1", F.array().cast("array<string>")).alias("new_dependencies"),
    )


CTES["plans"] = """
    SELECT o_custkey AS run_id, o_orderkey AS pos,
           'src/' || lower(o_orderstatus) || '/' || ['config', 'util', 'load_data', 'main', 'test', 'process', 'misc'][o_orderkey % 7 + 1]
           || '_' || (o_orderkey % 10) || '.py' AS file_path,
           CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium'
                WHEN o_orderpriority[1] = '5' THEN 'low' WHEN o_orderkey % 2 = 0 THEN 'unspecified' END AS priority,
           CASE o_orderstatus WHEN 'F' THEN 'Migration' WHEN 'O' THEN 'utility' END AS modification_type,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS needs_modification,
           CASE WHEN o_orderstatus = 'F' THEN 'import pyspark' WHEN o_orderstatus = 'O' THEN 'import numpy import flask'
                WHEN o_orderpriority[1] = '1' THEN '' END AS deps
    FROM orders
"""


def mods(spark, sf):
    items = table(spark, sf, "lineitem")
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = F.col("l_partkey").cast("string")
    flag = F.col("l_returnflag")
    why = F.col("l_partkey") % 5
    return items.join(owner, "l_orderkey").select(
        F.col("o_custkey").alias("run_id"),
        F.col("l_orderkey").alias("pos"),
        F.when(flag == "A", "add").when(flag == "R", "modify").otherwise("delete").alias("action"),
        F.when((F.col("l_linestatus") == "O") | (F.col("l_linenumber") > 1), F.concat(F.lit("old_"), part)).alias("old_code"),
        F.when(F.col("l_quantity") > 48, F.repeat(F.lit("x"), F.lit(501)))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("import pandas # "), part))
        .otherwise(F.concat(F.lit("df.flask_"), part)).alias("new_code"),
        F.when(why == 0, "Migrate to PySpark as the user asked").when(why == 1, "Add numpy").when(why == 2, "update per request")
        .when(why == 3, "convert").alias("explanation"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("src/mod_"), F.col("l_suppkey") % 3, F.lit(".py")))
        .when(F.col("l_linenumber") == 2, "").alias("file_path"),
    )


CTES["mods"] = """
    SELECT o_custkey AS run_id, l_orderkey AS pos,
           CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'modify' ELSE 'delete' END AS action,
           CASE WHEN l_linestatus = 'O' OR l_linenumber > 1 THEN 'old_' || l_partkey END AS old_code,
           CASE WHEN l_quantity > 48 THEN repeat('x', 501) WHEN l_linestatus = 'O' THEN 'import pandas # ' || l_partkey
                ELSE 'df.flask_' || l_partkey END AS new_code,
           CASE l_partkey % 5 WHEN 0 THEN 'Migrate to PySpark as the user asked' WHEN 1 THEN 'Add numpy'
                WHEN 2 THEN 'update per request' WHEN 3 THEN 'convert' END AS explanation,
           CASE WHEN l_linenumber > 2 THEN 'src/mod_' || (l_suppkey % 3) || '.py' WHEN l_linenumber = 2 THEN '' END AS file_path
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
"""


def request_classes(spark, sf):
    return classify_request(requests(spark, sf), "text").select("run_id", "query_type")


def any_sql(text, words):
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def class_sql(text):
    return f"""CASE WHEN {any_sql(text, ['migrate', 'convert', 'replace', 'upgrade'])} THEN 'migration'
        WHEN {any_sql(text, ['add', 'implement', 'create', 'build'])} THEN 'feature_addition'
        WHEN {any_sql(text, ['fix', 'bug', 'error', 'issue'])} THEN 'bug_fix'
        WHEN {any_sql(text, ['optimize', 'improve', 'performance'])} THEN 'optimization' ELSE 'general' END"""


REQUEST_CLASSES = sql(f"SELECT run_id, {class_sql('text')} AS query_type FROM requests")


def conversation_classes(spark, sf):
    turns = classify_request(table(spark, sf, "conversations"), "text")
    return turns.groupBy("role", "query_type").agg(F.count(F.lit(1)).alias("turns"))


CONVERSATION_CLASSES = f"""
    SELECT role, {class_sql('text')} AS query_type, count(*) AS turns FROM conversations GROUP BY ALL
"""
WORD_LISTS = {
    "technologies_mentioned": ["pandas", "pyspark", "numpy", "tensorflow", "pytorch", "flask", "django", "fastapi", "react",
                               "vue", "angular", "spark", "hadoop"],
    "priority_keywords": ["urgent", "critical", "important", "asap", "quickly", "slowly", "carefully"],
    "scope_indicators": ["all files", "entire project", "specific file", "only", "just", "complete", "partial"],
    "action_words": ["migrate", "convert", "add", "remove", "update", "modify", "create", "delete"],
}


def request_mentions(spark, sf):
    found = mentions(requests(spark, sf), "text")
    return found.select("run_id", *[F.array_join(c, ",").alias(c) for c in WORD_LISTS])


REQUEST_MENTIONS = sql("SELECT run_id, " + ", ".join(
    f"array_to_string(list_filter({words!r}, lambda w: contains(lower(text), w)), ',') AS {c}" for c, words in WORD_LISTS.items()
) + " FROM requests")


def aligned(spark, sf):
    return change.plan_entries(change.alignment(plans(spark, sf), mods(spark, sf), requests(spark, sf)))


def plan_alignment(spark, sf):
    return aligned(spark, sf).select(
        "run_id", "pos", "file_path", "priority", "modification_type", "needs_modification", "n_modifications",
        F.round("user_alignment_score", 6).alias("user_alignment_score"))


TECHS = ["pandas", "pyspark", "numpy", "flask", "django", "spark"]
ACTIONS = ["migrate", "convert", "add", "remove", "update"]


def alignment_sql():
    asked = {w: f"contains(t, '{w}')" for w in TECHS + ACTIONS}
    hit = {t: f"coalesce(bool_or(contains(lower(new_code), '{t}') OR contains(lower(coalesce(explanation, '')), '{t}')), false)" for t in TECHS}
    act = {a: f"coalesce(bool_or(contains(lower(coalesce(explanation, '')), '{a}')), false)" for a in ACTIONS}
    flags = ", ".join([f"{e} AS m_{t}" for t, e in hit.items()] + [f"{e} AS a_{a}" for a, e in act.items()])
    score = " + ".join(
        [f"CASE WHEN {asked[t]} AND m_{t} THEN 1.0::DOUBLE ELSE 0 END" for t in TECHS]
        + ["CASE WHEN deps <> '' AND (" + " OR ".join(
            f"({asked[p]} AND contains(lower(deps), '{p}'))" for p in ["pyspark", "pandas", "numpy"]) + ") THEN 1.0::DOUBLE ELSE 0 END"]
        + ["CASE WHEN intent THEN 0.5::DOUBLE ELSE 0 END"]
        + [f"CASE WHEN {asked[a]} AND a_{a} THEN 0.8::DOUBLE ELSE 0 END" for a in ACTIONS])
    checks = " + ".join(
        [f"{asked[w]}::INT" for w in TECHS + ACTIONS] + ["(coalesce(deps, '') <> '')::INT", "1"])
    return f"""
    SELECT run_id, pos, file_path, coalesce(priority, 'medium') AS priority, coalesce(modification_type, 'general') AS modification_type,
           coalesce(needs_modification, true) AS needs_modification, n AS n_modifications,
           CASE WHEN n = 0 AND deps IS NULL THEN 0.5::DOUBLE ELSE least(({score}) / ({checks}), 1.0::DOUBLE) END AS user_alignment_score
    FROM (SELECT p.*, lower(r.text) AS t, coalesce(n, 0) AS n, {", ".join(f"coalesce(m_{t}, false) AS m_{t}" for t in TECHS)},
                 {", ".join(f"coalesce(a_{a}, false) AS a_{a}" for a in ACTIONS)}, coalesce(intent, false) AS intent
          FROM plans p JOIN requests r ON r.run_id = p.run_id LEFT JOIN (
              SELECT pos, count(*) AS n, {flags},
                     bool_or(contains(lower(coalesce(explanation, '')), 'user') OR contains(lower(coalesce(explanation, '')), 'request')) AS intent
              FROM mods GROUP BY pos) m ON m.pos = p.pos)"""


CTES["entries"] = alignment_sql()
PLAN_ALIGNMENT = sql("SELECT * REPLACE (round(user_alignment_score, 6) AS user_alignment_score) FROM entries")


def request_files(spark, sf):
    return extract_files(requests(spark, sf), "text", ["run_id"])


PATTERNS = [
    r"\b(\w+\.py)\b", r"""["'']([^"'']*\.py)["'']""", r"""\bin\s+(?:the\s+)?["'']?(\w+\.py)["'']?""",
    r"""\bmodify\s+(?:the\s+)?["'']?(\w+\.py)["'']?""", r"""\bfile\s+["'']?(\w+\.py)["'']?""",
    r"""\bcreate\s+(?:the\s+)?["'']?(\w+\.py)["'']?""", r"""\bupdate\s+(?:the\s+)?["'']?(\w+\.py)["'']?""",
]
CTES["mentioned"] = "SELECT DISTINCT run_id, file_name FROM (" + " UNION ALL ".join(
    f"SELECT run_id, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS file_name FROM requests" for p in PATTERNS
) + r") WHERE regexp_full_match(file_name, '[\w\-.]+\.py') AND length(file_name) > 3"
REQUEST_FILES = sql("SELECT * FROM mentioned")


def files_not_planned(spark, sf):
    planned = plans(spark, sf).withColumn("file_path", F.concat(F.lit("src/order_"), "run_id", F.lit(".py")))
    return missing_mentions(extract_files(requests(spark, sf), "text", ["run_id"]), planned, ["run_id"])


FILES_NOT_PLANNED = sql("""
    SELECT run_id, file_name FROM mentioned m
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = m.run_id AND 'order_' || o_custkey || '.py' = file_name)
""")


def files_not_in_context(spark, sf):
    known = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.concat(F.lit("Files: LOAD_"), "c_custkey", F.lit(".py, util_7.py "), "c_name").alias("context"))
    return missing_in_context(requests(spark, sf).join(known, "run_id"), "text", "context", ["run_id"])


FILES_NOT_IN_CONTEXT = sql("""
    SELECT run_id, file_name FROM mentioned JOIN customer ON c_custkey = run_id
    WHERE NOT contains(lower('Files: LOAD_' || c_custkey || '.py, util_7.py ' || c_name), lower(file_name))
""")


def target_files(spark, sf):
    rank = F.substring("o_orderpriority", 1, 1)
    status = F.col("o_orderstatus")
    empty = F.array().cast("array<string>")
    targets = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(rank == "1", "high").when(rank == "2", "medium").when(rank == "3", "low").when(rank == "4", "someday").alias("priority"),
        F.when(status == "F", F.array(F.concat(F.lit("file_"), "o_custkey"))).when(status == "O", empty).alias("depends_on"),
        F.when(rank == "5", F.array(F.lit("a.py"), F.lit("b.py"))).alias("affects"),
        F.lit(None).cast("array<string>").alias("imports_from"),
        empty.alias("imported_by"),
        F.when(rank == "2", "shared schema").alias("dependency_reason"),
    )
    prepared = change.prepare_targets(targets)
    deps = F.col("cross_file_dependencies")
    return prepared.select(
        "run_id", "pos", "priority", "target_position", deps.isNotNull().alias("has_dependencies"),
        F.array_join(deps.depends_on, ",").alias("depends_on"), F.array_join(deps.affects, ",").alias("affects"),
        F.array_join(deps.imports_from, ",").alias("imports_from"), deps.dependency_reason.alias("dependency_reason"),
    )


TARGET_FILES = """
    WITH t AS (
        SELECT o_custkey AS run_id, o_orderkey AS pos,
               CASE o_orderpriority[1] WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' WHEN '4' THEN 'someday'
                    ELSE 'medium' END AS priority,
               CASE WHEN o_orderstatus = 'F' THEN 'file_' || o_custkey ELSE '' END AS d,
               CASE WHEN o_orderpriority[1] = '5' THEN 'a.py,b.py' ELSE '' END AS a,
               CASE WHEN o_orderpriority[1] = '2' THEN 'shared schema' ELSE '' END AS r
        FROM orders)
    SELECT run_id, pos, priority,
           row_number() OVER (PARTITION BY run_id ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, pos)
               AS target_position,
           d || a || r <> '' AS has_dependencies, CASE WHEN d || a || r <> '' THEN d END AS depends_on,
           CASE WHEN d || a || r <> '' THEN a END AS affects, CASE WHEN d || a || r <> '' THEN '' END AS imports_from,
           CASE WHEN d || a || r <> '' THEN r END AS dependency_reason
    FROM t
"""


def plan_order(spark, sf):
    return change.execution_order(aligned(spark, sf), requests(spark, sf))


PLAN_ORDER = sql(r"""
    WITH asked AS (
        SELECT run_id, list_concat(list_filter(regexp_extract_all(lower(text), '\S+'), lambda w: length(w) > 3)[1:3],
            ['config', 'util', 'load', 'input', 'process', 'transform', 'output', 'write']) AS words FROM requests),
    ranked AS (
        SELECT e.run_id, pos, file_path, priority, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS p,
               coalesce(list_position(list_transform(words, lambda w: contains(lower(split_part(file_path, '/', -1)), w)), true), 1000) AS k,
               user_alignment_score AS s
        FROM entries e JOIN asked a ON a.run_id = e.run_id WHERE priority IN ('high', 'medium', 'low')),
    single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, file_path ORDER BY p, k, s DESC, pos) AS n FROM ranked) WHERE n = 1)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY p, k, s DESC, pos) AS execution_position, file_path, priority
    FROM single
""")


def plan_risks(spark, sf):
    found = change.risks(aligned(spark, sf), requests(spark, sf))
    return found.select("run_id", "risk")


CTES["facts"] = """
    SELECT run_id, count(*) AS n_files, count(*) FILTER (priority = 'high') AS high, sum(n_modifications)::BIGINT AS total,
           count(*) FILTER (user_alignment_score < 0.3) AS low, round(avg(user_alignment_score), 9) AS mean
    FROM entries GROUP BY run_id
"""
CTES["run_facts"] = """
    SELECT r.run_id, lower(text) AS t, coalesce(high, 0) AS high, coalesce(total, 0) AS total, coalesce(low, 0) AS low
    FROM requests r LEFT JOIN facts f ON f.run_id = r.run_id
"""
PLAN_RISKS = sql("""
    SELECT run_id, 'Multiple high-priority files require modification' AS risk FROM run_facts WHERE high > 2
    UNION ALL SELECT run_id, 'Large number of modifications detected' FROM run_facts WHERE total > 15
    UNION ALL SELECT run_id, 'Migration project detected - thorough testing recommended' FROM run_facts
        WHERE contains(t, 'migrate') OR contains(t, 'convert')
    UNION ALL SELECT run_id, 'Big data/ML framework integration - performance testing needed' FROM run_facts
        WHERE contains(t, 'pyspark') OR contains(t, 'tensorflow') OR contains(t, 'pytorch')
    UNION ALL SELECT run_id, 'Project-wide changes requested - staged rollout recommended' FROM run_facts
        WHERE contains(t, 'entire project') OR contains(t, 'all files')
    UNION ALL SELECT run_id, 'Performance optimization requested - benchmark testing required' FROM run_facts
        WHERE contains(t, 'performance') OR contains(t, 'optimize')
    UNION ALL SELECT run_id, 'Low user query alignment detected in ' || low || ' files' FROM run_facts WHERE low > 0
""")


def run_complexity(spark, sf):
    found = change.plan_complexity(aligned(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("avg_alignment", "complexity_score")})


RUN_COMPLEXITY = sql("""
    SELECT run_id, total AS total_modifications, high AS high_priority_files, round(mean, 6) AS avg_alignment,
           round(score, 6) AS complexity_score, CASE WHEN score > 25 THEN 'high' WHEN score > 10 THEN 'medium' ELSE 'low' END AS estimated_complexity
    FROM (SELECT *, round((total + 5 * high) * CASE WHEN mean > 0.8 THEN 0.8::DOUBLE WHEN mean < 0.3 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
          FROM facts)
""")


def run_rollup(spark, sf):
    found = change.plan_rollup(aligned(spark, sf), requests(spark, sf))
    return found.withColumn("overall_alignment_score", F.round("overall_alignment_score", 6))


RUN_ROLLUP = sql("""
    SELECT r.run_id, coalesce(n_files, 0) AS n_files, round(coalesce(mean, 0), 6) AS overall_alignment_score, true AS backup_required
    FROM requests r LEFT JOIN facts f ON f.run_id = r.run_id
""")


def plan_file_roles(spark, sf):
    return change.file_roles(plans(spark, sf), "file_path").select(
        "run_id", "pos", "file_path", "file_type", "potential_impact", "dependency_hint")


def role_sql(name):
    return f"""CASE WHEN contains({name}, 'config') OR contains({name}, 'setting') THEN 'configuration'
        WHEN contains({name}, 'util') OR contains({name}, 'helper') THEN 'utility'
        WHEN contains({name}, 'main') OR contains({name}, 'app') THEN 'main_application'
        WHEN contains({name}, 'test') THEN 'test'
        WHEN contains({name}, 'data') OR contains({name}, 'load') THEN 'data_processing' ELSE 'general' END"""


IMPACT = """CASE file_type WHEN 'configuration' THEN 'High - affects entire application' WHEN 'utility' THEN 'Medium - affects dependent modules'
    WHEN 'main_application' THEN 'High - affects application execution' WHEN 'test' THEN 'Low - affects testing only'
    WHEN 'data_processing' THEN 'Medium - affects data flow' ELSE 'Medium - standard impact' END AS potential_impact"""


def hint_sql(name, shown):
    return f"""CASE WHEN contains({name}, 'config') THEN {shown} || ' - configuration dependency'
        WHEN contains({name}, 'util') THEN {shown} || ' - utility dependency'
        WHEN contains({name}, 'main') THEN {shown} || ' - main execution dependency'
        WHEN contains({name}, 'load') THEN {shown} || ' - data loading dependency' END AS dependency_hint"""


PLAN_FILE_ROLES = sql(f"""
    SELECT run_id, pos, file_path, file_type, {IMPACT}, {hint_sql('name', 'name')}
    FROM (SELECT *, {role_sql('name')} AS file_type FROM (SELECT *, split_part(file_path, '/', -1) AS name FROM plans))
""")


def page_roles(spark, sf):
    return change.file_roles(table(spark, sf, "pages"), "url").select(
        "page_id", "file_type", "potential_impact", "dependency_hint")


PAGE_ROLES = f"""
    SELECT page_id, file_type, {IMPACT}, {hint_sql('lower(name)', 'name')}
    FROM (SELECT *, {role_sql('lower(name)')} AS file_type FROM (SELECT *, split_part(rtrim(url, '/'), '/', -1) AS name FROM pages))
"""


def grouped_mods(spark, sf):
    shared = requests(spark, sf).select("run_id", F.concat(F.lit("test "), "run_id").alias("testing_suggestions"))
    rows = change.group_mods(mods(spark, sf), plans(spark, sf), shared)
    return rows.select("run_id", "file_path", "pos", "action", "old_code", "testing_suggestions")


CTES["grouped"] = """
    SELECT m.* REPLACE (coalesce(nullif(m.file_path, ''), first_path) AS file_path)
    FROM mods m LEFT JOIN (SELECT run_id, arg_min(file_path, pos) AS first_path FROM plans GROUP BY run_id) p ON p.run_id = m.run_id
"""
GROUPED_MODS = sql("SELECT run_id, file_path, pos, action, old_code, 'test ' || run_id AS testing_suggestions FROM grouped")


def mod_counts(spark, sf):
    return change.mods_per_file(change.group_mods(mods(spark, sf), plans(spark, sf)))


MOD_COUNTS = sql("""
    SELECT run_id, file_path, count(*) AS n_modifications, count(*) FILTER (action = 'add') AS n_add,
           count(*) FILTER (action = 'modify') AS n_modify, count(*) FILTER (action = 'delete') AS n_delete
    FROM grouped GROUP BY run_id, file_path
""")


def direct_edits(spark, sf):
    return edit_eligible(mods(spark, sf), ["run_id", "pos"])


CTES["fit"] = """
    SELECT run_id, pos, count(*) AS n_modifications,
           NOT bool_or((action IN ('modify', 'delete') AND coalesce(old_code, '') = '') OR (action = 'add' AND length(new_code) > 500)) AS eligible
    FROM mods GROUP BY run_id, pos
"""
DIRECT_EDITS = sql("SELECT * FROM fit")


def results(spark, sf):
    applied = F.when(F.col("eligible"), F.col("n_modifications")).alias("modifications_applied")
    files = plans(spark, sf).select("run_id", "pos", "file_path")
    return files.join(edit_eligible(mods(spark, sf), ["run_id", "pos"]), ["run_id", "pos"], "left").select("run_id", "file_path", applied)


def run_results(spark, sf):
    return change.generation_summary(results(spark, sf))


CTES["results"] = """
    SELECT p.run_id, file_path, CASE WHEN eligible THEN n_modifications END AS applied
    FROM plans p LEFT JOIN fit f ON f.pos = p.pos
"""
RUN_RESULTS = sql("""
    SELECT run_id, count(*) = count(applied) AS success, coalesce(sum(applied), 0)::BIGINT AS total_modifications,
           count(applied) AS modified_files, count(*) - count(applied) AS failed_files FROM results GROUP BY run_id
""")


def run_failures(spark, sf):
    return change.failed_files(results(spark, sf))


RUN_FAILURES = sql("SELECT run_id, file_path, 'Failed to process file: ' || file_path AS error FROM results WHERE applied IS NULL")

FIRST_WORD = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"


def document_edits(spark, sf):
    """Seven edits per document that is not French, among them some that cannot be applied for some documents, and edits of documents that are not there."""
    docs = table(spark, sf, "documents").where(F.col("lang") != "fr")
    word = F.regexp_extract("text", FIRST_WORD, 0)
    none = F.lit(None).cast("string")

    def edit(seq, action, line, old, new):
        return F.struct(F.lit(seq).alias("seq"), action.alias("action"), F.lit(line).cast("bigint").alias("line_number"),
                        old.alias("old_code"), new.alias("new_code"))

    edits = F.array(
        edit(0, F.lit("modify"), 0, F.concat(F.lit(" "), word), F.lit("EDITED ")),
        edit(1, F.lit("add"), 2, none, F.concat(F.lit("  added line "), "doc_id", F.lit("\n"))),
        edit(2, F.lit("add"), 1, none, F.lit("top")),
        edit(3, F.lit("delete"), 0, F.lit("tion "), none),
        edit(4, F.when(F.col("lang") == "es", "delete").otherwise("comment"), 0, F.lit(""), F.lit("x")),
        edit(5, F.lit("add"), 999999, none, F.lit("tail")),
        edit(6, F.lit("modify"), 0, F.lit("top"), F.lit("  ")),
    )
    lost = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.explode(F.slice(edits, 2, 1)).alias("e")).where("doc_id % 7 = 0")
    return docs.select("doc_id", F.explode(edits).alias("e")).unionByName(lost).select("doc_id", "e.*")


def edited_documents(spark, sf):
    return apply_edits(table(spark, sf, "documents"), document_edits(spark, sf), "doc_id", "text")


CTES["edited"] = rf"""
    SELECT doc_id, text, CASE WHEN lang = 'fr' THEN 'unchanged' WHEN lang = 'es' THEN 'ineligible' WHEN NOT contains(d, 'tion') THEN 'rejected' ELSE 'edited' END AS status,
           substr(d, 1, instr(d, 'tion') - 1) || substr(d, instr(d, 'tion') + 4) AS done
    FROM (SELECT *, substr(c, 1, instr(c, word) - 1) || 'EDITED' || substr(c, instr(c, word) + length(word)) AS d
          FROM (SELECT *, 'top' || chr(10) || b AS c
                FROM (SELECT *, substr(a, 1, instr(a, chr(10))) || 'added line ' || doc_id || substr(a, instr(a, chr(10))) AS b
                      FROM (SELECT *, text || chr(10) || 'tail' AS a, regexp_extract(text, '{FIRST_WORD}') AS word FROM documents))))
"""
EDITED_DOCUMENTS = sql("""
    SELECT doc_id, status, CASE status WHEN 'edited' THEN done WHEN 'unchanged' THEN text END AS text,
           CASE WHEN status = 'edited' THEN 5 ELSE 0 END::BIGINT AS edits_applied, CASE WHEN status = 'edited' THEN 2 ELSE 0 END::BIGINT AS edits_skipped
    FROM edited
    UNION ALL SELECT -doc_id - 1, 'missing_document', NULL, 0, 0 FROM documents WHERE lang <> 'fr' AND (doc_id + 1) % 7 = 0
""")


def versions(spark, sf):
    """Every document before and after; where the edits were not applied the text stays."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = edited_documents(spark, sf).select("doc_id", F.col("text").alias("done"))
    return docs.join(done, "doc_id").select("doc_id", "text", F.coalesce("done", "text").alias("new_text"))


def document_delta(spark, sf):
    return line_delta(versions(spark, sf), "doc_id", "text", "new_text")


BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'"


def lines_sql(column):
    return f"""SELECT doc_id, generate_subscripts(parts, 1)::BIGINT AS line_no, unnest(parts) AS line FROM (
        SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts
        FROM (SELECT doc_id, regexp_split_to_array({column}, {BREAK}) AS p FROM edited))"""


CTES["old_lines"] = lines_sql("text")
CTES["new_lines"] = lines_sql("CASE status WHEN 'edited' THEN done ELSE text END")
CTES["delta"] = """
    SELECT n.doc_id, line_no, CASE WHEN seen > coalesce(had, 0) THEN '+' ELSE ' ' END AS flag, n.line
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS seen FROM new_lines) n
    LEFT JOIN (SELECT doc_id, line, count(*) AS had FROM old_lines GROUP BY doc_id, line) o ON o.doc_id = n.doc_id AND o.line = n.line
"""
DOCUMENT_DELTA = sql("SELECT * FROM delta")


def document_delta_counts(spark, sf):
    return delta_counts(versions(spark, sf), "doc_id", "text", "new_text")


DOCUMENT_DELTA_COUNTS = sql("""
    SELECT d.doc_id, added, unchanged, o.n - unchanged AS removed
    FROM (SELECT doc_id, count(*) FILTER (flag = '+') AS added, count(*) FILTER (flag = ' ') AS unchanged FROM delta GROUP BY doc_id) d
    JOIN (SELECT doc_id, count(*) AS n FROM old_lines GROUP BY doc_id) o ON o.doc_id = d.doc_id
""")

QUERIES = {
    "classify_request": (request_classes, REQUEST_CLASSES),
    "conversation_classes": (conversation_classes, CONVERSATION_CLASSES),
    "mentions": (request_mentions, REQUEST_MENTIONS),
    "alignment": (plan_alignment, PLAN_ALIGNMENT),
    "extract_files": (request_files, REQUEST_FILES),
    "missing_mentions": (files_not_planned, FILES_NOT_PLANNED),
    "missing_in_context": (files_not_in_context, FILES_NOT_IN_CONTEXT),
    "prepare_targets": (target_files, TARGET_FILES),
    "execution_order": (plan_order, PLAN_ORDER),
    "risks": (plan_risks, PLAN_RISKS),
    "plan_complexity": (run_complexity, RUN_COMPLEXITY),
    "plan_rollup": (run_rollup, RUN_ROLLUP),
    "file_roles": (plan_file_roles, PLAN_FILE_ROLES),
    "page_roles": (page_roles, PAGE_ROLES),
    "group_mods": (grouped_mods, GROUPED_MODS),
    "mods_per_file": (mod_counts, MOD_COUNTS),
    "edit_eligible": (direct_edits, DIRECT_EDITS),
    "generation_summary": (run_results, RUN_RESULTS),
    "failed_files": (run_failures, RUN_FAILURES),
    "apply_edits": (edited_documents, EDITED_DOCUMENTS),
    "line_delta": (document_delta, DOCUMENT_DELTA),
    "delta_counts": (document_delta_counts, DOCUMENT_DELTA_COUNTS),
}
