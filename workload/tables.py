"""Driver tables bound to the shapes the operators work on, in Spark and as SQL for the check.

Every binding covers its whole tables. ``CTES`` holds the same binding as SQL text; ``sql`` puts the ones a
query needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import configure, passes_for, staged_parts
from corpuscope.sources.artifacts import as_artifacts

CTES: dict[str, str] = {}


def sql(body: str) -> str:
    """The body with the common table expressions it refers to, directly or through others."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text):
        for name in CTES:
            if name in open_names or not re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                continue
            open_names.add(name)
            visit(CTES[name])
            needed.append(name)

    visit(body)
    if not needed:
        return body
    own = body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    if own.upper().startswith("WITH "):
        return f"WITH {head},\n{own[5:]}"
    return f"WITH {head}\n{own}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- artifacts: documents are files, pages classes, parts functions -------------------------------------------

def with_vectors(spark, sf, df, key, wanted) -> DataFrame:
    """Rows with the embedding of the same number; text operators do not ask for it."""
    if not wanted:
        return df
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding")
    return df.join(vectors, key, "left")


def embedding(wanted):
    return ["embedding"] if wanted else []


def file_artifacts(spark, sf, vectors=True) -> DataFrame:
    docs = table(spark, sf, "documents")
    return as_artifacts(
        with_vectors(spark, sf, docs, "doc_id", vectors).select(
            F.concat(F.lit("repo"), F.col("doc_id") % 5).alias("repo_id"),
            F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"),
            F.col("lang").alias("programming_language"),
            F.col("text").alias("enhanced_content"),
            F.col("text").alias("original_content"),
            F.col("lang").alias("rich_metadata"),
            *embedding(vectors),
        ),
        "file",
    )


def class_artifacts(spark, sf, vectors=True) -> DataFrame:
    pages = table(spark, sf, "pages")
    return as_artifacts(
        with_vectors(spark, sf, pages, "page_id", vectors).select(
            F.concat(F.lit("repo"), F.col("page_id") % 5).alias("repo_id"),
            F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("file_path"),
            F.col("url").alias("class_name"),
            F.col("html").alias("enhanced_content"),
            F.col("html").alias("original_content"),
            F.lit("").alias("rich_metadata"),
            *embedding(vectors),
        ),
        "class",
    )


def function_artifacts(spark, sf, vectors=True) -> DataFrame:
    parts = table(spark, sf, "part")
    text = F.concat("p_name", F.lit(" "), "p_type")
    return as_artifacts(
        with_vectors(spark, sf, parts, "p_partkey", vectors).select(
            F.concat(F.lit("repo"), F.col("p_partkey") % 5).alias("repo_id"),
            F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")),
                     F.lit(".py")).alias("file_path"),
            # Parts of one brand and type share a file, and some of those a name: their number tells them apart.
            F.col("p_name").alias("function_name"),
            F.col("p_brand").alias("parent_class"),
            F.col("p_partkey").alias("position"),
            text.alias("enhanced_content"),
            text.alias("original_content"),
            F.col("p_type").alias("rich_metadata"),
            *embedding(vectors),
        ),
        "function",
    )


def levels(spark, sf, vectors=True) -> dict[str, DataFrame]:
    return {
        "file": file_artifacts(spark, sf, vectors),
        "class": class_artifacts(spark, sf, vectors),
        "function": function_artifacts(spark, sf, vectors),
    }


def text_levels(spark, sf) -> dict[str, DataFrame]:
    """The levels without embeddings."""
    return levels(spark, sf, vectors=False)


CTES["artifacts"] = """
    SELECT 'file' AS type, 1 AS level, 'repo' || (doc_id % 5) AS repo_id, source || '/' || doc_id || '.txt' AS file_path,
           source || '/' || doc_id || '.txt' AS name, '' AS parent_class, 0::BIGINT AS position, text AS content, lang AS rich_metadata, embedding
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id
    UNION ALL
    SELECT 'class', 2, 'repo' || (page_id % 5), 'pages/' || page_id || '.html', url, '', 0, html, '', embedding
    FROM pages LEFT JOIN embeddings ON vec_id = page_id
    UNION ALL
    SELECT 'function', 3, 'repo' || (p_partkey % 5),
           'parts/' || lower(p_type) || '/' || replace(p_brand, '#', '') || '.py', p_name,
           p_brand, p_partkey, p_name || ' ' || p_type, p_type, embedding
    FROM part LEFT JOIN embeddings ON vec_id = p_partkey
"""


# --- query vectors: the mean vector of every label ------------------------------------------------------------

def label_centroids(spark, sf) -> DataFrame:
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    # One entry per dimension, so each group is as long as a vector.
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("cells"))
    return ordered.select(F.col("label").cast("bigint").alias("query_id"), F.col("cells.m").alias("embedding"))


CTES["cells"] = """
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings
"""
CTES["query_vectors"] = """
    SELECT label::BIGINT AS query_id, list(m ORDER BY dim) AS q
    FROM (SELECT label, dim, round(avg(x), 6) AS m FROM cells GROUP BY label, dim) GROUP BY label
"""
CTES["near"] = """
    SELECT query_id, type, level, repo_id, file_path, name, parent_class, position,
           round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9) + 0.0 AS distance
    FROM artifacts, query_vectors WHERE embedding IS NOT NULL
"""


# --- rankings: labelled documents as scored candidate positions -------------------------------------------------

def rankings(spark, sf) -> DataFrame:
    relevance = F.lit(1.0) + (F.col("doc_id") * 7) % 10
    index = F.floor(F.col("doc_id") / 10)
    return table(spark, sf, "labels").select(
        (F.col("doc_id") % 10).alias("query_id"),
        ((F.lit(10.0) - relevance) * 1000000000 + index).cast("bigint").alias("pos"),
        index.alias("index"),
        relevance.alias("relevance"),
        F.concat(F.lit("quality "), "quality").alias("reason"),
    )


CTES["rankings"] = """
    SELECT doc_id % 10 AS query_id, doc_id // 10 AS idx, 1.0 + (doc_id * 7) % 10 AS relevance,
           ((10.0 - (1.0 + (doc_id * 7) % 10)) * 1000000000 + doc_id // 10)::BIGINT AS pos,
           'quality ' || quality AS reason
    FROM labels
"""


# --- source files: an order is a file, its line items are code lines; parts are the API it calls ----------------

def of_part(df, key, part, parts) -> DataFrame:
    """The rows whose key falls in a part."""
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(parts)) == part) if parts > 1 else df


def source_files(spark, sf, part=0, parts=1) -> DataFrame:
    """``order_key, customer_key, file_path, content``: up to a dozen code lines per order; of one of some parts of the orders."""
    orders = of_part(table(spark, sf, "orders"), "o_orderkey", part, parts)
    items = of_part(table(spark, sf, "lineitem"), "l_orderkey", part, parts)
    api = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("method"),
        F.concat(F.lit("pyspark."), F.lower("p_type"), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("owner"),
    )
    qty = F.col("l_quantity").cast("bigint").cast("string")
    kind = (F.col("l_partkey") + F.col("l_linenumber") + F.col("l_suppkey")) % 12
    templates = [
        F.concat(F.lit("x = df."), "method", F.lit("("), qty, F.lit(")")),
        F.concat(F.lit("y = "), "owner", F.lit("."), "method", F.lit("(df)")),
        F.concat(F.lit('r = eval("'), qty, F.lit('")')),
        F.concat(F.lit('password = "p'), qty, F.lit('"')),
        F.lit("for i in range(len(rows)): total += str(i)"),
        F.concat(F.lit("def f_"), "l_partkey", F.lit("(a, b):\n    return a")),
        F.concat(F.lit("class C"), "l_partkey", F.lit(':\n    """Doc."""\n    size = 1')),
        F.lit('try:\n    os.system("ls")\nexcept:\n    pass'),
        F.lit("_tmp = items.append([v for v in x])"),
        F.concat(F.lit("import "), "method", F.lit("\n\n# note "), qty),
        F.concat(F.lit("z = rows.map(F."), "method", F.lit(")")),
    ]
    last = F.when(F.col("l_quantity") > 48, F.lit("if a == 1 print(a)")).otherwise(
        F.lit('if a:\n    token = "t"\nelse:\n    pass'))
    line = last
    for i, t in reversed(list(enumerate(templates))):
        line = F.when(kind == i, t).otherwise(line)
    lines = items.join(api, "l_partkey").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")).alias("cell"),
    )
    # An order holds a dozen line items at most.
    bodies = lines.groupBy("o_orderkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c.line), "\n").alias("body"))
    header = (
        F.when(F.col("o_orderstatus") == "F", F.lit("from pyspark.sql import functions as F"))
        .when(F.col("o_orderstatus") == "O",
              F.concat(F.lit("import pyspark\nimport order_"), F.floor(F.col("o_orderkey") / 2)))
        .otherwise(F.lit("import os"))
    )
    folder = F.replace(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit(" "), F.lit("_"))
    return orders.join(bodies, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_key"),
        folder.alias("folder"),
        F.concat(F.lit("src/"), folder, F.lit("/order_"), "o_orderkey", F.lit(".py")).alias("file_path"),
        F.concat(header, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("content"),
    )


def kept_source_files(spark, sf) -> tuple[DataFrame, int]:
    """``source_files`` made once, part by part, and kept; with the number of passes over them that bounds the disk."""
    parts = passes_for(table(spark, sf, "lineitem"))
    return staged_parts((source_files(spark, sf, part, parts) for part in range(parts)), "sources"), parts


CTES["code_lines"] = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE (l_partkey + l_linenumber + l_suppkey) % 12
               WHEN 0 THEN 'x = df.' || method || '(' || qty || ')'
               WHEN 1 THEN 'y = ' || owner || '.' || method || '(df)'
               WHEN 2 THEN 'r = eval("' || qty || '")'
               WHEN 3 THEN 'password = "p' || qty || '"'
               WHEN 4 THEN 'for i in range(len(rows)): total += str(i)'
               WHEN 5 THEN 'def f_' || l_partkey || '(a, b):' || chr(10) || '    return a'
               WHEN 6 THEN 'class C' || l_partkey || ':' || chr(10) || '    \"""Doc.\"""' || chr(10) || '    size = 1'
               WHEN 7 THEN 'try:' || chr(10) || '    os.system("ls")' || chr(10) || 'except:' || chr(10) || '    pass'
               WHEN 8 THEN '_tmp = items.append([v for v in x])'
               WHEN 9 THEN 'import ' || method || chr(10) || chr(10) || '# note ' || qty
               WHEN 10 THEN 'z = rows.map(F.' || method || ')'
               ELSE CASE WHEN l_quantity > 48 THEN 'if a == 1 print(a)'
                    ELSE 'if a:' || chr(10) || '    token = "t"' || chr(10) || 'else:' || chr(10) || '    pass' END
           END AS line
    FROM (SELECT *, l_quantity::BIGINT::VARCHAR AS qty, replace(p_name, ' ', '_') AS method,
                 'pyspark.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS owner
          FROM lineitem JOIN part ON p_partkey = l_partkey)
"""
CTES["source_files"] = """
    SELECT o_orderkey AS order_key, o_custkey AS customer_key, folder,
           'src/' || folder || '/order_' || o_orderkey || '.py' AS file_path,
           CASE o_orderstatus WHEN 'F' THEN 'from pyspark.sql import functions as F'
                WHEN 'O' THEN 'import pyspark' || chr(10) || 'import order_' || (o_orderkey // 2) ELSE 'import os' END
           || chr(10) || coalesce(body, '') || chr(10) AS content
    FROM (SELECT *, replace(lower(substr(o_orderpriority, 3)), ' ', '_') AS folder FROM orders)
    LEFT JOIN (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, line) AS body
               FROM code_lines GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""


def api_docs(spark, sf) -> DataFrame:
    """``p_partkey, p_size, module, qualname, type, docstring``: a documented API object per part."""
    method = F.replace("p_name", F.lit(" "), F.lit("_"))
    module = F.concat(F.lit("pyspark."), F.lower("p_type"))
    owner = F.concat(module, F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("")))
    top = F.col("p_size") % 3 == 0
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 6
    doc = (
        F.when(kind == 0, F.concat(F.lit("Returns it.\n\n.. versionadded:: 1."), size))
        .when(kind == 1, F.lit(".. versionchanged:: 3.4\n    Supports :class:`Spark` and ``x`` now."))
        .when(kind == 2, F.concat(F.lit(".. deprecated:: 3."), size, F.lit(" Use other_fn instead. See notes")))
        .when(kind == 3, F.concat(F.lit("Old one.\n.. Deprecated:: 2.4.0\n   replace with  new_"), method, F.lit(".")))
        .when(kind == 4, F.lit("  Moved to :mod:`core`. \n.. versionchanged:: 3.0.1"))
        .otherwise(F.lit("Plain docstring."))
    )
    return table(spark, sf, "part").select(
        "p_partkey", "p_size", module.alias("module"),
        F.concat(F.when(top, module).otherwise(owner), F.lit("."), method).alias("qualname"),
        F.when(top, "function").otherwise("method").alias("type"),
        doc.alias("docstring"),
    )


CTES["api_docs"] = """
    SELECT p_partkey, p_size, 'pyspark.' || lower(p_type) AS module,
           'pyspark.' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || replace(p_brand, '#', '') END
           || '.' || replace(p_name, ' ', '_') AS qualname,
           CASE WHEN p_size % 3 = 0 THEN 'function' ELSE 'method' END AS type,
           CASE p_partkey % 6
               WHEN 0 THEN 'Returns it.' || chr(10) || chr(10) || '.. versionadded:: 1.' || p_size
               WHEN 1 THEN '.. versionchanged:: 3.4' || chr(10) || '    Supports :class:`Spark` and ``x`` now.'
               WHEN 2 THEN '.. deprecated:: 3.' || p_size || ' Use other_fn instead. See notes'
               WHEN 3 THEN 'Old one.' || chr(10) || '.. Deprecated:: 2.4.0' || chr(10) || '   replace with  new_'
                    || replace(p_name, ' ', '_') || '.'
               WHEN 4 THEN '  Moved to :mod:`core`. ' || chr(10) || '.. versionchanged:: 3.0.1'
               ELSE 'Plain docstring.' END AS docstring
    FROM part
"""
SPACES = r"' ' || chr(9) || chr(10) || chr(13)"
CTES["mined"] = rf"""
    SELECT *, regexp_extract(docstring, 'versionadded::\s*([0-9.]+)', 1) AS versionadded,
           regexp_extract(docstring, 'versionchanged::\s*([0-9.]+)\s*(.*)', 1) AS versionchanged,
           trim(regexp_extract(docstring, 'versionchanged::\s*([0-9.]+)\s*(.*)', 2), {SPACES}) AS versionchanged_note,
           regexp_extract(docstring, '(?i)deprecated::\s*([0-9.]+)\s*(.*)', 1) AS deprecated_in,
           trim(regexp_extract(docstring, '(?i)deprecated::\s*([0-9.]+)\s*(.*)', 2), {SPACES}) AS deprecated_note,
           trim(regexp_extract(regexp_extract(docstring, '(?i)deprecated::\s*([0-9.]+)\s*(.*)', 2),
                               '(?i)(?:use|replace with)\s+(.+?)(?:\.|$)', 1), {SPACES}) AS replacement,
           regexp_matches(docstring, '(?i)deprecated::\s*([0-9.]+)') AS deprecated
    FROM api_docs
"""
CTES["catalog"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qualname ORDER BY p_partkey) AS rn FROM mined) WHERE rn = 1
"""
