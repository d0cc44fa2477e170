import re

from pyspark.sql import functions as F

from corpuscope.functions.markup import clean_markup
from corpuscope.operators.catalog import analyze_files, call_candidates, extract_calls, file_changes, insert_ignore, mine_version_info, resolve_calls
from corpuscope.operators.topk import first_per_group
from corpuscope.sources.catalog import CATALOG_COLUMNS, catalog_dims, read_api_catalog, write_api_catalog
from tests.conftest import plan, rows

DOCS = [
    ("pyspark.sql", "pyspark.sql.DataFrame.old", "Old.\n.. deprecated:: 2.4\n    Use new_one instead. More"),
    ("pyspark.sql", "pyspark.sql.DataFrame.changed", ".. versionchanged:: 3.4.0\n   Supports :meth:`y` and ``z``.\n"),
    ("pyspark.sql", "pyspark.sql.DataFrame", "A plain class. .. versionadded:: 1.3"),
    ("pyspark.sql.functions", "pyspark.sql.functions.col", "Plain column"),
    ("pyspark.sql", "pyspark.sql.Column.shared", "Will be removed"),
    ("pyspark.sql", "pyspark.sql.Row.shared", "alias for x"),
    ("pyspark.ml", "pyspark.ml.deep.er.Model.fit", "use this"),
    ("pyspark.ml", "pyspark.ml._deprecated_fit", "nothing"),
    ("pyspark.sql", "pyspark.sql.DataFrame.old", "Duplicate"),
]


def catalog(spark):
    base = spark.createDataFrame([(i, *d) for i, d in enumerate(DOCS)], "n int, module string, qualname string, docstring string")
    rows_ = mine_version_info(base).withColumns(
        {c: F.lit("") for c in ("pyspark_version", "type", "parameters", "returns")})
    return first_per_group(rows_, ["qualname"], ["n"], 1).select(*CATALOG_COLUMNS)


def test_mining_matches_python(spark):
    got = {r.qualname: r for r in catalog(spark).collect()}
    for _, name, doc in DOCS[:-1]:
        changed = re.search(r"versionchanged::\s*([0-9.]+)\s*(.*)", doc)
        gone = re.search(r"deprecated::\s*([0-9.]+)\s*(.*)", doc, re.I)
        assert got[name].versionchanged == (changed.group(1) if changed else "")
        assert got[name].versionchanged_note == (changed.group(2).strip() if changed else "")
        assert got[name].deprecated_in == (gone.group(1) if gone else "")
    assert got["pyspark.sql.DataFrame.old"].replacement == "new_one instead"
    assert got["pyspark.ml._deprecated_fit"].deprecated is True


def test_markup(spark):
    df = spark.createDataFrame([(" :class:`A` and ``b``\n",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_markup("t")).collect()] == ["A and b", ""]


def test_insert_ignore_is_idempotent(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (2, "b", 2), (2, "a", 1)], "k int, v string, n int")
    once = insert_ignore(old, new, ["k"], ["n"])
    assert rows(once) == [(1, "old"), (2, "a")]
    assert rows(insert_ignore(once, new, ["k"], ["n"])) == rows(once)


def test_csv_round_trip(spark, tmp_path):
    source = catalog(spark)
    write_api_catalog(source, str(tmp_path / "c"))
    assert rows(read_api_catalog(spark, str(tmp_path / "c"))) == rows(source)


def test_dims(spark):
    names = rows(catalog_dims(catalog(spark)))
    assert ("class", "Model") in names and ("class", "DataFrame") in names and ("module", "pyspark.ml") in names
    assert len(names) == len(set(names))


FILES = [
    ("a.py", "from pyspark.sql import x\ndf.old()\ndf.old()\ny = pyspark.sql.Row.shared\nz.shared\nq.fit"),
    ("b.py", "import  pyspark\nprint(1)"),
    ("c.py", "df.old()"),
    ("d.py", "import pyspark\ndf.changed(pyspark.sql.functions.col)"),
]


def brute_options(call, names, modules):
    classes = {n.split(".")[-2] for n in names if n.count(".") > 1}
    if call.startswith("pyspark."):
        options = {call}
    else:
        last = call.split(".")[-1]
        options = {f"{m}.{last}" for m in modules} | {f"{m}.{c}.{last}" for m in modules for c in classes}
    return sorted(options & names)


def brute_calls(text):
    return re.findall(r"\b(?:pyspark(?:\.\w+)+|\w+\.\w+)\b", text)


def test_resolution_equals_first_of_all_combinations(spark):
    known = catalog(spark)
    names = {r.qualname for r in known.collect()}
    modules = {r.module for r in known.collect()}
    files = spark.createDataFrame(FILES, "file_path string, content string")
    calls = extract_calls(files)
    want = {(p, options[0]) for p, t in FILES for c in brute_calls(t) if (options := brute_options(c, names, modules))}
    assert rows(resolve_calls(calls, known, significant_only=False)) == sorted(want, key=repr)
    lookups = {(c if c.startswith("pyspark.") else "." + c.split(".")[-1], n)
               for _, t in FILES for c in brute_calls(t) for n in brute_options(c, names, modules)}
    assert rows(call_candidates(calls, known)) == sorted(lookups, key=repr)


def test_rows_grow_with_the_calls(spark):
    """Many classes share one method name: each call still gives one row."""
    n = 300
    base = spark.createDataFrame([(i, "pyspark.m", f"pyspark.m.C{i:03}.shared", "use x") for i in range(n)],
                                 "n int, module string, qualname string, docstring string")
    known = mine_version_info(base).withColumns({c: F.lit("") for c in ("pyspark_version", "type", "parameters", "returns")}).select(*CATALOG_COLUMNS)
    for k in (10, 100):
        files = spark.createDataFrame([(f"f{i}", "import pyspark\na.shared()\nb.shared()") for i in range(k)], "file_path string, content string")
        assert resolve_calls(extract_calls(files), known).count() == k
        assert file_changes(files, known).count() == k
    assert call_candidates(extract_calls(files), known).count() == n


def test_report_and_roll_up(spark):
    known = catalog(spark)
    files = spark.createDataFrame(FILES, "file_path string, content string")
    report = {(r.file_path, r.function_name): r for r in file_changes(files, known).collect()}
    assert report["a.py", "pyspark.sql.DataFrame.old"].reason == "Deprecated in Pyspark 2.4"
    assert not any(path == "c.py" for path, _ in report)
    # The docstring has none of the phrases, so the changed name is no significant change.
    assert ("d.py", "pyspark.sql.DataFrame.changed") not in report
    per_file = {r.file_path: r for r in analyze_files(files, known).collect()}
    assert per_file["a.py"].needs_modification and not per_file["a.py"].aligned_with_3_5
    assert per_file["b.py"].has_pyspark and per_file["b.py"].aligned_with_3_5
    assert not per_file["c.py"].has_pyspark and per_file["c.py"].functions == []
    for path, r in per_file.items():
        assert r.functions == sorted(n for p, n in report if p == path) and r.n_changes == len(r.functions)


def test_no_product_join(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    text = plan(analyze_files(files, catalog(spark)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
