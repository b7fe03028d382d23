"""Cases of fault localisation from lists of bugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TESTS, MOST_TERMS, DEFAULT_ROOT = 4, 8, "src/main/java"


def simple_name(qualified: Column) -> Column:
    """What stands after the last dot, and after the last dollar in that."""
    return F.element_at(F.split(F.element_at(F.split(qualified, r"\."), -1), r"\$"), -1)


def class_path(name: Column, root: Column) -> Column:
    """The file of a class under a source root; without a root, the path alone."""
    inner = F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(".java"))
    bare = F.regexp_replace(root, "^/+|/+$", "")
    return F.when(bare == "", inner).otherwise(F.concat_ws("/", bare, inner))


def test_terms(tests: Column) -> Column:
    """Names of classes and methods of the first triggering tests (Class::method)."""
    each = F.transform(F.slice(tests, 1, MOST_TESTS), lambda t: F.array(simple_name(F.substring_index(t, "::", 1)), F.regexp_extract(t, r"^.*?::(.*)$", 1)))
    return F.filter(F.flatten(each), lambda x: x != "")


def build(bugs: DataFrame, roots: dict[str, str] | None = None, curated: DataFrame | None = None, per_project: int | None = None) -> DataFrame:
    """bug_id, project, query, impact_symbol, expected_files, expected_methods, modified_classes, triggering_tests.

    bugs: project, bug_id, modified_classes, triggering_tests.  curated (bug_id, query, impact_symbol, expected_methods)
    takes precedence where it has a value.
    """
    if per_project is not None:
        w = Window.partitionBy("project").orderBy(F.col("bug_id").cast("long"))
        bugs = bugs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_project).drop("k")
    root = F.lit(DEFAULT_ROOT)
    for project, path in (roots or {}).items():
        root = F.when(F.col("project") == project, path).otherwise(root)
    names = F.transform("modified_classes", simple_name)
    terms = F.slice(F.array_distinct(F.filter(F.concat(names, test_terms(F.col("triggering_tests"))), lambda x: x != "")), 1, MOST_TERMS)
    files = F.array_sort(F.array_distinct(F.transform("modified_classes", lambda c: class_path(c, F.col("root")))))
    out = bugs.withColumn("root", root).select(F.concat_ws("_", "project", F.concat(F.col("bug_id"), F.lit("b"))).alias("bug_id"), "project", F.array_join(terms, " ").alias("query"), F.element_at(names, 1).alias("impact_symbol"), files.alias("expected_files"), "modified_classes", "triggering_tests")
    none = F.array().cast("array<string>")
    if curated is None:
        return out.withColumn("expected_methods", none)
    c = curated.select("bug_id", F.col("query").alias("q"), F.col("impact_symbol").alias("s"), F.col("expected_methods").alias("expected_methods"))
    return out.join(c, "bug_id", "left").withColumns({"query": F.coalesce(F.when(F.col("q") != "", F.col("q")), "query"), "impact_symbol": F.coalesce(F.when(F.col("s") != "", F.col("s")), "impact_symbol"), "expected_methods": F.coalesce("expected_methods", none)}).drop("q", "s")
