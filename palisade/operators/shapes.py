"""Shape checks of nested JSON: documents as (path, type, value) rows, held against a table of expectations.

Documents are parsed to variants and taken apart level by level; a level explodes the containers of the one above, so work
grows with the documents' contents and rounds with their depth. What an expectation asks for and a document lacks is a
problem of its own, never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators.graphs import _cut

#: type: object, array, string, integer, number, boolean; a number may be an integer. required: where the parent is there.
SPEC = "path string, type string, required boolean, allowed array<string>, least double, most double, code string"


def expect(path: str, type_: str, code: str, required: bool = False, allowed: tuple = (), least: float | None = None, most: float | None = None) -> tuple:
    bound = lambda x: None if x is None else float(x)
    return path, type_, required, list(allowed) or None, bound(least), bound(most), code


def _list_of(path: str, code: str, *fields: tuple) -> list[tuple]:
    return [expect(path, "array", f"{code}.list", required=True), expect(f"{path}[*]", "object", f"{code}.entry"), *(expect(f"{path}[*].{n}", t, f"{code}.{n}", *rest) for n, t, *rest in fields)]


_STATES = ("valid", "needs_review", "invalid", "revoked", "resolved", "unobserved")
_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: What a report has to look like: one code each.
REPORT = [
    expect("$", "object", "report"), expect("$.schema_version", "string", "report.version", True), expect("$.tool", "object", "tool", True), expect("$.tool.name", "string", "tool.name", True),
    expect("$.tool.version", "string", "tool.version", True), expect("$.as_of", "string", "report.as_of", True), expect("$.passed", "boolean", "report.passed", True),
    expect("$.summary", "object", "summary", True), expect("$.summary.total", "integer", "summary.total", True, (), 0), expect("$.summary.files", "integer", "summary.files", True, (), 0),
    *(expect(f"$.summary.by_severity.{s}", "integer", f"summary.{s.lower()}", True, (), 0) for s in _LEVELS), expect("$.summary.by_severity", "object", "summary.by_severity", True),
    *_list_of("$.findings", "finding", ("rule_id", "string", True), ("severity", "string", True, _LEVELS), ("path", "string", True), ("line", "integer", True, (), 1), ("fingerprint", "string", True)),
    *_list_of("$.approvals", "approval", ("id", "string", True), ("fingerprint", "string", True), ("status", "string", True, _STATES), ("expires", "string")),
    *_list_of("$.checks", "check", ("name", "string", True), ("result", "string", True, ("pass", "fail", "not_run", "unknown")), ("required", "boolean", True)),
    *_list_of("$.coverage", "coverage", ("path", "string", True), ("state", "string", True), ("reason", "string")),
    *_list_of("$.ledger", "ledger", ("rule_id", "string", True), ("runs", "integer", True, (), 0), ("failures", "integer", True, (), 0)),
    expect("$.trust", "object", "trust", True), expect("$.trust.level", "string", "trust.level", True, ("full", "partial", "none")), expect("$.trust.reasons", "array", "trust.reasons", True),
    expect("$.trust.reasons[*]", "string", "trust.reason"),
]


def spec(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SPEC)


def _type(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").when(name == "BIGINT", "integer").otherwise("number")
    )


def flatten(documents: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, place, parent, type, value, fields) for every node of every document.

    path has [*] for items of arrays, place their numbers from 0; parent is the place above; value is a scalar as a string; fields
    are the names of an object's fields that aren't null. A null or unreadable document is one row of type invalid.
    """
    read = documents.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v"))
    filled = F.map_keys(F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda _, x: ~F.is_variant_null(x)))
    node = lambda df: df.withColumn("type", _type(F.col("v"))).withColumn(
        "value", F.when(F.col("type").isin("object", "array", "null"), None).otherwise(F.try_variant_get("v", "$", "string"))
    ).withColumn("fields", F.when(F.col("type") == "object", filled))
    fields = ["id", "path", "place", "parent", "type", "value", "fields"]
    whole = read.withColumns({"path": F.lit("$"), "place": F.lit("$"), "parent": F.lit(None).cast("string")})
    level = node(whole.where("v IS NOT NULL"))
    out = whole.where("v IS NULL").withColumns({"type": F.lit("invalid"), "value": F.lit(None).cast("string"), "fields": F.lit(None).cast("array<string>")}).select(*fields).unionByName(level.select(*fields))
    while True:
        open_ = level.where(F.col("type").isin("object", "array")).select("id", "path", "place", "v")
        child = open_.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("v").outer())).withColumnRenamed("value", "item")
        at = lambda c, mark: F.concat(c, F.when(F.col("key").isNull(), mark).otherwise(F.concat(F.lit("."), F.col("key"))))
        named = child.select(
            "id", at(F.col("path"), F.lit("[*]")).alias("path"), at(F.col("place"), F.concat(F.lit("["), "pos", F.lit("]"))).alias("place"), F.col("place").alias("parent"), F.col("item").alias("v")
        )
        level = _cut(node(named))
        if level.isEmpty():
            return out
        out = out.unionByName(level.select(*fields))


def problems(flat: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, code, place, problem): missing, type, value or range; and unreadable for a document that can't be parsed.

    A null counts as missing where a field is required, and as nothing where it isn't. Unknown fields are no problem.
    """
    got = flat.join(F.broadcast(expected.withColumnRenamed("type", "wanted")), "path")
    fits = (F.col("type") == F.col("wanted")) | ((F.col("type") == "integer") & (F.col("wanted") == "number"))
    number = F.col("value").try_cast("double")
    wrong = (
        F.when(~fits, "type").when(F.col("allowed").isNotNull() & ~F.array_contains(F.col("allowed"), F.col("value")), "value")
        .when((number < F.col("least")) | (number > F.col("most")), "range")
    )
    seen = got.where("type NOT IN ('null', 'invalid')").select("id", "code", "place", wrong.alias("problem")).where("problem IS NOT NULL")
    # a required field below each parent that is there
    name = F.regexp_extract("path", r"\.([^.\[\]]+)$", 1)
    asked = expected.where("required").select("code", name.alias("field"), F.regexp_replace("path", r"\.[^.\[\]]+$", "").alias("path"))
    # an object knows its own fields, so nodes needn't be brought together with their parents
    wanted = flat.where("type = 'object'").join(F.broadcast(asked), "path").where(~F.array_contains("fields", F.col("field")))
    missing = wanted.select("id", "code", F.concat("place", F.lit("."), "field").alias("place"), F.lit("missing").alias("problem"))
    broken = flat.where("type = 'invalid'").select("id", F.lit("document").alias("code"), "place", F.lit("unreadable").alias("problem"))
    return seen.unionByName(missing).unionByName(broken)
