"""Sources: corpora as rows of files, and files as rows of lines.

Every reader has one schema, `path string, text string, size long`, so that each operator runs on a folder of sources
and on a table of documents alike. What can't be read is a row with a reason, never a lost row.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palisade.operators import snapshots

#: Fixed values of the scan: size cap, bytes looked at for a NUL, and what makes a text minified.
MAX_BYTES, NUL_BYTES, MINIFIED_CHARS, LONG_LINE, MEAN_LINE = 1_000_000, 8_000, 20_000, 4_000, 400

#: Languages by extension: fixed values.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "php": "php", "kt": "kotlin", "rb": "ruby",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """One of the known languages, or null."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def kind(path: Column) -> Column:
    """What a file is beside its language: docker, compose, actions, env, rules, yaml, json, xml, version or none."""
    name, low = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(path)
    return (
        F.when(name.rlike(r"^dockerfile|\.dockerfile$"), "docker")
        .when(name.rlike(r"^(?:docker-)?compose[^/]*\.ya?ml$"), "compose")
        .when(low.rlike(r"\.github/workflows/[^/]+\.ya?ml$"), "actions")
        .when(name.rlike(r"^\.env"), "env")
        .when(name.rlike(r"^(?:agents|claude|gemini)\.md$|^\.cursorrules$|\.mdc$|copilot-instructions\.md$"), "rules")
        .when(name.rlike(r"^(?:\.python-version|\.nvmrc|\.java-version|runtime\.txt)$"), "version")
        .when(name.rlike(r"\.ya?ml$"), "yaml").when(name.rlike(r"\.json$"), "json").when(name.rlike(r"\.xml$"), "xml")
    )


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*$|_test\.[a-z]+$|\.(?:test|spec)\.[a-z]+$|tests?\.java$")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over a whole path; `**` spans folders, `*` and `?` don't."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "/_" else "\\" + c))
            i += 1
    return "^" + "".join(out) + "$"


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches the path, one of its parts or its end, as ignore files mean it."""
    out = F.lit(False)
    for p in patterns:
        if p and not p.startswith(("#", "!")):
            body = glob_regex(p.strip("/"))[1:-1]
            out = out | path.rlike(f"^{body}(?:/|$)" if p.startswith("/") else f"(?:^|/){body}(?:/|$)")
    return out


def _cp949(content: Column) -> Column:
    """Spark decodes no Korean charset itself; Arrow batches of the few files that aren't UTF-8 do."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else bytes(raw).decode("cp949")
            except UnicodeDecodeError:
                return None

        return batch.map(one)

    return decode(content)


def decoded(content: Column) -> Column:
    """UTF-8 with or without a mark, else CP949, else UTF-8 with replacement characters."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    utf8 = F.try_validate_utf8(plain.cast("string"))
    return F.coalesce(utf8, _cp949(F.when(utf8.isNull(), plain)), F.make_valid_utf8(plain.cast("string")))


def minified(text: Column) -> Column:
    lengths = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    mean = F.length(text) / F.size(lengths)
    return (F.length(text) >= MINIFIED_CHARS) & ((F.array_max(lengths) > LONG_LINE) | (mean > MEAN_LINE))


def skip_reason(text: Column, size: Column) -> Column:
    """Why a file isn't analysed; null if it is. The cheap tests come first."""
    return (
        F.when(text.isNull(), "unreadable").when(size > MAX_BYTES, "too_large")
        .when(F.substring(text, 1, NUL_BYTES).contains("\x00"), "binary").when(minified(text), "minified")
    )


def from_folder(spark: SparkSession, folder: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Every file below a folder: path, text, size, language, kind, is_test and the reason if it is skipped."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").replace("file://", "")
    path = F.regexp_replace(F.col("path"), "^.*?" + root.replace(".", r"\.") + "/", "")
    rows = read.select(path.alias("path"), decoded(F.col("content")).alias("text"), F.col("length").alias("size"))
    return described(rows.where(~excluded(F.col("path"), exclude)))


def from_table(df: DataFrame, path: str | Column, text: str) -> DataFrame:
    """A table's rows as files."""
    name = F.col(path).cast("string") if isinstance(path, str) else path
    return described(df.select(name.alias("path"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("size")))


def described(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumns(
        {"language": language(path), "kind": kind(path), "is_test": is_test(path), "skipped": skip_reason(F.col("text"), F.col("size"))}
    )


def lines(files: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep..., line from 1, text): lines end at a line feed, and a trailing empty line counts."""
    split = files.select(*keep, F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return split.select(*keep, (F.col("at") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records, one JSON document a line. strict: a line that can't be read is an error, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def line_window(numbered: DataFrame, span: int) -> DataFrame:
    """Each line with the `span` lines from it on, joined."""
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(0, span - 1)
    return numbered.withColumn("window_text", F.array_join(F.collect_list("text").over(ahead), "\n"))


def code_digest(files: DataFrame) -> DataFrame:
    """(files, digest): the number of files and the start of their hash tree's root; no row for an empty table."""
    depth = snapshots.depth_for(files.count())
    return snapshots.tree(files, depth).where("level = 0").select("files", F.substring("digest", 1, 16).alias("digest"))
