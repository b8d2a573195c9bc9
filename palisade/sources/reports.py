"""SARIF 2.1.0 reports as a data source: one report that many tasks write and many tasks read.

A report is a folder. Each task writes the results of its partition into an external property file, as the format names
them, and the commit writes `report.sarif`, the root that refers to these files. So the driver handles one entry a task
and never the results. The root appears in one step: before it, there is no report, and what an aborted write or a lost
task leaves behind is in no root and is removed.

Each entry of the root says which rules its file holds and between which paths they lie, so files that can't hold what
is asked for aren't opened. What is asked for are parameters of `load`, not filters that the engine pushes down: a Python
source of Spark 4.1 keeps the partitions of the filters that were pushed last for every use of one DataFrame, so that two
branches of a plan would see one another's rows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from palisade.operators.governance import sarif_results
from palisade.sources.package import ship

FORMAT, VERSION, ROOT = "audit_report", "2.1.0", "report.sarif"
SCHEMA = "rule_id string, path string, result string"
NAMED_RULES, BATCH = 256, 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def root_of(path: str) -> dict | None:
    """The report's root; null if there is none. Another version is an error, not an empty report."""
    files, at = opened(path)
    if files.get_file_info(f"{at}/{ROOT}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{at}/{ROOT}") as source:
        root = json.loads(source.read())
    if root.get("version") != VERSION:
        raise ValueError(f"{path} is a report of version {root.get('version')!r}, not {VERSION}")
    return root


def entries(root: dict | None) -> list[dict]:
    return root["runs"][0]["externalPropertyFileReferences"]["results"] if root else []


@dataclass
class Written(WriterCommitMessage):
    entry: dict | None


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tool: str, overwrite: bool):
        self.path, self.tool, self.overwrite = path, tool, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        guid, n, rules, low, high = str(uuid.uuid4()), 0, set(), None, None
        name = f"results-{guid}.sarif-external-properties"
        out = None
        for batch in iterator:
            for rule, path, result in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "path", "result"))):
                if out is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(f"{at}/{name}")
                    out.write(json.dumps({"version": VERSION, "guid": guid})[:-1].encode() + b', "results": [\n')
                out.write((b",\n" if n else b"") + result.encode())
                n += 1
                if len(rules) <= NAMED_RULES:
                    rules.add(rule)
                low, high = (path if low is None else min(low, path)), (path if high is None else max(high, path))
        if out is None:
            return Written(None)
        out.write(b"\n]}\n")
        out.close()
        known = {"first": low, "last": high, "rules": sorted(rules) if len(rules) <= NAMED_RULES else None}
        return Written({"location": {"uri": name}, "guid": guid, "itemCount": n, "properties": known})

    def commit(self, messages: list) -> None:
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        kept = [] if self.overwrite else entries(root_of(self.path))
        kept = kept + [m.entry for m in messages if m is not None and m.entry]
        run = {"tool": {"driver": {"name": self.tool}}, "externalPropertyFileReferences": {"results": kept}}
        draft = f"{at}/{ROOT}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"version": VERSION, "runs": [run]}).encode())
        files.move(draft, f"{at}/{ROOT}")
        self._sweep(files, at, {e["location"]["uri"] for e in kept})

    def abort(self, messages: list) -> None:
        files, at = opened(self.path)
        self._sweep(files, at, {e["location"]["uri"] for e in entries(root_of(self.path))})

    def _sweep(self, files: fs.FileSystem, at: str, kept: set) -> None:
        """Removes result files that no root refers to; one writer at a time is the caller's duty."""
        for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.base_name.startswith("results-") and info.base_name not in kept:
                files.delete_file(info.path)


@dataclass
class Part(InputPartition):
    name: str
    count: int


def may_hold(entry: dict, rules: list | None, first: str | None, last: str | None) -> bool:
    """Whether an entry's file may hold a result of one of the rules on a path from first to last."""
    known = entry.get("properties", {})
    if rules is not None and known.get("rules") is not None and not set(rules) & set(known["rules"]):
        return False
    low, high = known.get("first"), known.get("last")
    return low is None or ((first is None or high >= first) and (last is None or low <= last))


class ReportReader(DataSourceReader):
    def __init__(self, path: str, rules: list | None, first: str | None, last: str | None):
        self.path, self.kept = path, (rules, first, last)

    def partitions(self) -> list:
        root = root_of(self.path)
        if root is None:
            raise FileNotFoundError(f"no report in {self.path}")
        return [Part(e["location"]["uri"], e["itemCount"]) for e in entries(root) if may_hold(e, *self.kept)] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, at = opened(self.path)
        rows, seen = [], 0
        with io.BufferedReader(files.open_input_file(f"{at}/{partition.name}")) as raw:
            for i, line in enumerate(raw):
                if i == 0 or line.startswith(b"]}"):
                    continue
                text = line.decode().rstrip("\n")
                text = text[:-1] if text.endswith(",") else text
                result = json.loads(text)
                rows.append((result["ruleId"], result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], text))
                seen += 1
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if seen != partition.count:
            raise ValueError(f"{partition.name} holds {seen} results and should hold {partition.count}")
        if rows:
            yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["rule_id", "path", "result"])


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:
        rules = self.options.get("rules")
        return ReportReader(self.options["path"], json.loads(rules) if rules else None, self.options.get("first"), self.options.get("last"))

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], self.options.get("tool", "palisade"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    ship(spark)
    spark.dataSource.register(ReportSource)


def save(findings: DataFrame, path: str, mode: str = "overwrite", parts: int | None = None) -> None:
    """Writes findings (rule_id, severity, path, line, snippet) as a report, in ranges of paths.

    Findings without a rule or a path can't be placed in a report and are an error, not lost.
    """
    register(findings.sparkSession)
    rows = sarif_results(findings.withColumns({"rule_id": _required("rule_id"), "path": _required("path")}))
    rows = rows.select(F.get_json_object("result", "$.ruleId").alias("rule_id"), "path", "result")
    rows = rows.repartitionByRange(parts, "path") if parts else rows.repartitionByRange("path")
    rows.write.format(FORMAT).mode(mode).option("path", path).save()


def _required(name: str):
    return F.coalesce(F.col(name).cast("string"), F.raise_error(F.lit(f"a finding has no {name}")).cast("string"))


def load(spark: SparkSession, path: str, rules: Sequence[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(rule_id, path, level, line, snippet) of a report's results: all, or those of some rules on paths first to last."""
    register(spark)
    options = {"path": path, "rules": None if rules is None else json.dumps(list(rules)), "first": first, "last": last}
    rows = spark.read.format(FORMAT).options(**{k: v for k, v in options.items() if v is not None}).load()
    if rules is not None:
        rows = rows.where(F.col("rule_id").isin(list(rules)))
    if first is not None:
        rows = rows.where(F.col("path") >= first)
    if last is not None:
        rows = rows.where(F.col("path") <= last)
    at = "$.locations[0].physicalLocation.region.startLine"
    return rows.select("rule_id", "path", F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", at).cast("long").alias("line"), F.get_json_object("result", "$.message.text").alias("snippet"))
