"""Reports as a data source: files of ranges, pushed filters, whole or no writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palisade.sources import reports

FINDING = "rule_id string, severity string, path string, line long, snippet string"


def findings(spark, n=200, rules=4):
    level = ["CRITICAL", "MEDIUM", "LOW"]
    return spark.createDataFrame([(f"R{i % rules}", level[i % 3], f"d/{i % 40:03}.py", i, f'"q" \\  \n{i}, ') for i in range(n)], FINDING)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip_and_one_valid_report(spark, tmp_path):
    df = findings(spark)
    reports.save(df, f"{tmp_path}/r", parts=4)
    level = F.when(F.col("severity") == "CRITICAL", "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    assert rows(reports.load(spark, f"{tmp_path}/r")) == rows(df.select("rule_id", "path", level, "line", "snippet"))
    root = json.load(open(f"{tmp_path}/r/report.sarif"))
    parts = root["runs"][0]["externalPropertyFileReferences"]["results"]
    held = [json.load(open(f"{tmp_path}/r/{p['location']['uri']}")) for p in parts]
    assert len(parts) == 4 and sum(len(h["results"]) for h in held) == 200
    assert all(len(h["results"]) == p["itemCount"] and h["guid"] == p["guid"] and h["version"] == "2.1.0" for h, p in zip(held, parts))


def test_what_is_asked_for_chooses_files(spark, tmp_path):
    df, path = findings(spark), f"{tmp_path}/r"
    reports.save(df, path, parts=4)
    whole = reports.load(spark, path)
    for asked, keep in (
        ({"first": "d/003.py", "last": "d/003.py"}, "path = 'd/003.py'"), ({"first": "d/035.py"}, "path >= 'd/035.py'"), ({"last": "d/002.py"}, "path <= 'd/002.py'"),
        ({"rules": ["R1", "R9"]}, "rule_id IN ('R1', 'R9')"), ({"rules": ["none"]}, "false"), ({"rules": []}, "false"), ({"rules": ["R0"], "first": "d/036.py"}, "rule_id = 'R0' AND path >= 'd/036.py'"),
    ):
        assert rows(reports.load(spark, path, **asked)) == rows(whole.where(keep))
    one = reports.load(spark, path, first="d/003.py", last="d/003.py")
    assert one.rdd.getNumPartitions() == 1 and whole.rdd.getNumPartitions() == 4
    assert one.union(whole).count() == 205 and whole.join(one, "path").count() == 25  # branches of a plan keep apart


def test_append_and_overwrite(spark, tmp_path):
    path = f"{tmp_path}/r"
    reports.save(findings(spark, 30), path, "append", 2)
    reports.save(findings(spark, 10), path, "append", 2)
    assert reports.load(spark, path).count() == 40
    reports.save(findings(spark, 7), path, "overwrite", 2)
    assert reports.load(spark, path).count() == 7
    assert len([f for f in os.listdir(path) if f.startswith("results-")]) == len(reports.entries(reports.root_of(path)))


def test_an_aborted_write_leaves_nothing_new(spark, tmp_path):
    path = f"{tmp_path}/r"
    bad = findings(spark).withColumn("snippet", F.when(F.col("line") == 199, F.raise_error(F.lit("no"))).otherwise(F.col("snippet")))
    with pytest.raises(Exception):
        reports.save(bad, path, parts=3)
    assert not os.path.exists(path) or not os.listdir(path)
    reports.save(findings(spark, 9), path, parts=3)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception):
        reports.save(bad, path, "append", 3)
    assert sorted(os.listdir(path)) == before and reports.load(spark, path).count() == 9
    with pytest.raises(Exception):
        reports.save(spark.createDataFrame([("R", "LOW", None, 1, "x")], FINDING), path, "append")
    assert reports.load(spark, path).count() == 9


def test_empty_missing_and_foreign(spark, tmp_path):
    reports.save(findings(spark).where("false"), f"{tmp_path}/e")
    assert reports.load(spark, f"{tmp_path}/e").count() == 0
    with pytest.raises(Exception, match="no report"):
        reports.load(spark, f"{tmp_path}/none").collect()
    os.makedirs(f"{tmp_path}/old")
    open(f"{tmp_path}/old/report.sarif", "w").write('{"version": "1.0.0"}')
    with pytest.raises(Exception, match="version '1.0.0'"):
        reports.load(spark, f"{tmp_path}/old").collect()
