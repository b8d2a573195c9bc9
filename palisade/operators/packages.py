"""Dependency analytics: affected versions, aliases, fixes, severity, package indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.similarity import clusters

SEVERITY = ("CRITICAL", "HIGH", "MODERATE", "LOW")


def version_key(text: Column, digits: int = 8) -> Column:
    """A string that orders as the version does: numbers padded, a pre-release before its release. Null if unreadable.

    PyPI spells pre-releases 1.0a1, 1.0b2, 1.0rc1, 1.0.dev3, and post-releases 1.0.post1; npm 1.0.0-beta.2. A build part
    after + doesn't order.
    """
    low = F.regexp_replace(F.lower(F.trim(text)), r"^v|\+.*$", "")
    release = F.regexp_extract(low, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    rest = F.substring(low, F.length(release) + 1, F.length(low))
    numbers = F.transform(F.split(release, r"\."), lambda x: F.lpad(x, digits, "0"))
    padded = F.concat_ws(".", F.slice(F.concat(numbers, F.array_repeat(F.lit("0" * digits), 6)), 1, 6))
    stage = F.regexp_extract(rest, r"^[-._]?(dev|alpha|a|beta|b|preview|pre|c|rc|post|rev|r)\b|^[-._]?(dev|alpha|a|beta|b|preview|pre|c|rc|post|rev|r)(?=[-._]?[0-9])", 0)
    word = F.regexp_replace(stage, r"[^a-z]", "")
    rank = (
        F.when(rest == "", "m").when(word == "dev", "a").when(word.isin("a", "alpha"), "b").when(word.isin("b", "beta"), "c")
        .when(word.isin("c", "rc", "pre", "preview"), "d").when(word.isin("post", "rev", "r"), "x").when(rest.startswith("-"), "e")
    )
    tail = F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(r"([0-9]+|[a-z]+)"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, digits, "0")).otherwise(x)), ".")
    return F.when((release != "") & rank.isNotNull(), F.concat_ws("|", padded, rank, tail))


def in_interval(key: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Half-open [introduced, fixed) or closed [introduced, last]; null, never false, where a bound can't be read."""
    known = key.isNotNull() & (introduced.isNotNull()) & (fixed.isNotNull() | last.isNotNull() | (fixed.isNull() & last.isNull()))
    upper = F.when(fixed.isNotNull(), key < fixed).when(last.isNotNull(), key <= last).otherwise(F.lit(True))
    return F.when(known, (key >= introduced) & upper)


def affected(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ecosystem, name, version, advisory, affected): true, false or null (undetermined).

    packages: ecosystem, name, version. ranges: advisory, ecosystem, name, kind, introduced, fixed, last_affected,
    versions (an explicit list, or null), withdrawn.
    """
    r = ranges.where(~F.coalesce(F.col("withdrawn"), F.lit(False)))
    joined = packages.join(r, ["ecosystem", "name"])
    start = F.when(F.col("introduced") == "0", F.lit("")).otherwise(version_key(F.col("introduced")))
    bad_bound = (F.col("fixed").isNotNull() & version_key(F.col("fixed")).isNull()) | (F.col("last_affected").isNotNull() & version_key(F.col("last_affected")).isNull())
    hit = F.when(F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)), F.lit(True)).when(
        (F.col("kind") != "GIT") & ~bad_bound, in_interval(version_key(F.col("version")), start, version_key(F.col("fixed")), version_key(F.col("last_affected")))
    )
    rows = joined.withColumn("hit", hit).groupBy("ecosystem", "name", "version", "advisory")
    return rows.agg(F.when(F.max("hit"), F.lit(True)).when(F.count("hit") < F.count("*"), F.lit(None)).otherwise(F.lit(False)).alias("affected"))


def merged_aliases(advisories: DataFrame) -> DataFrame:
    """(advisory, group): advisories that share an id or alias, over any number of steps, are one group."""
    links = advisories.select(F.col("advisory").alias("a"), F.explode(F.concat(F.array("advisory"), F.coalesce("aliases", F.array()))).alias("b"))
    found = clusters(links.where("a <> b"))
    return advisories.select("advisory").distinct().join(found, F.col("advisory") == F.col("node"), "left").select("advisory", F.coalesce("cluster", "advisory").alias("group"))


def worst(severity: Column) -> Column:
    """The highest severity of a group; unknown is below all others."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITY)), severity), F.lit(0)), F.lit(99))
    return F.min_by(severity, rank)


def first_fix(version: Column, fixes: Column, intervals: Column) -> Column:
    """The least of `fixes` above the version that lies in no affected interval. intervals: array of (introduced, fixed) keys."""
    open_ = lambda f: ~F.exists(intervals, lambda i: (i["introduced"] <= f) & (i["fixed"].isNull() | (f < i["fixed"])))
    return F.array_min(F.filter(fixes, lambda f: (f > version) & open_(f)))


def unknown_names(names: DataFrame, index: DataFrame, local: DataFrame) -> DataFrame:
    """Names that neither the registry index nor the corpus itself has; names are compared normalised."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    asked = names.select("name", norm(F.col("name")).alias("key"))
    known = index.select(norm(F.col("name")).alias("key")).unionByName(local.select(norm(F.col("name")).alias("key"))).distinct()
    return asked.join(known, "key", "left_anti").select("name")


def newly_published(index: DataFrame, days: int = 90) -> DataFrame:
    """Packages created within `days` before the index was collected."""
    return index.where(F.datediff("collected_at", "created").between(0, days))


def sbom(packages: DataFrame) -> DataFrame:
    """One CycloneDX component document a package; a document's components are bounded by its lock file."""
    purl = F.concat(F.lit("pkg:"), F.lower("ecosystem"), F.lit("/"), F.col("name"), F.lit("@"), F.col("version"))
    return packages.select("lock", F.to_json(F.struct(F.lit("library").alias("type"), purl.alias("bom-ref"), F.col("name"), F.col("version"), purl.alias("purl"))).alias("component"))


def parse_requirements(lines: DataFrame) -> DataFrame:
    """(path, name, version) of the pinned lines of requirements files."""
    got = F.regexp_extract("text", r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 1)
    pin = F.regexp_extract("text", r"^\s*[A-Za-z0-9][\w.-]*(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 1)
    return lines.select("path", got.alias("name"), pin.alias("version")).where("name <> ''")


def parse_package_lock(files: DataFrame) -> DataFrame:
    """(path, name, version, dev) of npm lock files, version 2 or 3."""
    entry = "map<string,struct<version:string,dev:boolean>>"
    got = files.select("path", F.explode(F.from_json("text", f"struct<packages:{entry}>")["packages"]).alias("place", "p"))
    return got.where("place <> ''").select("path", F.regexp_replace("place", r"^.*node_modules/", "").alias("name"), F.col("p.version").alias("version"), F.coalesce("p.dev", F.lit(False)).alias("dev"))
