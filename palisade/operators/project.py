"""Rules that look at files or at the whole corpus: flags, HAVING, anti-joins, configuration documents, routes.

files: path, text, language, kind, is_test. A corpus may hold many projects: `project` names the column that tells them
apart, and every aggregate is by it. Each rule returns (project, path, line, rule_id, severity, note).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

COLUMNS = ("project", "path", "line", "rule_id", "severity", "note")
ROUTE = r"@(?:\w+\.)?(?:route|get|post|put|delete|patch)\(|@(?:Get|Post|Put|Delete|Patch|Request)Mapping|\b(?:app|router)\.(?:get|post|put|delete|patch)\("
DATABASE = r"\b(?:cursor|session|db|conn(?:ection)?)\.(?:execute|query|commit)\(|\.objects\.\w+\(|\bexecuteQuery\("
#: Sensitive paths and what shows that a route asks who is calling: fixed values.
SENSITIVE = r"(?i)admin|user|account|payment|order|delete|upload|settings|token"
AUTHENTICATED = r"(?i)login_required|jwt_required|permission|Depends\(\s*(?:get_)?current|PreAuthorize|Secured|requireAuth|isAuthenticated|passport\.|authenticate"


def _out(df: DataFrame, rule: str, severity: str | Column, note: str | Column = "", line: str | Column = "line") -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    where = F.col(line) if isinstance(line, str) else line
    return df.select("project", "path", where.cast("int").alias("line"), F.lit(rule).alias("rule_id"), as_col(severity).alias("severity"), as_col(note).alias("note"))


def _first(lines: DataFrame, pattern: str, by: tuple = ("project",)) -> DataFrame:
    """The first line of each project (or other group) that matches."""
    hit = lines.where(F.col("text").rlike(pattern))
    return hit.groupBy(*by).agg(F.min(F.struct("path", "line")).alias("f")).select(*by, *(["f.path"] if "path" not in by else []), F.col("f.line").alias("line"))


def _without(df: DataFrame, lines: DataFrame, marker: str) -> DataFrame:
    """Rows of projects that no line with the marker belongs to."""
    return df.join(lines.where(F.col("text").rlike(marker)).select("project").distinct(), "project", "left_anti")


def committed_secret_files(files: DataFrame, ignored: Column | None = None) -> DataFrame:
    """AI-104: environment and key files that aren't ignored, outside of tests; worse with a secret inside."""
    name = F.element_at(F.split("path", "/"), -1)
    secret = name.rlike(r"^\.env(?:\.(?!example|sample|template)\w+)?$|^id_(?:rsa|dsa|ecdsa|ed25519)$|\.(?:pem|p12|pfx|jks|keystore)$")
    kept = files.where(secret & ~F.col("is_test") & ~(ignored if ignored is not None else F.lit(False)))
    holds = F.col("text").rlike(r"(?im)^\s*\w*(?:secret|token|password|api_?key)\w*\s*=\s*\S{6,}|PRIVATE KEY")
    return _out(kept, "AI-104", F.when(holds, "CRITICAL").otherwise("HIGH"), line=F.lit(1))


#: A table's name with its schema, quoted or not, as SQL's grammar writes it.
_TABLE = r"(?:(?:\w+|\"[^\"]+\")\s*\.\s*)?(?:\w+|\"[^\"]+\")"


def row_level_security(lines: DataFrame) -> DataFrame:
    """AI-108: tables that are created and for which row level security is never enabled."""
    bare = lambda words: F.lower(F.regexp_replace(F.regexp_extract("text", rf"(?i)\b{words}\s+({_TABLE})", 1), r"^.*\.\s*|\"", ""))
    table = lines.select("project", "path", "line", "text", bare(r"CREATE\s+(?:UNLOGGED\s+)?TABLE(?:\s+IF\s+NOT\s+EXISTS)?").alias("table")).where("table <> ''")
    secured = lines.where(F.col("text").rlike(r"(?i)\bENABLE\s+ROW\s+LEVEL\s+SECURITY\b")).select("project", bare(r"ALTER\s+TABLE(?:\s+IF\s+EXISTS)?(?:\s+ONLY)?").alias("table"))
    exposed = lines.where(F.col("text").rlike(r"(?i)\bauth\s*\.\s*uid\s*\(|\bsupabase\b")).select("project").distinct()
    return _out(table.join(secured, ["project", "table"], "left_anti").join(exposed, "project", "left_semi"), "AI-108", "HIGH", F.col("table"))


def hardening_advice(lines: DataFrame) -> DataFrame:
    """AI-114: web frameworks without hardening middleware or a limiter."""
    express = _without(_first(lines, r"\bexpress\(\)"), lines, r"\bhelmet\(|rateLimit\(|express-rate-limit")
    python = _without(_first(lines, r"\b(?:Flask|FastAPI)\("), lines, r"Limiter\(|slowapi|flask_limiter")
    return _out(express.unionByName(python), "AI-114", "LOW")


def custom_tokens(files: DataFrame) -> DataFrame:
    """AI-118: files that sign and split tokens by hand, without a token library."""
    t = F.col("text")
    ok = t.rlike(r"(?i)\bhmac\b|createHmac") & t.rlike(r"\.split\(\s*[\"'][.:|][\"']\s*\)") & ~t.rlike(r"(?i)\bjwt\b|jose|itsdangerous") & (F.col("path").rlike("(?i)token|session") | F.left(t, F.lit(2000)).rlike("(?i)token|session"))
    return _out(files.where(ok & ~F.col("is_test")), "AI-118", "MEDIUM", line=F.lit(1))


def framework_guard(lines: DataFrame) -> DataFrame:
    """AI-119: filters written by hand where no security framework is used."""
    return _out(_without(_first(lines, r"implements\s+Filter\b|extends\s+OncePerRequestFilter"), lines, r"spring-?security|SecurityFilterChain|EnableWebSecurity"), "AI-119", "MEDIUM")


def exception_handler(lines: DataFrame) -> DataFrame:
    """AI-120: three controllers or five routes, and nothing that handles exceptions for all of them."""
    counts = lines.groupBy("project").agg(F.count_if(F.col("text").rlike(r"@(?:Rest)?Controller\b|\[ApiController\]")).alias("c"), F.count_if(F.col("text").rlike(ROUTE)).alias("r"))
    many = counts.where("c >= 3 OR r >= 5").select("project")
    first = _first(lines, ROUTE + r"|@(?:Rest)?Controller\b").join(many, "project", "left_semi")
    return _out(_without(first, lines, r"ControllerAdvice|errorhandler\(|exception_handler\(|UseExceptionHandler|app\.use\(\s*(?:async\s*)?\(\s*err"), "AI-120", "LOW")


def version_uses(lines: DataFrame) -> DataFrame:
    """(project, path, line, runtime, role, version): fixed, minimum or supported versions of runtimes."""
    shapes = (
        ("python", "fixed", r"^\s*FROM\s+python:([0-9]+(?:\.[0-9]+)*)"), ("python", "minimum", r"requires-python\s*=\s*[\"']>=\s*([0-9.]+)"), ("python", "fixed", r"python-version:\s*[\"']?([0-9]+\.[0-9]+)"),
        ("node", "fixed", r"^\s*FROM\s+node:([0-9]+(?:\.[0-9]+)*)"), ("node", "minimum", r"\"node\"\s*:\s*\">=\s*([0-9.]+)"), ("node", "fixed", r"node-version:\s*[\"']?([0-9]+(?:\.[0-9]+)*)"),
        ("java", "fixed", r"<(?:java\.version|maven\.compiler\.(?:source|release))>([0-9.]+)<"), ("java", "fixed", r"java-version:\s*[\"']?([0-9]+)"),
    )
    hits = [F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("runtime"), F.lit(k).alias("role"), F.regexp_extract("text", p, 1).alias("version"))) for r, k, p in shapes]
    found = lines.select("project", "path", "line", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("v"))
    return found.select("project", "path", "line", "v.*")


def version_mismatch(uses: DataFrame) -> DataFrame:
    """AI-121: different fixed versions of one runtime, or one below the minimum that the project asks for."""
    v = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    n = uses.withColumn("v", F.slice(v, 1, 2)).groupBy("project", "runtime").agg(
        F.countDistinct(F.when(F.col("role") == "fixed", F.col("v"))).alias("kinds"), F.min(F.when(F.col("role") == "fixed", F.col("v"))).alias("low"),
        F.max(F.when(F.col("role") == "minimum", F.col("v"))).alias("least"), F.min(F.struct("path", "line")).alias("at"),
    )
    bad = n.where((F.col("kinds") > 1) | (F.col("low") < F.col("least")))
    return _out(bad.select("project", "runtime", "at.path", "at.line"), "AI-121", "MEDIUM", F.col("runtime"))


def single_admin_role(lines: DataFrame) -> DataFrame:
    """AI-122: three guarded roles or more, and all of them the administrator's."""
    pattern = r"(?:hasRole|hasAuthority|role_required|roles_required|requireRole)\(\s*[\"']([^\"']+)[\"']"
    roles = lines.where(F.col("text").rlike(pattern)).select("project", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("role"))
    all_ = roles.groupBy("project").agg(F.count("*").alias("n"), F.bool_and(F.lower("role").rlike("^(?:role_)?(?:admin|administrator|root|superuser)$")).alias("only"), F.min(F.struct("path", "line")).alias("f"))
    return _out(all_.where("n >= 3 AND only").select("project", "f.path", "f.line"), "AI-122", "MEDIUM")


def mcp_config(files: DataFrame) -> DataFrame:
    """AIA-102: server configurations that run unpinned packages, use plain http, hold secrets or approve everything."""
    server = "map<string,struct<command:string,args:array<string>,url:string,env:map<string,string>,autoApprove:array<string>,alwaysAllow:array<string>>>"
    got = files.where(F.col("kind") == "json").select("project", "path", F.explode(F.from_json("text", f"struct<mcpServers:{server}>")["mcpServers"]).alias("name", "s"))
    package = F.try_element_at(F.filter(F.coalesce("s.args", F.array()), lambda a: ~a.startswith("-")), F.lit(1))
    checks = {
        "unpinned package": F.col("s.command").rlike(r"^(?:npx|uvx|bunx)$") & ~package.rlike(r".@[0-9]|==[0-9]"),
        "plain http": F.col("s.url").rlike(r"^http://(?!localhost|127\.)"),
        "credentials in the address": F.col("s.url").rlike(r"://[^/@]+:[^/@]+@"),
        "literal secret": F.exists(F.map_entries("s.env"), lambda e: e["key"].rlike("(?i)key|token|secret|password") & ~e["value"].rlike(r"^\$|^$|^<")),
        "approves everything": F.exists(F.concat(F.coalesce("s.autoApprove", F.array()), F.coalesce("s.alwaysAllow", F.array())), lambda x: x == "*"),
    }
    notes = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return _out(got.withColumn("what", F.explode(notes)), "AIA-102", "MEDIUM", F.concat_ws(": ", "name", "what"), line=F.lit(1))


def layering(lines: DataFrame) -> DataFrame:
    """ARC-202: files that handle requests and talk to the database themselves."""
    per = lines.groupBy("project", "path").agg(F.bool_or(F.col("text").rlike(ROUTE)).alias("route"), F.min(F.when(F.col("text").rlike(DATABASE), F.col("line"))).alias("line"))
    return _out(per.where("route AND line IS NOT NULL"), "ARC-202", "MEDIUM")


def no_tests(files: DataFrame, least: int = 5) -> DataFrame:
    """ARC-206: five sources or more and no test."""
    n = files.where(F.col("language").isNotNull()).groupBy("project").agg(F.count_if(~F.col("is_test")).alias("sources"), F.count_if("is_test").alias("tests"), F.min("path").alias("path"))
    return _out(n.where((F.col("sources") >= least) & (F.col("tests") == 0)), "ARC-206", "MEDIUM", F.col("sources").cast("string"), line=F.lit(1))


def dto_maps(lines: DataFrame) -> DataFrame:
    """ARC-208: three signatures or more of a file that pass maps."""
    hit = lines.where(F.col("text").rlike(r"\bMap<String,\s*Object>\s+\w+\s*[(,)]|->\s*dict\b|:\s*Dict\[str,\s*Any\]"))
    n = hit.groupBy("project", "path").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n >= 3")
    return _out(n, "ARC-208", "LOW", F.col("n").cast("string"))


def message_scatter(lines: DataFrame, messages: int = 12, files: int = 3) -> DataFrame:
    """ARC-209: many different exception messages over several files and no file that gathers them."""
    pattern = r"(?:raise\s+\w+|throw\s+new\s+\w+)\(\s*[\"']([^\"']+)[\"']"
    m = lines.where(F.col("text").rlike(pattern)).select("project", "path", "line", F.regexp_extract("text", pattern, 1).alias("m"))
    n = m.groupBy("project").agg(F.countDistinct("m").alias("n"), F.countDistinct("path").alias("f"), F.min(F.struct("path", "line")).alias("at")).where((F.col("n") >= messages) & (F.col("f") >= files))
    central = lines.where(F.col("path").rlike(r"(?i)(?:^|/)(?:errors?|messages?|error_?codes?)\.[a-z]+$")).select("project").distinct()
    return _out(n.join(central, "project", "left_anti").select("project", "n", "at.path", "at.line"), "ARC-209", "LOW", F.col("n").cast("string"))


def csrf_missing(lines: DataFrame) -> DataFrame:
    """IL-510: three routes that change state or more, and no sign of protection against forged requests."""
    change = r"methods\s*=\s*\[[^\]]*POST|@(?:Post|Put|Delete)Mapping|\b(?:app|router)\.(?:post|put|delete)\("
    n = lines.groupBy("project").agg(F.count_if(F.col("text").rlike(change)).alias("n")).where("n >= 3").select("project")
    return _out(_without(_first(lines, change).join(n, "project", "left_semi"), lines, r"(?i)csrf|SameSite|Bearer|jwt"), "IL-510", "MEDIUM")


def upload_checks(lines: DataFrame) -> DataFrame:
    """IL-530: uploads that are saved on the word of the client's content type, or without a list of extensions."""
    save = lines.groupBy("project", "path").agg(
        F.min(F.when(F.col("text").rlike(r"\.save\(|transferTo\(|writeFile\("), F.col("line"))).alias("line"), F.bool_or(F.col("text").rlike(r"request\.files|MultipartFile|multer\(")).alias("upload"),
        F.bool_or(F.col("text").rlike(r"content_type|getContentType\(|mimetype")).alias("trusts"), F.bool_or(F.col("text").rlike(r"(?i)allowed_ext|endswith\(|splitext|extname\(")).alias("listed"),
    ).where("upload AND line IS NOT NULL")
    sniffed = lines.where(F.col("text").rlike(r"\bmagic\b|filetype|Tika|file-type")).select("project").distinct()
    trusting = _out(save.where("trusts").join(sniffed, "project", "left_anti"), "IL-530", "MEDIUM", "client content type")
    return trusting.unionByName(_out(save.where("NOT listed"), "IL-530", "LOW", "no list of extensions"))


def login_limit(lines: DataFrame) -> DataFrame:
    """IL-532: login code and nothing in the project that limits attempts."""
    return _out(_without(_first(lines, r"(?i)def\s+login\b|[\"']/login[\"']|function\s+login\b"), lines, r"(?i)limiter|rate_?limit|throttl|lockout|axes"), "IL-532", "MEDIUM")


def routes(lines: DataFrame) -> DataFrame:
    """(project, path, line, method, route, sensitive, authenticated): authenticated is yes, no or unknown.

    A decorator or middleware on the route's line or the three around it answers; a file without any such marker leaves
    it unknown if the project has one elsewhere.
    """
    pattern = r"(?:@(?:\w+\.)?|\b(?:app|router)\.)(route|get|post|put|delete|patch)\(\s*[\"']([^\"']*)[\"']|@(Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\""
    near = Window.partitionBy("project", "path").orderBy("line").rowsBetween(-3, 3)
    marked = lines.withColumn("asks", F.max(F.col("text").rlike(AUTHENTICATED).cast("int")).over(near))
    anywhere = lines.where(F.col("text").rlike(AUTHENTICATED)).select("project", F.lit(True).alias("somewhere")).distinct()
    found = marked.where(F.col("text").rlike(pattern)).join(anywhere, "project", "left")
    route = F.concat(F.regexp_extract("text", pattern, 2), F.regexp_extract("text", pattern, 4))
    method = F.upper(F.concat(F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 3)))
    given = F.regexp_extract("text", r"methods\s*=\s*\[[^\]]*[\"'](POST|PUT|DELETE|PATCH)[\"']", 1)
    method = F.when(given != "", given).otherwise(method)
    state = F.when(F.col("asks") == 1, "yes").when(F.col("somewhere"), "unknown").otherwise("no")
    rows = found.select("project", "path", "line", method.alias("method"), route.alias("route"), state.alias("authenticated"))
    return rows.withColumn("sensitive", F.col("route").rlike(SENSITIVE) | F.col("method").isin("POST", "PUT", "DELETE", "PATCH"))


def unauthenticated(found: DataFrame) -> DataFrame:
    """IL-525: sensitive routes that nothing guards."""
    return _out(found.where("sensitive AND authenticated = 'no'"), "IL-525", "MEDIUM", F.col("route"))


def repeated_strings(lines: DataFrame, least: int = 4, files: int = 2, k: int = 15) -> DataFrame:
    """ARC-205: the string literals of eight characters or more that a project repeats most, over several files."""
    literal = lines.select("project", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[\"']([^\"'\\]{8,80})[\"']"), F.lit(1))).alias("v"))
    n = literal.groupBy("project", "v").agg(F.count("*").alias("n"), F.countDistinct("path").alias("f"), F.min(F.struct("path", "line")).alias("at")).where((F.col("n") >= least) & (F.col("f") >= files))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(F.col("n").desc(), "v"))).where(F.col("r") <= k)
    return _out(best.select("project", "v", "at.path", "at.line"), "ARC-205", "LOW", F.col("v"))


def devops(lines: DataFrame) -> DataFrame:
    """AI-110: images whose last stage never leaves the root user."""
    d = lines.where(F.col("kind") == "docker")
    last = d.groupBy("project", "path").agg(F.max(F.when(F.col("text").rlike(r"^\s*FROM\s"), F.col("line"))).alias("line"), F.max(F.when(F.col("text").rlike(r"^\s*USER\s+(?!root\b)\S"), F.col("line"))).alias("user"))
    return _out(last.where("line IS NOT NULL AND (user IS NULL OR user < line)"), "AI-110", "MEDIUM", "runs as root")


def attribute_keys(lines: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """ARC-210: keys of headers, sessions and attributes that a project spells out three times or more; its ten commonest."""
    pattern = r"(?:headers|session|attrs|cookies)\[[\"']([\w-]{3,})[\"']\]|\.(?:getHeader|setHeader|getAttribute|setAttribute|header)\(\s*[\"']([\w-]{3,})[\"']"
    asked = lines.where(F.col("text").rlike(pattern))
    keys = F.concat(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2)))
    each = asked.select("project", "path", "line", F.explode(F.filter(keys, lambda k: k != "")).alias("key"))
    counted = each.groupBy("project", "key").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("at")).where(F.col("n") >= least)
    place = Window.partitionBy("project").orderBy(F.col("n").desc(), "key")
    kept = counted.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= top)
    return _out(kept.select("project", "at.path", "at.line", "key"), "ARC-210", "LOW", F.col("key"))


def look_alike_packages(lines: DataFrame, popular: DataFrame) -> DataFrame:
    """AI-111: required packages whose name is one edit from a popular one. popular: (name)."""
    from palisade.operators import packages, similarity

    wanted = lines.where(F.lower("path").rlike(r"requirements[^/]*\.txt$"))
    named = packages.parse_requirements(wanted).select("path", F.lower("name").alias("name")).distinct()
    near = similarity.look_alikes(named, popular)
    at = wanted.select("project", "path").distinct()
    return _out(named.join(near, "name").join(at, "path").select("project", "path", F.lit(1).alias("line"), F.concat("name", F.lit(" ~ "), "popular").alias("what")), "AI-111", "MEDIUM", F.col("what"))


def import_cycles(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """ARC-203: one row a file of a circular import, named by the component. For one project's lines and modules."""
    from palisade.operators import graphs

    edges = graphs.python_imports(lines, modules)
    parts = graphs.strong_components(edges)
    first = lines.groupBy("path").agg(F.min("project").alias("project"))
    rows = parts.join(first, F.col("node") == F.col("path")).select("project", "path", F.lit(1).alias("line"), F.col("component").alias("what"))
    return _out(rows, "ARC-203", "MEDIUM", F.col("what"))


#: Layers from the outside in, by folder: an inner layer may not use an outer one.
LAYERS = ("api", "service", "domain", "data")


def layer_direction(lines: DataFrame, modules: DataFrame, layers: tuple = LAYERS) -> DataFrame:
    """ARC-207: imports from an inner layer of an outer one. For one project's lines and modules."""
    from palisade.operators import graphs

    edges = graphs.python_imports(lines, modules)
    rank = F.coalesce(*(F.when(F.col("path").rlike(rf"(?:^|/){name}s?/"), F.lit(i)) for i, name in enumerate(layers)))
    ranked = modules.select(F.col("path").alias("node"), rank.alias("rank")).where("rank IS NOT NULL").distinct()
    # a larger rank may not use a smaller one
    bad = graphs.layer_violations(edges, ranked)
    first = lines.groupBy("path").agg(F.min("project").alias("project"))
    rows = bad.join(edges, ["src", "dst"]).join(first, F.col("src") == F.col("path")).select("project", "path", "line", F.col("dst").alias("what"))
    return _out(rows, "ARC-207", "MEDIUM", F.col("what"))


def all_rules(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every project rule. files: project, path, text, language, kind, is_test; lines: project, path, line, text, kind."""
    parts = [
        committed_secret_files(files), row_level_security(lines), hardening_advice(lines), custom_tokens(files), framework_guard(lines), exception_handler(lines),
        version_mismatch(version_uses(lines)), single_admin_role(lines), mcp_config(files), layering(lines), no_tests(files), dto_maps(lines), message_scatter(lines), csrf_missing(lines),
        upload_checks(lines), login_limit(lines), unauthenticated(routes(lines)), repeated_strings(lines), devops(lines), attribute_keys(lines),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
