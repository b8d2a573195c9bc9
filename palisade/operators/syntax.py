"""Rules over the syntax of Python files.

A file is parsed once, on the executor that holds it; the tables that come out (functions, calls, handlers, flows) are
relations, and the rules are filters, joins and aggregations over them. A file that can't be parsed is a diagnostic row.
The taint state of a call's argument is found by a forward pass over each function: assignments of tainted values taint
names, sanitizers clean them, branches join by union, loop bodies run twice.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.sources.package import ship

#: What brings outside input into a program, and what makes it safe in a context: fixed values.
SOURCES = re.compile(r"^(?:flask\.)?request\.(?:args|form|values|json|data|cookies|headers|files|GET|POST|body|query_params|get_json)\b|^input$|^sys\.argv\b|^os\.environ\b.*$(?<!environ)")
SANITIZERS = {
    "sql": re.compile(r"^(?:int|float|bool)$|\.quote_ident$"),
    "command": re.compile(r"^(?:shlex\.)?quote$|^(?:int|float|bool)$"),
    "path": re.compile(r"(?:^|\.)(?:secure_filename|basename)$|^(?:int|float|bool)$"),
    "html": re.compile(r"(?:^|\.)(?:escape|clean)$|^(?:int|float|bool)$"),
    "code": re.compile(r"^(?:int|float|bool)$|(?:^|\.)literal_eval$"),
    "url": re.compile(r"^(?:int|float|bool)$"),
    "ldap": re.compile(r"^(?:int|float|bool)$|(?:^|\.)escape_(?:filter|dn)_chars$"),
    "header": re.compile(r"^(?:int|float|bool)$|(?:^|\.)quote$"),
    "upload": re.compile(r"(?:^|\.)(?:secure_filename|uuid\d|token_hex)$|^(?:int|float|bool)$"),
    "xpath": re.compile(r"^(?:int|float|bool)$"),
    "log": re.compile(r"^(?:int|float|bool|repr|len)$"),
    "lookup": re.compile(r"^(?:bool|len)$"),
    "session": re.compile(r"^(?:int|float|bool|len)$|(?:^|\.)(?:validate|clean|is_valid)\w*$"),
    "model": re.compile(r"^(?:int|float|bool|len)$"),
}
#: Calls of language models, and the arguments that bound what they answer.
MODEL = re.compile(r"(?:^|\.)(?:completions|messages|responses|ChatCompletion)\.create$|(?:^|\.)generate_content$")
BOUNDS = {"max_tokens", "max_output_tokens", "max_completion_tokens", "generation_config"}
PERSONAL = re.compile(r"(?i)(?:^|[._])(?:ssn|email|e_mail|phone\w*|birth\w*|passport\w*|resident\w*|card_number|home_address)$")
SENSITIVE = re.compile(r"(?i)(?:^|[._])(?:password|passwd|pwd|secret|api_?key|access_token|private_key|ssn|card_number)$")
DECISION = re.compile(r"(?i)\b(?:is_?admin|is_?staff|role|privileges?|permissions?)\b")
OWNED = re.compile(r"(?i)owner|user_id|current_user|request\.user|g\.user|permission|authori[sz]e|belongs_to")
CRITICAL_NAME = re.compile(r"(?i)pay|charge|transfer|refund|balance|auth|verify|login|permission|withdraw")
#: Rules whose sink is any tainted argument of a call: rule, context, severity, callee.
ANY_SINKS = (
    ("IL-508", "ldap", "HIGH", re.compile(r"(?:^|\.)search_(?:s|st|ext|ext_s)$|(?i:ldap\w*)\.search$")),
    ("IL-511", "header", "MEDIUM", re.compile(r"\.headers\.(?:add|set|extend|setdefault)$")),
    ("IL-513", "upload", "HIGH", re.compile(r"\.save$")),
    ("IL-527", "xpath", "HIGH", re.compile(r"(?:^|\.)(?:xpath|XPath|evaluate_xpath)$")),
    ("AI-112", "log", "HIGH", re.compile(r"(?:^|\.)(?:debug|info|warning|warn|error|exception|critical)$")),
    ("AI-113", "lookup", "MEDIUM", re.compile(r"(?:^|\.)(?:get_object_or_404|objects\.get|query\.get|get_or_404|find_by_id|find_one)$")),
)
CAPS = {"AI-101": 25, "ARC-211": 15}
SINKS = (
    ("IL-501", "sql", "CRITICAL", re.compile(r"(?:^|\.)(?:execute|executemany|executescript|raw)$")),
    ("IL-502", "path", "HIGH", re.compile(r"^(?:open|io\.open|os\.(?:remove|unlink|listdir|rename)|shutil\.(?:copy|move|rmtree)|send_file)$")),
    ("IL-503", "code", "CRITICAL", re.compile(r"^(?:eval|exec|compile|__import__)$")),
    ("IL-504", "command", "CRITICAL", re.compile(r"^(?:os\.(?:system|popen)|subprocess\.(?:run|call|check_call|check_output|Popen|getoutput))$")),
    ("IL-505", "html", "HIGH", re.compile(r"(?:^|\.)(?:render_template_string|Markup|mark_safe)$")),
    ("IL-506", "url", "HIGH", re.compile(r"^(?:requests|httpx)\.(?:get|post|put|delete|head|patch|request)$|(?:^|\.)urlopen$")),
    ("IL-507", "url", "MEDIUM", re.compile(r"^(?:flask\.)?redirect$|HttpResponseRedirect$")),
)
LOGS = re.compile(r"(?:^|\.)(?:debug|info|warning|warn|error|exception|critical|log|print|print_exc|capture_exception)$")
AUTH = re.compile(r"(?i)^(?:is_?(?:admin|auth\w*|logged\w*|allowed|owner)|(?:check|verify|has|require)_?\w*(?:auth|perm|access|token|login)\w*|authenticate|authorize)")
DB = re.compile(r"(?:^|\.)(?:execute|query|filter|get_or_404|fetchone|fetchall|find_one|objects\.\w+)$")


def dotted(node: ast.AST) -> str:
    """The name that an expression spells: a.b.c, with () for calls inside."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return dotted(node.func) + "()"
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    return ""


DEPTH = 4


class _Taint:
    """May-taint of names within one function; one context at a time.

    Calls of functions of the same file are followed DEPTH levels down: their results are tainted if a return is, given
    the arguments, and sinks that an argument reaches inside are hits of the caller.
    """

    def __init__(self, context: str, seeds: set[str], helpers: dict | None = None, depth: int = DEPTH, active: tuple = (), sources: re.Pattern = SOURCES):
        self.context, self.names, self.hits, self.sources = context, set(seeds), [], sources
        self.calls, self.stores, self.tests, self.dicts = [], [], [], []  # what is seen, each with whether it is tainted
        self.helpers, self.depth, self.active, self.returns = helpers or {}, depth, active, False
        self.known: dict = {}

    def follow(self, call: ast.Call) -> "_Taint | None":
        """The flow of a helper that is called with tainted arguments."""
        f = self.helpers.get(dotted(call.func))
        if f is None or not self.depth or f.name in self.active:
            return None
        names = [a.arg for a in f.args.posonlyargs + f.args.args]
        seeds = {n for n, a in zip(names, call.args) if self.tainted(a)} | {k.arg for k in call.keywords if k.arg and self.tainted(k.value)}
        if not seeds and not any(isinstance(n, ast.Return) and n.value is not None for n in ast.walk(f)):
            return None
        key = (f.name, frozenset(seeds))
        if key not in self.known:
            self.known[key] = inner = _Taint(self.context, seeds, self.helpers, self.depth - 1, (*self.active, f.name), self.sources)
            inner.run(f.body)
        return self.known[key]

    def tainted(self, e: ast.AST | None) -> bool:
        if e is None or isinstance(e, ast.Constant):
            return False
        if isinstance(e, ast.Call):
            name = dotted(e.func)
            if SANITIZERS[self.context].search(name):
                return False
            if self.sources.search(name) if self.sources is MODEL else self.sources.match(name):
                return True
            if name in self.helpers:
                flow = self.follow(e)
                if flow is not None:
                    return flow.returns
            inner = [*e.args, *(k.value for k in e.keywords)]
            return any(map(self.tainted, inner)) or (isinstance(e.func, ast.Attribute) and self.tainted(e.func.value))
        name = dotted(e)
        if name and self.sources.match(name):
            return True
        if isinstance(e, ast.Name):
            return e.id in self.names
        if isinstance(e, ast.Compare | ast.Lambda):
            return False
        return any(self.tainted(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr | ast.FormattedValue | ast.comprehension))

    def assign(self, target: ast.AST, dirty: bool) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name):
                (self.names.add if dirty else self.names.discard)(n.id)

    def look(self, statement: ast.AST) -> None:
        for n in ast.walk(statement):
            if isinstance(n, ast.Call):
                flow = self.follow(n)
                if flow is not None:
                    self.hits += [h for h in flow.hits if h[1]]
                self.calls.append((n, any(map(self.tainted, [*n.args, *(k.value for k in n.keywords)]))))
                self.hits.append((n, any(map(self.tainted, n.args[:1])) or any(self.tainted(k.value) for k in n.keywords if k.arg in ("url", "args", "file", "sql"))))

            elif isinstance(n, ast.Dict):
                said = {k.value: v for k, v in zip(n.keys, n.values) if isinstance(k, ast.Constant)}
                role = said.get("role")
                if isinstance(role, ast.Constant) and role.value in ("system", "developer"):
                    self.dicts.append((n, self.tainted(said.get("content"))))

    def run(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(s, ast.Assign | ast.AnnAssign | ast.AugAssign):
                self.look(s)
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                dirty = self.tainted(s.value) or (isinstance(s, ast.AugAssign) and self.tainted(s.target))
                for t in targets:
                    if isinstance(t, ast.Subscript):
                        self.stores.append((t, dirty))
                    else:
                        self.assign(t, dirty)
            elif isinstance(s, ast.If):
                self.look(s.test)
                self.tests.append((s, any(self.tainted(n) for n in ast.walk(s.test) if isinstance(n, ast.Name | ast.Attribute | ast.Call | ast.Subscript))))
                before = set(self.names)
                if not (isinstance(s.test, ast.Constant) and not s.test.value):
                    self.run(s.body)
                after, self.names = self.names, before
                if not (isinstance(s.test, ast.Constant) and s.test.value):
                    self.run(s.orelse)
                self.names = after | self.names
            elif isinstance(s, ast.For | ast.AsyncFor | ast.While):
                head = s.iter if not isinstance(s, ast.While) else s.test
                self.look(head)
                before = set(self.names)
                for _ in range(2):
                    if not isinstance(s, ast.While):
                        self.assign(s.target, self.tainted(s.iter))
                    self.run(s.body)
                self.names |= before
                self.run(s.orelse)
            elif isinstance(s, ast.With | ast.AsyncWith):
                for i in s.items:
                    self.look(i.context_expr)
                    if i.optional_vars is not None:
                        self.assign(i.optional_vars, self.tainted(i.context_expr))
                self.run(s.body)
            elif isinstance(s, ast.Try):
                before = set(self.names)
                self.run(s.body)
                done = set(self.names)
                for h in s.handlers:
                    self.names = before | done
                    self.run(h.body)
                    done |= self.names
                self.names = done
                self.run(s.orelse)
                self.run(s.finalbody)
            else:
                if isinstance(s, ast.Return):
                    self.returns |= self.tainted(s.value)
                self.look(s)


def _depth(node: ast.AST, level: int = 0) -> int:
    deeper = level + isinstance(node, ast.If | ast.For | ast.While | ast.With | ast.Try)
    return max([deeper, *(_depth(c, deeper) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))])


def findings_of(text: str, is_test: bool) -> list[tuple[str, str, int, str]]:
    """(rule, severity, line, note) of a Python file's syntax rules; raises SyntaxError."""
    tree = ast.parse(text)
    out: list[tuple[str, str, int, str]] = []
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    add = lambda rule, severity, node, note="": out.append((rule, severity, node.lineno, note))
    calls_in = lambda n: [c for c in ast.walk(n) if isinstance(c, ast.Call)]

    for t in (n for n in ast.walk(tree) if isinstance(n, ast.Try)):
        imports_only = all(isinstance(s, ast.Import | ast.ImportFrom) for s in t.body)
        for h in t.handlers:
            kinds = [dotted(x) for x in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])] if h.type else ["BaseException"]
            logged = any(LOGS.search(dotted(c.func)) for c in calls_in(h))
            raised = any(isinstance(x, ast.Raise) for x in ast.walk(h))
            used = bool(h.name) and any(isinstance(x, ast.Name) and x.id == h.name for s in h.body for x in ast.walk(s))
            trivial = all(
                isinstance(s, ast.Pass | ast.Continue | ast.Break) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))
                or (isinstance(s, ast.Return) and (s.value is None or isinstance(s.value, ast.Constant))) or (isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant))
                for s in h.body
            )
            if trivial and not (logged or raised or used) and not (imports_only and set(kinds) <= {"ImportError", "ModuleNotFoundError"}):
                add("IL-301", "HIGH", h)
            if {"Exception", "BaseException"} & set(kinds) and not raised:
                add("IL-304", "MEDIUM", h)
            for s in h.body:
                if h.name and isinstance(s, ast.Return) and s.value is not None:
                    shown = any(isinstance(c, ast.Call) and dotted(c.func).split(".")[-1] in ("jsonify", "JsonResponse", "HttpResponse", "make_response", "JSONResponse") and any(isinstance(x, ast.Name) and x.id == h.name for x in ast.walk(c)) for c in ast.walk(s.value))
                    if shown:
                        add("IL-305", "MEDIUM", s)

    helpers = {f.name: f for f in functions}

    def asserts(f: ast.AST, left: int = 4) -> bool:
        for n in ast.walk(f):
            if isinstance(n, ast.Assert):
                return True
            if isinstance(n, ast.Call):
                name = dotted(n.func)
                if re.search(r"(?:^|\.)(?:assert\w*|raises|warns|fail|expect)$", name) or (left and name in helpers and helpers[name] is not f and asserts(helpers[name], left - 1)):
                    return True
        return False

    for f in functions:
        body = [s for s in f.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        if AUTH.match(f.name) and (not body or (len(body) == 1 and (isinstance(body[0], ast.Pass) or (isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Constant) and body[0].value.value is True)))):
            add("IL-303", "CRITICAL", f)
        if is_test and f.name.startswith("test") and not asserts(f):
            add("IL-306", "MEDIUM", f)
        length, params = (f.end_lineno or f.lineno) - f.lineno + 1, len(f.args.posonlyargs + f.args.args + f.args.kwonlyargs)
        if length > 80 or params > 7 or max((_depth(s) for s in f.body), default=0) > 4:
            add("ARC-201", "LOW", f, f"{length} lines, {params} parameters")
        loops = [n for n in ast.walk(f) if isinstance(n, ast.For | ast.While | ast.AsyncFor)]
        inside = {id(c) for loop in loops for s in loop.body for c in calls_in(s)}
        db = [c for c in calls_in(f) if DB.search(dotted(c.func))]
        for line in sorted({c.lineno for c in db if id(c) in inside}):
            out.append(("ARC-212", "MEDIUM", line, ""))
        outside = [c for c in db if id(c) not in inside]
        if len(outside) >= 5:
            out.append(("PERF-101", "MEDIUM" if len(outside) >= 10 else "LOW", min(c.lineno for c in outside), str(len(outside))))
        for loop in loops:
            if any(isinstance(n, ast.For) and n is not loop and dotted(n.iter) and dotted(n.iter) != dotted(getattr(loop, "iter", loop)) and not dotted(n.iter).startswith(dotted(getattr(loop, "target", loop)) + ".") and dotted(n.iter) != dotted(getattr(loop, "target", loop)) for s in loop.body for n in ast.walk(s)):
                add("PERF-102", "LOW", loop)
            for line in sorted({c.lineno for s in loop.body for c in calls_in(s) if re.match(r"^(?:requests|httpx)\.(?:get|post|put|delete)$|.*urlopen$", dotted(c.func))}):
                out.append(("PERF-103", "LOW", line, ""))
            if isinstance(loop, ast.While) and isinstance(loop.test, ast.Constant) and loop.test.value and not any(isinstance(n, ast.Break | ast.Return | ast.Raise | ast.Yield) for s in loop.body for n in ast.walk(s)):
                add("IL-517", "LOW", loop)
        if isinstance(f, ast.AsyncFunctionDef):
            for c in calls_in(f):
                if re.match(r"^(?:time\.sleep|requests\.\w+|subprocess\.(?:run|call|check_output)|os\.system)$", dotted(c.func)):
                    add("PERF-105", "MEDIUM", c)
        managed = {id(i.context_expr) for n in ast.walk(f) if isinstance(n, ast.With | ast.AsyncWith) for i in n.items}
        closed = {dotted(c.func)[: -len(".close")] for c in calls_in(f) if dotted(c.func).endswith(".close")}
        returned = {n.value.id for n in ast.walk(f) if isinstance(n, ast.Return) and isinstance(n.value, ast.Name)}
        for n in ast.walk(f):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func) in ("open", "socket.socket", "sqlite3.connect") and id(n.value) not in managed:
                names = {dotted(t) for t in n.targets}
                if not names & closed and not names & returned and not any(x.startswith("self.") for x in names):
                    add("IL-518", "MEDIUM", n)
        checks = [(c.lineno, ast.dump(c.args[0])) for c in calls_in(f) if c.args and re.match(r"^os\.(?:path\.(?:exists|isfile)|access)$", dotted(c.func))]
        for c in calls_in(f):
            if c.args and dotted(c.func) in ("open", "os.remove", "os.unlink", "os.rename") and any(a == ast.dump(c.args[0]) and line < c.lineno for line, a in checks):
                add("IL-516", "MEDIUM", c)
        for n in ast.walk(f):
            if isinstance(n, ast.Attribute) and n.attr in ("group", "groups", "start", "end") and isinstance(n.value, ast.Call) and re.match(r"^re\.(?:match|search|fullmatch)$", dotted(n.value.func)):
                add("IL-519", "MEDIUM", n)

    for c in calls_in(tree):
        name = dotted(c.func)
        loader = any(k.arg == "Loader" and "Safe" in dotted(k.value) for k in c.keywords)
        if re.match(r"^(?:pickle|cPickle|dill|marshal|shelve)\.(?:loads?|open)$", name) or (name == "yaml.load" and not loader and not any("Safe" in dotted(a) for a in c.args[1:])):
            add("IL-515", "HIGH", c)
    for n in ast.walk(tree):
        if isinstance(n, ast.If) and any(re.search(r"gethostby(?:addr|name)$", dotted(c.func)) for c in calls_in(n.test)):
            add("IL-523", "MEDIUM", n)

    scopes = [(tree.body, set())] + [(f.body, set()) for f in functions]
    for context in SANITIZERS:
        for body, seeds in scopes:
            flow = _Taint(context, seeds, helpers)
            flow.run(body)
            for call, dirty in flow.hits:
                name = dotted(call.func)
                for rule, kind, severity, pattern in SINKS:
                    if kind != context or not dirty or not pattern.search(name):
                        continue
                    if kind == "command" and name.startswith("subprocess.") and not any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value for k in call.keywords):
                        continue  # an argument array without a shell
                    add(rule, severity, call, name)
    out += _boundary_findings(tree, functions, helpers)
    kept, count = [], dict.fromkeys(CAPS, 0)
    for x in sorted(set(out), key=lambda x: (x[2], x[0])):
        count[x[0]] = count.get(x[0], 0) + 1
        if count[x[0]] <= CAPS.get(x[0], count[x[0]]):
            kept.append(x)
    return kept


def _boundary_findings(tree: ast.Module, functions: list, helpers: dict) -> list[tuple[str, str, int, str]]:
    """Rules on what crosses a boundary (headers, sessions, logs, models, stores), and on calls and constants by their form."""
    out: list[tuple[str, str, int, str]] = []
    add = lambda rule, severity, node, note="": out.append((rule, severity, node.lineno, note))
    scopes = [(tree.body, ""), *((f.body, ast.unparse(f)) for f in functions)]
    names = lambda n: {dotted(x) for x in ast.walk(n) if isinstance(x, ast.Name | ast.Attribute)} | {x.value for x in ast.walk(n) if isinstance(x, ast.Constant) and isinstance(x.value, str)}

    for context in sorted({c for _, c, _, _ in ANY_SINKS} | {"session", "model"}):
        for body, source in scopes:
            flow = _Taint(context, set(), helpers)
            flow.run(body)
            for call, dirty in flow.calls:
                name = dotted(call.func)
                for rule, kind, severity, pattern in ANY_SINKS:
                    if kind == context and dirty and pattern.search(name) and not (rule == "AI-113" and OWNED.search(source)):
                        add(rule, severity, call, name)
                if context == "model" and MODEL.search(name):
                    given = {k.arg for k in call.keywords}
                    if dirty and not given & BOUNDS:
                        add("AIA-108", "MEDIUM", call, name)
                    if any(k.arg in ("system", "instructions", "system_instruction") and flow.tainted(k.value) for k in call.keywords):
                        add("AIA-104", "MEDIUM", call, name)
            for target, dirty in flow.stores:
                where = dotted(target)
                if dirty and context == "session" and re.search(r"(?:^|\.)session$", where):
                    add("IL-526", "MEDIUM", target, where)
                if dirty and context == "header" and where.endswith(".headers"):
                    add("IL-511", "MEDIUM", target, where)
            if context == "model":
                for d, dirty in flow.dicts:
                    if dirty:
                        add("AIA-104", "MEDIUM", d, "system")
            if context == "session":
                for test, dirty in flow.tests:
                    if dirty and DECISION.search(ast.unparse(test.test)):
                        add("IL-512", "HIGH", test)
    for body, _ in scopes:
        flow = _Taint("model", set(), helpers, sources=MODEL)
        flow.run(body)
        for call, dirty in flow.hits:
            if dirty and any(pattern.search(dotted(call.func)) for rule, _, _, pattern in SINKS if rule in ("IL-501", "IL-503", "IL-504")):
                add("AIA-103", "HIGH", call, dotted(call.func))

    quiet: set[int] = set()  # constants inside of logging calls and raised exceptions
    for n in ast.walk(tree):
        if isinstance(n, ast.Raise) or (isinstance(n, ast.Call) and LOGS.search(dotted(n.func))):
            quiet |= {id(x) for x in ast.walk(n)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in quiet:
            if re.match(r"https?://(?!localhost|127\.|0\.0\.0\.0|example\.|www\.w3\.org|schemas?\.)[\w.-]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?$|/(?:home|Users)/\w|[A-Z]:\\\\?\w", n.value) and n.value not in ("127.0.0.1", "0.0.0.0"):
                add("AI-101", "MEDIUM", n)
        if not isinstance(n, ast.Call):
            continue
        name, given = dotted(n.func), {k.arg: k.value for k in n.keywords}
        on = lambda k: isinstance(given.get(k), ast.Constant) and given[k].value is True  # noqa: B023, E731
        if name.split(".")[-1] == "set_cookie" and None not in given and not (on("secure") and on("httponly")):
            add("AI-115", "MEDIUM", n)
        if re.search(r"(?:^|\.)(?:debug|info|warning|warn|error|critical)$", name) and any(SENSITIVE.search(x) for a in [*n.args, *given.values()] for x in names(a) if " " not in x):
            add("AI-112", "HIGH", n, "sensitive name")
        if MODEL.search(name) and any(PERSONAL.search(x) for a in [*n.args, *given.values()] for x in names(a) if " " not in x):
            add("AIA-109", "MEDIUM", n)
        if re.search(r"(?:objects|query)(?:\(\))?\.all$", name):
            add("PERF-104", "LOW", n, name)
        first = n.args[0] if n.args else None
        if re.search(r"(?:^|\.)execute$", name) and isinstance(first, ast.Constant) and isinstance(first.value, str) and re.match(r"(?is)\s*select\b.*\bfrom\b", first.value) and not re.search(r"(?i)\b(?:where|limit|fetch|top|count\s*\()", first.value):
            add("PERF-104", "LOW", n, name)
    for f in functions:
        for n in ast.walk(f):
            if isinstance(n, ast.Call) and (dotted(n.func) in ("requests.Session", "httpx.Client", "boto3.client", "OpenAI", "create_engine") or dotted(n.func) == "re.compile" and n.args and isinstance(n.args[0], ast.Constant)):
                add("ARC-211", "LOW", n, dotted(n.func))
            if isinstance(n, ast.ExceptHandler) and CRITICAL_NAME.search(f.name) and not any(isinstance(x, ast.Call) and LOGS.search(dotted(x.func)) for x in ast.walk(n)):
                if any(isinstance(x, ast.Return) and (x.value is None or isinstance(x.value, ast.Constant | ast.List | ast.Dict) and not (isinstance(x.value, ast.Constant) and x.value.value is False)) for x in n.body):
                    add("IL-307", "MEDIUM", n, f.name)
    return out


def python_findings(files: DataFrame) -> DataFrame:
    """(path, rule_id, severity, line, note) of Python files; rule_id PARSE is the diagnostic of one that can't be parsed,
    SKIPPED that of one that isn't analysed, with the reason as its note."""

    ship(files.sparkSession)

    def run(batches):
        for got in batches:
            rows = []
            for path, text, test in zip(*(c.to_pylist() for c in got.columns)):
                try:
                    rows += [(path, *f) for f in findings_of(text, test)]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # the parser's stack overflows as a MemoryError
                    rows.append((path, "PARSE", "LOW", getattr(e, "lineno", None) or 1, type(e).__name__))
            names = ["path", "rule_id", "severity", "line", "note"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    python = files.where(F.col("language") == "python").withColumn("skipped", F.when(F.col("text").isNull(), "unreadable").otherwise(F.col("skipped")))
    found = python.where(F.col("skipped").isNull()).select("path", "text", "is_test").mapInArrow(run, "path string, rule_id string, severity string, line int, note string")
    skipped = python.where(F.col("skipped").isNotNull())
    return found.unionByName(skipped.select("path", F.lit("SKIPPED").alias("rule_id"), F.lit("LOW").alias("severity"), F.lit(1).alias("line"), F.col("skipped").alias("note")))


FAMILIES = {"IL-501": "sql", "IL-502": "path", "IL-504": "command"}


def points_of(text: str) -> list[tuple[str, int, int, str, str, str]]:
    """(family, line, column, callee, state, evidence) of every call that a family's sink names.

    evidence_met: tainted (a finding), closed (only literals reach it) or sanitized (a cleaning call makes it);
    unresolved: whatever else is dynamic. Nothing that isn't understood counts as clean.
    """
    tree = ast.parse(text)
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    helpers = {f.name: f for f in functions}
    out = []
    for rule, context, _, pattern in SINKS:
        family = FAMILIES.get(rule)
        if not family:
            continue
        dirty: dict[tuple[int, int], bool] = {}
        for body in [tree.body, *(f.body for f in functions)]:
            flow = _Taint(context, set(), helpers)
            flow.run(body)
            for call, hit in flow.hits:
                at = (call.lineno, call.col_offset)
                dirty[at] = dirty.get(at, False) or hit
        for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call) and pattern.search(dotted(n.func)) and dotted(n.func) not in helpers):
            first = call.args[0] if call.args else None
            leaves = [n for n in ast.walk(first) if isinstance(n, ast.expr)] if first is not None else []
            if dirty.get((call.lineno, call.col_offset)):
                state, evidence = "evidence_met", "finding"
            elif first is None or all(isinstance(n, ast.Constant | ast.List | ast.Tuple | ast.JoinedStr | ast.BinOp) for n in leaves):
                state, evidence = "evidence_met", "closed_value"
            elif isinstance(first, ast.Call) and SANITIZERS[context].search(dotted(first.func)):
                state, evidence = "evidence_met", "declared_sanitizer"
            else:
                state, evidence = "unresolved", ""
            out.append((family, call.lineno, call.col_offset, dotted(call.func), state, evidence))
    return sorted(out)


def python_points(files: DataFrame) -> DataFrame:
    """(id, path, family, line, column, callee, state, evidence, in_scope): the interest points of Python files.

    A file that can't be parsed has one unsupported point a family.
    """
    from palisade.functions.scalars import digest

    ship(files.sparkSession)

    def run(batches):
        for got in batches:
            rows = []
            for path, text, test in zip(*(c.to_pylist() for c in got.columns)):
                try:
                    rows += [(path, *p, not test) for p in points_of(text)]
                except (SyntaxError, ValueError, RecursionError):
                    rows += [(path, f, 1, 0, "", "unsupported", "", not test) for f in FAMILIES.values()]
            names = ["path", "family", "line", "column", "callee", "state", "evidence", "in_scope"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    wanted = files.where((F.col("language") == "python") & F.col("skipped").isNull() & F.col("text").isNotNull())
    points = wanted.select("path", "text", "is_test").mapInArrow(run, "path string, family string, line int, column int, callee string, state string, evidence string, in_scope boolean")
    return points.withColumn("id", digest(12, "family", "path", "line", "column", "callee"))
