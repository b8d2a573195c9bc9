"""Project rules: each project is a rule's case, positive or negative."""

from palisade.operators import project
from palisade.sources import files as src
from pyspark.sql import functions as F

ROUTES = "\n".join(f"@app.route('/x{i}', methods=['POST'])\ndef f{i}(): pass" for i in range(5))
CASES = {
    "env": {".env": "API_TOKEN=abcdef123"}, "env-example": {".env.example": "API_TOKEN=abcdef123"},
    "rls": {"a.sql": "create table notes (id int);\n-- supabase\n"}, "rls-on": {"a.sql": "create table notes (id int);\nalter table notes enable row level security; -- supabase"},
    "express": {"a.js": "const app = express()"}, "helmet": {"a.js": "const app = express()\napp.use(helmet())"},
    "token": {"token.py": "import hmac\nx = t.split('.')"}, "handlers": {"a.py": ROUTES}, "handled": {"a.py": ROUTES + "\n@app.errorhandler(500)\n# csrf\n"},
    "versions": {"Dockerfile": "FROM python:3.9\nUSER app", "pyproject.toml": 'requires-python = ">=3.11"'}, "same": {"Dockerfile": "FROM python:3.12\nUSER app", "pyproject.toml": 'requires-python = ">=3.11"'},
    "admin": {"A.java": "\n".join(["hasRole('ADMIN')"] * 3)}, "roles": {"A.java": "hasRole('ADMIN')\nhasRole('ADMIN')\nhasRole('USER')"},
    "mcp": {"mcp.json": '{"mcpServers": {"a": {"command": "npx", "args": ["-y", "pkg"]}, "b": {"command": "npx", "args": ["-y", "pkg@1.2.3"]}, "c": {"url": "http://x.io", "env": {"API_KEY": "abc"}}}}'},
    "layer": {"a.py": "@app.route('/l')\ndef f():\n    cursor.execute('q')"}, "sources": {f"m{i}.py": "x = 1" for i in range(5)}, "tested": {**{f"m{i}.py": "x = 1" for i in range(5)}, "test_m.py": "assert 1"},
    "login": {"a.py": "def login(): pass"}, "limited": {"a.py": "limiter = 1\ndef login(): pass"}, "upload": {"a.py": "f = request.files['f']\nif f.content_type: f.save('x')"},
    "open": {"a.py": "@app.route('/admin')\ndef a(): pass"}, "guarded": {"a.py": "@app.route('/admin')\n@login_required\ndef a(): pass"}, "root": {"Dockerfile": "FROM x:1\nUSER app\nFROM y:1\n"},
    "keys": {"a.py": "headers['X-Team-Id']\nheaders['X-Team-Id'] = headers['X-Team-Id']\n"}, "few-keys": {"a.py": "headers['X-Team-Id']\n"},
    "literals": {f"f{i}.py": "x = 'repeated literal'\ny = 'repeated literal'" for i in range(2)},
}
EXPECTED = {
    "env": {"AI-104"}, "rls": {"AI-108"}, "express": {"AI-114"}, "token": {"AI-118"}, "handlers": {"AI-120", "IL-510", "IL-525"}, "handled": {"IL-525"}, "versions": {"AI-121"}, "admin": {"AI-122"}, "mcp": {"AIA-102"},
    "keys": {"ARC-210"}, "layer": {"ARC-202"}, "sources": {"ARC-206"}, "login": {"IL-532"}, "upload": {"IL-530"}, "open": {"IL-525"}, "root": {"AI-110"}, "literals": {"ARC-205"},
}


def test_cases(spark):
    rows = [(name, path, text) for name, files in CASES.items() for path, text in files.items()]
    raw = spark.createDataFrame(rows, "project string, path string, text string").withColumn("size", F.octet_length("text").cast("long"))
    files = src.described(raw)
    lines = src.lines(files, ("project", "path", "language", "kind", "is_test"))
    got = {}
    for r in project.all_rules(files, lines).collect():
        got.setdefault(r.project, set()).add(r.rule_id)
    assert got == EXPECTED


def test_mcp_notes(spark):
    raw = spark.createDataFrame([("p", "mcp.json", CASES["mcp"]["mcp.json"])], "project string, path string, text string").withColumn("size", F.lit(1).cast("long"))
    assert {r.note for r in project.mcp_config(src.described(raw)).collect()} == {"a: unpinned package", "c: plain http", "c: literal secret"}


def test_imports_and_packages(spark):
    texts = {
        "domains/order.py": "from apis.http import send\nimport domains.price", "domains/price.py": "import domains.order", "apis/http.py": "import services.mail", "services/mail.py": "x = 1",
        "requirements.txt": "requsts==2.0\nnumpy==2.0\n",
    }
    raw = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project string, path string, text string").withColumn("size", F.lit(1).cast("long"))
    lines = src.lines(src.described(raw), ("project", "path", "language", "kind", "is_test"))
    modules = spark.createDataFrame([(p[:-3].replace("/", "."), p) for p in texts if p.endswith(".py")], "module string, path string")
    rows = lambda df: sorted((r.path, r.line, r.rule_id, r.note) for r in df.collect())
    assert rows(project.import_cycles(lines, modules)) == [(p, 1, "ARC-203", "domains/price.py") for p in ("domains/order.py", "domains/price.py")]
    assert rows(project.layer_direction(lines, modules)) == [("domains/order.py", 1, "ARC-207", "apis/http.py")]
    popular = spark.createDataFrame([("requests",), ("numpy",)], "name string")
    assert rows(project.look_alike_packages(lines, popular)) == [("requirements.txt", 1, "AI-111", "requsts ~ requests")]
