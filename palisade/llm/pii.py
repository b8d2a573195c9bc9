"""Personal data by candidate gradient boosting. DataFrame operations only on the data's path.

Base matches (e-mail addresses, IPv4 addresses, card numbers, international phone numbers) are found by fixed patterns
and always kept. Around them, high-recall generators propose further and overlapping spans: obfuscated addresses, cards
with other separators, national phone numbers, and secrets (assigned passwords and tokens, access keys, long mixed
strings). Boosted trees score each proposal from its format and the text before and after it, and the proposals above a
calibrated threshold are added where they overlap no base match.

The trees are fitted on the driver to `SAMPLE` seeded texts that hold one item each whose class is known: the generators
run over these texts and the features are computed by the same expressions as on documents. A threshold for each kind is
calibrated on the other half so that at most `FALSE_RATE` of its ordinary proposals pass, and the ensemble becomes one
expression.

Matching is a replacement by Java's forms of the patterns that take linear time: a match can only begin where its first
run of characters begins or where the last match ended, repetitions are possessive, and the one of phone numbers, which
has to give back what follows its last digit, begins at a plus sign that it can't cross. Places come from cutting the
marked text into strings of equal length, and scans over spans keep no arrays; the time is in proportion to a text's
length however many matches it holds, but for array copies at the speed of memory in `redact`.

Defined cases: a null text has no spans (and stays null when redacted); positions are code points; repeated rows stay;
other columns are kept by `redact` and ignored by `find`; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns. A card has 13 digits or more, which is looked up before anything is built.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){12})[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals: kind, pattern, and a cheap test that a text may hold one.
GENERATORS = (
    (
        "email",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
        r"(?i)[(\[{]at[)\]}]",
    ),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])", r"[0-9][\[(](?:\.|dot)[\])]"),
    ("card", r"(?<![0-9])[0-9]{4}([._/]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"[0-9]{4}(?:[._/]|  )[0-9]{4}"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[ .-][0-9]{4}"),
    (
        "secret",
        r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|(?:api|access|auth|private)[_ -]?key) ?[=:] ?[\"']?[a-z0-9+/_.!@#$%^&*-]{6,}+[\"']?",
        r"(?i)(?:passw|pwd|secret|token|key) ?(?:or)?d? ?[=:]",
    ),
    (
        "secret",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,199}[0-9])(?=[0-9+/_-]{0,199}[A-Za-z])[A-Za-z0-9+/_-]{20,200}+(?![A-Za-z0-9+/_-])",
        r"[A-Za-z0-9+/_-]{20}",
    ),
)
MARK, OTHER, AROUND, CHUNK, BLOCK = "\x01", "\x02", 24, 128, 512
SAMPLE, TREES, DEPTH, RATE, FALSE_RATE, SEED = 3200, 30, 3, 0.4, 0.01, 7
WORDS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("key", "login", "credential", "secret", "token", "password"),
}
PLAIN = ("order", "invoice", "part", "version", "item", "code", "ref", "no.", "page", "id", "commit", "sha256", "digest", "file", "see")
#: What follows a number that counts or measures something.
UNITS = ("pcs", "items", "units", "pages", "kg", "km", "eur", "usd", "times", "rows", "bytes")
FEATURES = ("digits", "marks", "luhn", "word", "plain", "joined", "same", "unit", "mixed", "upper", "named", "form", "letters")
#: Forms of access keys that their issuers document: fixed values.
ISSUED = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$"


# --- what the trees learn from -------------------------------------------------------------------------------------


def _texts(rng: random.Random, count: int) -> list[tuple[str, int]]:
    """(text with one item, whether the item is personal or secret)."""
    syllable = lambda: rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "n", "r", "s", "t"))
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 3)))
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    from_ = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(body))
        return body + str(-total % 10)

    def item(kind: str, y: bool) -> str:
        if kind == "email":
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] ")))
            return f"{word()}{rng.choice(('', '.' + word(), digits(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'example', 'net'))}" if y else f"{word()} (at) {digits(2)}.{digits(2)}"
        if kind == "ip":
            dot = rng.choice(("[.]", "(.)", "[dot]"))
            one = str(rng.randint(1, 9))
            return dot.join(str(rng.randint(0, 255)) for _ in range(4)) if y else dot.join((one, one, one, one) if rng.random() < 0.3 else (digits(1) for _ in range(4)))
        if kind == "card":
            n, mark = (card() if y else digits(16)), rng.choice(("_", ".", "/", "  "))
            return mark.join(n[i : i + 4] for i in (0, 4, 8, 12))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            if not y and rng.random() < 0.2:
                a, b, c = a[0] * 3, a[0] * 3, a[0] * 4
            return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))
        name = rng.choice(("password", "passwd", "secret", "token", "api_key", "access key"))
        joint, quote = rng.choice(("=", ": ", " = ")), rng.choice(("", '"'))
        if y:
            value = rng.choice((
                from_("0123456789abcdef", rng.choice((18, 20, 32, 40))), from_(string.ascii_letters + string.digits, rng.randint(10, 40)), word() + digits(3) + "!",
            ))
            return rng.choice((f"{name}{joint}{quote}{value}{quote}",) * 2 + ("AKIA" + from_(string.ascii_uppercase + string.digits, 16), "sk-" + from_(string.ascii_letters + string.digits, 32)))
        return rng.choice((
            f"{name}{joint}{rng.choice(('required', 'optional', 'missing', 'string', 'unknown', word() + word() + 'ing'))}",
            from_("0123456789abcdef", rng.choice((32, 40, 64))), "-".join(word() for _ in range(6)) + digits(1), "/".join(word() for _ in range(7)) + digits(2),
            word() + "_" * 20 + digits(2), digits(rng.randint(20, 30)) + rng.choice("abc"), "".join(word().title() for _ in range(6)) + digits(1),
        ))

    out = []
    for _ in range(count):
        y, kind = rng.random() < 0.5, rng.choice(KINDS)
        lead, u = word(), rng.random()
        if u < (0.5 if y else 0.005):
            lead = rng.choice(WORDS[kind])
        elif not y and u < 0.5:
            lead = rng.choice(PLAIN)
        glue = rng.choice("#$/_=x") if not y and rng.random() < 0.2 else " "
        after = rng.choice(UNITS) if not y and rng.random() < 0.25 else word()
        out.append((f"{word()} {word()}, {word()} {lead}{glue}{item(kind, y)} {after} {word()} {word()}.", int(y)))
    return out


def _tree(rows: list, grad: list[float], hess: list[float], depth: int):
    g, h = sum(grad), sum(hess)
    best = None
    if depth and len(rows) > 20:
        for f in range(len(FEATURES)):
            sums: dict[float, list[float]] = {}
            for i, r in enumerate(rows):
                s = sums.setdefault(r[f], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for cutoff in sorted(sums)[:-1]:
                gl, hl = gl + sums[cutoff][0], hl + sums[cutoff][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, cutoff)
    if best is None:
        return -g / (h + 1)
    _, f, cutoff = best
    sides = [[i for i, r in enumerate(rows) if (r[f] <= cutoff) == low] for low in (True, False)]
    return (f, cutoff, *(_tree([rows[i] for i in s], [grad[i] for i in s], [hess[i] for i in s], depth - 1) for s in sides))


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


_MODEL: list = []


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """(trees, threshold on their sum for each kind), fitted and calibrated on separate halves of the seeded texts' proposals."""
    if not _MODEL:
        made = _texts(random.Random(SEED), SAMPLE)
        text = F.split(F.lit("\n".join(t for t, _ in made)), "\n")
        rows = spark.range(1).select(F.posexplode(text).alias("at", "t"))
        found = _proposed(_marked(rows, F.col("t"), GENERATORS, "p")).select("at", F.explode("__proposed").alias("p"))
        got = found.select("at", F.array(*(F.col("p")[f] for f in FEATURES)).alias("x"), F.col("p")["kind"].alias("k")).orderBy("at", "k", "x").collect()
        halves = [[(list(r["x"]), made[r["at"]][1], r["k"]) for r in got if r["at"] % 2 == h] for h in (0, 1)]
        _MODEL.append(_boosted(*halves))
    return _MODEL[0]


def _boosted(fit: list, held: list) -> tuple[list, list[float]]:
    rows, labels = [r for r, _, _ in fit], [y for _, y, _ in fit]
    score, trees = [0.0] * len(rows), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _tree(rows, [q - y for q, y in zip(p, labels)], [q * (1 - q) for q in p], DEPTH)
        trees.append(tree)
        score = [s + RATE * value(tree, r) for s, r in zip(score, rows)]
    thresholds = []
    for k in range(len(KINDS)):
        ordinary = sorted((RATE * sum(value(t, r) for t in trees) for r, y, kind in held if kind == k and not y), reverse=True)
        thresholds.append(max(0.0, ordinary[int(FALSE_RATE * len(ordinary))] if ordinary else 0.0))
    return trees, thresholds


def _expression(tree, at) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cutoff, low, high = tree
    return F.when(at[FEATURES[f]] <= cutoff, _expression(low, at)).otherwise(_expression(high, at))


# --- matching ------------------------------------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        parts = F.split(text, r"\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:int,start:int,end:int,text:string,before:string,after:string>>"


def _marked(rows: DataFrame, text: Column, patterns, prefix: str) -> DataFrame:
    """rows with a column for each (kind, pattern, gate): the text with its matches between marks, null without any."""
    clean = F.translate(text, MARK, OTHER)
    columns = {}
    for i, (_, pattern, gate) in enumerate(patterns):
        held = clean.rlike(gate) if isinstance(gate, str) else gate(clean)
        columns[f"__{prefix}{i}"] = F.when(held, F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"))
    return rows.withColumns(columns)


def _matches(marked: Column, kind: str) -> Column:
    """The matches of a marked text with their places in code points and some text around them.

    Chunks of one length say where the marks are; what lies between them comes from splitting. Everything is read once.
    """
    chunks = F.regexp_extract_all(marked, F.lit(r"(?s).{1,%d}" % CHUNK), F.lit(0))

    def inside(chunk: Column, i: Column) -> Column:
        each = F.filter(F.sequence(F.lit(1), F.length(chunk)), lambda j: F.substring(chunk, j, F.lit(1)) == MARK)
        return F.when(chunk.contains(MARK), F.transform(each, lambda j: (i * CHUNK + j - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    marks = F.transform(F.flatten(F.transform(chunks, inside)), lambda x, i: x - i)  # without the marks before
    parts = F.split(marked, MARK)
    odd = F.filter(parts, lambda _, i: i % 2 == 1)
    even = F.filter(parts, lambda _, i: i % 2 == 0)
    zipped = F.arrays_zip(
        odd.alias("text"), even.alias("before"), F.slice(even, 2, F.size(even)).alias("after"),
        F.filter(marks, lambda _, i: i % 2 == 0).alias("start"), F.filter(marks, lambda _, i: i % 2 == 1).alias("end"),
    )
    found = F.transform(
        F.slice(zipped, 1, F.size(odd)),
        lambda z: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), z["start"].alias("start"), z["end"].alias("end"), z["text"].alias("text"),
            F.right(z["before"], F.lit(AROUND)).alias("before"), F.left(z["after"], F.lit(AROUND)).alias("after"),
        ),
    )
    return F.when(marked.contains(MARK), found).otherwise(F.array().cast(_SPAN))


def _features(span: Column) -> dict[str, Column]:
    text, before, after, kind = span["text"], F.lower(span["before"]), F.lower(span["after"]), span["kind"]
    digits = _digits(text)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    words = functools.reduce(
        lambda held, k: F.when(kind == k, before.rlike(r"\b(?:" + "|".join(WORDS[KINDS[k]]) + ")")).otherwise(held), range(len(KINDS)), F.lit(False)
    )
    return {
        "digits": F.least(F.length(digits), F.lit(40)).cast("double"),
        "marks": F.size(F.split(F.regexp_replace(text, r"(?i)[(\[{](?:dot|at|\.)[)\]}]", "\x03"), r"[\x03 ._/()-]+")).cast("double") - 1,
        "luhn": flag(F.when((kind == KINDS.index("card")) & F.length(digits).between(13, 19), _luhn(digits))),
        "word": flag(words),
        "plain": flag(before.rlike(r"\b(?:" + "|".join(w.replace(".", r"\.") for w in PLAIN) + r")[^a-z0-9]*$")),
        "joined": flag(before.rlike(r"[\p{L}0-9#$/_=]$")),
        "same": flag(digits.rlike(r"^([0-9])\1+$")),
        "unit": flag(after.rlike(r"^[^a-z0-9]*(?:" + "|".join(UNITS) + r")\b")),
        "mixed": flag(text.rlike("[A-Za-z][^A-Za-z0-9]*[0-9][^A-Za-z0-9]*[A-Za-z]|[0-9][^A-Za-z0-9]*[A-Za-z][^A-Za-z0-9]*[0-9]")),
        "upper": flag(text.rlike("^[A-Z0-9]+$")),
        "named": flag(text.rlike("[=:]")),
        "form": flag(text.rlike(ISSUED)),
        "letters": F.least(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(80)).cast("double"),
    }


def _proposed(rows: DataFrame) -> DataFrame:
    """rows with `__proposed`: the proposals of all generators, with their features."""
    made = F.concat(*(F.coalesce(_matches(F.col(f"__p{i}"), kind), F.array().cast(_SPAN)) for i, (kind, _, _) in enumerate(GENERATORS)))
    fields = lambda s: F.struct(*(s[f].alias(f) for f in ("kind", "start", "end")), *(v.alias(k) for k, v in _features(s).items()))
    return rows.withColumn("__proposed", F.transform(made, fields)).drop(*(f"__p{i}" for i in range(len(GENERATORS))))


def _place(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _flags(spans: Column, first, step, flag) -> Column:
    """A scan over spans: an array of '1' and '0', gathered as a string so that a step copies bytes only."""
    start = F.struct(first.alias("edge"), F.lit("").alias("out"))

    def merge(state: Column, s: Column) -> Column:
        return F.struct(step(state["edge"], s).alias("edge"), F.concat(state["out"], F.when(flag(state["edge"], s), "1").otherwise("0")).alias("out"))

    return F.split(F.aggregate(spans, start, merge, lambda s: s["out"]), "")


def _apart(proposed: Column) -> Column:
    """Of selected proposals that overlap the first one stays, of those that begin together the longest."""
    order = F.array_sort(F.transform(proposed, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"), s["end"].alias("end"))))
    taken = _flags(order, F.lit(0), lambda edge, s: F.greatest(edge, s["end"]), lambda edge, s: s["start"] >= edge)
    zipped = F.arrays_zip(order.alias("s"), F.slice(taken, 1, F.size(proposed)).alias("taken"))
    kept = F.transform(F.filter(zipped, lambda z: z["taken"] == "1"), lambda z: _place(z["s"]))
    return F.when(F.size(proposed) > 1, kept).otherwise(proposed)


def _free(base: Column, proposed: Column) -> Column:
    """The proposals that overlap no base match: none that begins before them reaches them, and they reach none behind."""
    tag = lambda owner: lambda s: F.struct(s["start"].alias("start"), F.lit(owner).alias("owner"), s["end"].alias("end"), s["kind"].alias("kind"))
    merged = F.array_sort(F.concat(F.transform(base, tag(0)), F.transform(proposed, tag(1))))
    reached = _flags(
        merged, F.lit(0), lambda edge, s: F.when(s["owner"] == 0, F.greatest(edge, s["end"])).otherwise(edge), lambda edge, s: s["start"] < edge
    )
    reaches = _flags(
        F.reverse(merged), F.lit((1 << 31) - 1), lambda edge, s: F.when(s["owner"] == 0, F.least(edge, s["start"])).otherwise(edge), lambda edge, s: edge < s["end"]
    )
    n = F.size(base) + F.size(proposed)
    zipped = F.arrays_zip(merged.alias("s"), F.slice(reached, 1, n).alias("reached"), F.reverse(F.slice(reaches, 1, n)).alias("reaches"))
    free = F.filter(zipped, lambda z: (z["s"]["owner"] == 1) & (z["reached"] == "0") & (z["reaches"] == "0"))
    return F.when((F.size(base) > 0) & (F.size(proposed) > 0), F.transform(free, lambda z: _place(z["s"]))).otherwise(proposed)


def spans(rows: DataFrame, text: Column) -> DataFrame:
    """rows with `__base` and `__spans`: places of the base matches, and of all, by kind and start."""
    gates = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]")}
    trees, thresholds = model(rows.sparkSession)
    limits = F.array(*map(F.lit, thresholds))
    above = lambda s: functools.reduce(lambda a, b: a + b, (_expression(t, s) for t in trees)) * RATE > limits[s["kind"]]
    held = F.coalesce(text, F.lit(""))
    out = _marked(_marked(rows, held, GENERATORS, "p"), held, [(k, BASE[k], gates[k]) for k in BASE], "b")
    base = [
        F.coalesce(F.transform(F.filter(_matches(F.col(f"__b{i}"), k), functools.partial(lambda kind, s: _holds(kind, s["text"]), k)), _place), F.array().cast("array<struct<kind:int,start:int,end:int>>"))
        for i, k in enumerate(BASE)
    ]
    out = _proposed(out.withColumn("__base", F.concat(*base)).drop(*(f"__b{i}" for i in range(len(BASE)))))
    out = out.withColumn("__proposed", _apart(F.transform(F.filter("__proposed", above), _place)))
    return out.withColumn("__spans", F.array_sort(F.concat(F.col("__base"), _free(F.col("__base"), F.col("__proposed"))))).drop("__proposed")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), kind an index into KINDS, by kind and start."""
    read = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return spans(read, F.col("__text")).select(F.col("__id").alias(id_col), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def listed(places: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(places, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(documents: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """documents, each span of its text replaced by its kind in brackets; overlapping spans become one.

    Spans are taken in blocks of `BLOCK`, each with its own part of the text, so no step looks through the whole text.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, ordered = F.col("__text"), F.col("__ordered")

    def one(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(state["part"], state["at"] - state["low"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), state["low"].alias("low"), state["part"].alias("part"),
            F.when(fresh, F.concat(state["out"], gap, names[s["kind"]])).otherwise(state["out"]).alias("out"),
        )

    def block(state: Column, b: Column) -> Column:
        some = F.slice(ordered, b * BLOCK + 1, BLOCK)
        high = F.aggregate(some, F.lit(0), lambda m, s: F.greatest(m, s["end"]))
        begin = F.struct(
            state["at"].alias("at"), state["at"].alias("low"), F.substring(text, state["at"] + 1, F.greatest(high - state["at"], F.lit(0))).alias("part"), F.lit("").alias("out")
        )
        return F.aggregate(some, begin, one, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    last = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text) - s["at"]))
    blocks = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int"))
    out = spans(documents.withColumn("__text", F.col(text_col).cast("string")), F.col("__text"))
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.withColumn("__ordered", by_start).withColumn(text_col, F.when(F.size("__ordered") > 0, F.aggregate(blocks, begin, block, last)).otherwise(text))
    if chars_col and chars_col in documents.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return out.select(*documents.columns)
