"""Secrets in texts: fixed patterns, and probabilistic automata inferred from labelled credentials.

Base matches (assigned values, access keys, long hexadecimal strings) are found by fixed patterns and always kept. The method
proposes every other long mixed token, the password of a URL and the value behind a name such as `bearer`, and adds those
whose format is likely that of a credential.

Method: labelled credentials of each family, and ordinary long tokens, are written as symbols (digit, vowel or consonant,
hexadecimal or not, upper or lower, marks as they are). A prefix tree of each family's strings
is made into a probabilistic automaton by merging states in breadth-first order: two states are compatible if the shares of
strings that end there and of each symbol differ by less than Hoeffding bounds allow, and so in turn all that follows
(`infer`). A candidate's score is the log-likelihood of its symbols under the family that explains it best less that under
the automaton of ordinary tokens, a symbol. Thresholds are calibrated on held-out labelled tokens, so that at most
`FALSE_RATES` of the ordinary ones pass.

No table labels credentials, so they are `SAMPLE` strings a family made from issuers' documented formats and a seed; the same
automata serve a corpus of any size, and no result depends on other documents. They are fitted on the driver once a session
and travel with the task's function (some hundred states).

Texts are read whole, in Arrow batches as Spark deals them; a text's work is in proportion to its length.

Defined cases: a null text has no spans; positions are code points; added spans overlap no base match, and of those that
overlap one another the first stays, of those that begin together the longest; ids may be null or repeated; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import ship

#: The first three are the base kinds.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more; shorter runs hold no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED = 6

#: Candidates: tokens of mixed characters, passwords in URLs, values behind further names.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}+")
URL = re.compile(r"://[^\s:/@]{1,64}:([^\s/@]{6,64})@")
NAMED = re.compile(r"""(?<![a-z])(?:bearer|pwd|auth|credentials?|private_?key|access_?key)["']?\x20{0,3}[:=]?\x20{0,3}["']?([A-Za-z0-9+/_.=~!#@$%^&*-]{8,}+)""", re.IGNORECASE | re.ASCII)
#: Of held-out ordinary tokens at most this share passes; more where the text around says that a credential stands there.
FALSE_RATES = {"token": 0.005, "url": 0.02, "named": 0.02}
GENERATORS = tuple(FALSE_RATES)

SAMPLE, ALPHA, SMOOTH, SEED = 400, 0.05, 0.5, 29
FAMILIES = ("hex", "base64", "prefixed", "jwt", "password")
MARKS = "+/_=.~-"


def symbols(value: str) -> str:
    """One symbol a character."""
    return value.translate(_SYMBOL)


class _Symbols(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in string.digits:
            kind = "0"
        elif c in string.ascii_letters:
            low = c.lower()
            kind = ("a" if low in "ae" else "o") if low in "aeiou" else ("b" if low in "bcdf" else "k")
            kind = kind.upper() if c != low else kind
        else:
            kind = c if c in MARKS else "?"
        if len(self) < 4096:
            self[code] = kind
        return kind


_SYMBOL = _Symbols()
ALPHABET = "0aobkAOBK?" + MARKS


# --- inference -----------------------------------------------------------------------------------------------------


class State:
    """Strings that reach it, that end in it, that leave it by each symbol, and where these lead."""

    __slots__ = ("count", "ends", "arcs", "next")

    def __init__(self):
        self.count, self.ends, self.arcs, self.next = 0, 0, Counter(), {}


def prefix_tree(strings: list[str]) -> State:
    root = State()
    for s in strings:
        at = root
        at.count += 1
        for c in s:
            at.arcs[c] += 1
            at = at.next.setdefault(c, State())
            at.count += 1
        at.ends += 1
    return root


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    """Whether shares a/n and b/m differ by more than Hoeffding's bounds let them by chance."""
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: State, tree: State, alpha: float) -> bool:
    todo = [(a, tree)]
    while todo:
        p, q = todo.pop()
        if _differ(p.ends, p.count, q.ends, q.count, alpha):
            return False
        if any(_differ(p.arcs[c], p.count, q.arcs[c], q.count, alpha) for c in p.next.keys() | q.next.keys()):
            return False
        todo.extend((p.next[c], y) for c, y in q.next.items() if c in p.next)
    return True


def _fold(into: State, tree: State) -> None:
    """Add the counts of a tree to the states that its strings reach from `into`."""
    todo = [(into, tree)]
    while todo:
        p, q = todo.pop()
        p.count, p.ends = p.count + q.count, p.ends + q.ends
        p.arcs.update(q.arcs)
        for c, y in q.next.items():
            if c in p.next:
                todo.append((p.next[c], y))
            else:
                p.next[c] = y


def infer(strings: list[str], alpha: float = ALPHA) -> list[State]:
    """The automaton's states, the start first: compatible states of the prefix tree are merged, those near the start before others.

    States that were kept may lead to one another; what else hangs on them is a tree, so folding ends.
    """
    root = prefix_tree(strings)
    kept, known = [root], {id(root)}
    while True:
        arc = next(((k, c) for k in kept for c in sorted(k.next) if id(k.next[c]) not in known), None)
        if arc is None:
            return kept
        parent, c = arc
        tree = parent.next[c]
        twin = next((k for k in kept if compatible(k, tree, alpha)), None)
        if twin is None:
            kept.append(tree)
            known.add(id(tree))
        else:
            parent.next[c] = twin
            _fold(twin, tree)


class Automaton:
    """Smoothed log-probabilities; a symbol that a state never saw leads to one more state, which has the overall shares."""

    def __init__(self, states: list[State]):
        number, width = {id(s): i for i, s in enumerate(states)}, len(ALPHABET) + 1
        overall = State()
        for s in states:
            overall.count, overall.ends = overall.count + s.count, overall.ends + s.ends
            overall.arcs.update(s.arcs)
        log = lambda n, s: math.log((n + SMOOTH) / (s.count + SMOOTH * width))
        self.rows = [{c: (number[id(s.next[c])] if c in s.next else len(states), log(s.arcs[c], s)) for c in ALPHABET} for s in (*states, overall)]
        self.ends = [log(s.ends, s) for s in (*states, overall)]

    def log_likelihood(self, text: str) -> float:
        at, out = 0, 0.0
        for c in text:
            at, p = self.rows[at][c]
            out += p
        return out + self.ends[at]


# --- labelled tokens -----------------------------------------------------------------------------------------------


def credential(rng: random.Random, family: str) -> str:
    """A made credential in a documented format."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base62, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    url64 = string.ascii_letters + string.digits + "-_"
    if family == "hex":
        return some(rng.choice(("0123456789abcdef", "0123456789ABCDEF")), rng.choice((16, 20, 24, 32, 40, 64)))
    if family == "base64":
        n = rng.choice((20, 24, 27, 32, 36, 40, 43, 48, 64))
        return rng.choice((some(base62, n), some(base64, n) + rng.choice(("", "=", "==")), some(url64, n)))
    if family == "prefixed":
        return rng.choice((
            lambda: "gh" + rng.choice("posur") + "_" + some(base62, 36), lambda: "glpat-" + some(url64, 20), lambda: "npm_" + some(base62, 36),
            lambda: "xox" + rng.choice("abps") + "-" + some(string.digits, 12) + "-" + some(string.digits, 12) + "-" + some(base62, 24),
            lambda: rng.choice(("sk", "pk", "rk")) + rng.choice(("_live_", "_test_")) + some(base62, 24), lambda: "sk-" + some(base62, 48),
            lambda: "AIza" + some(url64, 35), lambda: rng.choice(("AKIA", "ASIA")) + some(string.ascii_uppercase + string.digits, 16),
            lambda: "SG." + some(url64, 22) + "." + some(url64, 43), lambda: "hf_" + some(base62, 34),
        ))()
    if family == "jwt":
        return ".".join(("eyJ" + some(url64, rng.randint(17, 40)), "eyJ" + some(url64, rng.randint(30, 120)), some(url64, 43)))
    return "".join(_word(rng).title() + some(string.digits, rng.randint(1, 4)) + rng.choice(("", "!", "$", "#", "_")) for _ in range(rng.randint(1, 2)))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "n", "r", "s", "t")) for _ in range(rng.randint(1, 3)))


def ordinary(rng: random.Random) -> str:
    """A made long token that is no credential: names, paths, hosts, versions, dates, identifiers."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    words = lambda n: [_word(rng) for _ in range(n)]
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    date = lambda: f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}"
    return rng.choice((
        lambda: "".join(w.title() for w in words(rng.randint(3, 5))) + digits(rng.randint(0, 2)), lambda: "_".join(words(rng.randint(3, 6))) + rng.choice(("", "_" + digits(2))),
        lambda: "-".join(words(rng.randint(3, 6))) + "-" + digits(rng.randint(1, 4)), lambda: "/" + "/".join(words(rng.randint(3, 6))) + "/" + digits(rng.randint(1, 5)),
        lambda: ".".join(words(rng.randint(1, 3))) + digits(rng.randint(1, 2)) + "." + rng.choice(("example.com", "com", "org", "net/index", "io")),
        lambda: f"{_word(rng)}-{_word(rng)}-{digits(1)}.{digits(2)}.{digits(1)}" + rng.choice((".tar.gz", ".whl", "-rc1", "-beta.2", ".zip")),
        lambda: f"{date()}T{digits(2)}-{digits(2)}-{digits(2)}.{digits(3)}Z", lambda: f"{_word(rng)}_{date()}.csv", lambda: "-".join(map(hexes, (8, 4, 4, 4, 12))),
        lambda: f"{_word(rng).upper()}-{digits(4)}-{digits(5)}-{_word(rng).upper()}", lambda: _word(rng) + rng.choice("=-_.~") * rng.randint(12, 30) + digits(1),
        lambda: rng.choice("abcxyz") * rng.randint(14, 24) + digits(2), lambda: "".join(words(rng.randint(4, 7))) + digits(rng.randint(1, 3)),
        lambda: ("".join(words(2)) + "=" + digits(3)) * 2, lambda: f"{_word(rng)}.{digits(2)}~{_word(rng)}{digits(1)}.{_word(rng)}.example.org",
        lambda: f"{_word(rng)}/{_word(rng)}_v{digits(1)}.{digits(1)}/{_word(rng)}{digits(3)}.{rng.choice(('json', 'html', 'png'))}",
        lambda: rng.choice(("(+1)", "", "x")).strip("()") + "-".join((digits(3), digits(3), digits(4), _word(rng))), lambda: _word(rng) + digits(rng.randint(10, 16)),
        lambda: _word(rng).title() + "ing" * rng.randint(3, 6) + digits(1), lambda: "".join(_word(rng).title() + digits(1) for _ in range(rng.randint(3, 4))),
    ))()


class Model:
    """An automaton for each family and one for ordinary tokens, with a threshold for each generator."""

    def __init__(self, seed: int = SEED):
        rng = random.Random(seed)
        made = lambda f, n: [symbols(credential(rng, f)) for _ in range(n)]
        self.families = {f: Automaton(infer(made(f, SAMPLE))) for f in FAMILIES}
        plain = [ordinary(rng) for _ in range(8 * SAMPLE)]
        self.plain = Automaton(infer([symbols(t) for t in plain[: 4 * SAMPLE]]))
        # held-out tokens: a password is believed where the text says that there is one
        held = [t for t in plain[4 * SAMPLE :] if len(t) >= 16]
        self.thresholds = [self._cut(held, g) for g in GENERATORS]

    def _cut(self, held: list[str], generator: str) -> float:
        scores = sorted((self.score(t, generator) for t in held), reverse=True)
        return max(0.0, scores[int(FALSE_RATES[generator] * len(scores))])

    def score(self, value: str, generator: str) -> float:
        """Log-likelihood ratio a symbol; passwords count only where the text around says that there is one."""
        text = symbols(value)
        best = max(a.log_likelihood(text) for f, a in self.families.items() if f != "password" or generator != "token")
        return (best - self.plain.log_likelihood(text)) / (len(text) + 1)


@functools.cache
def model() -> Model:
    return Model()


# --- spans ---------------------------------------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base matches, by start and kind."""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, generator, value) of all proposals."""
    for m in TOKEN.finditer(text):
        value = m[0].rstrip(".")
        if len(value) >= 16 and _DIGIT.search(value) and _LETTER.search(value):
            yield m.start(), m.start() + len(value), 0, value
    if "://" in text:
        for m in URL.finditer(text):
            yield m.start(1), m.end(1), 1, m[1]
    for m in NAMED.finditer(text):
        if _DIGIT.search(m[1]):
            yield m.start(1), m.end(1), 2, m[1]


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def spans(text: str, judge: Model) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of all spans, by start and kind; the base ones and what the method adds."""
    base = base_spans(text)
    out = [(start, kind, end, judge.score(value, "named")) for start, kind, end, value in base]
    found = [(start, -end, generator, value) for start, end, generator, value in candidates(text)]
    likely = []
    for start, end, generator, value in sorted(found):
        score = judge.score(value, GENERATORS[generator])
        if score > judge.thresholds[generator]:
            likely.append((start, -end, score))
    edge, k = 0, 0
    covered = _merged((s, e) for s, _, e, _ in base)
    for start, end, score in likely:
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if start >= edge and (k == len(covered) or covered[k][0] >= end):
            out.append((start, len(KINDS) - 1, end, score))
            edge = end
    return sorted(out)


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scan(judge: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            made = []
            for t in texts:
                found = spans(t.as_py() or "", judge)
                made.append([dict(zip(("start", "kind", "end", "score"), s)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, _FOUND)], names=["id", "spans"])

    return run


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): arrays of (start, kind, end, score) by start and kind, kind an index into KINDS."""
    ship(documents.sparkSession)
    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(read.dtypes)["id"]
    out = read.mapInArrow(_scan(model()), f"id {kind}, spans array<struct<start:int,kind:int,end:int,score:double>>")
    return out.withColumnRenamed("id", id_col)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
