"""HTML extraction with wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tokens: text blocks, each with the path of its containers (a hash of names, classes and ids, without
those that hold digits, which tell pages of one template apart). Pages of one host are aligned one after
another with the host's wrapper. Where they agree, the wrapper keeps a field; a run of blocks of one path becomes a
repeated group; blocks that only some pages have become optional groups; a text that differs becomes a slot, one that
all pages share stays constant. A task infers a wrapper from `PAGES` pages at a time; what these wrappers say of a path
is merged over the whole host and then applied to all its pages, however they were dealt. A text is constant only if
every wrapper with its path has it as constant, and three pages or more that hold it differ in text that could be main
text: pages that differ only in a script, a comment, an advert or links are copies, and take nothing from each other.

A field is main text if it lies in the article (the page's main or article container, or else the container that holds
most unlinked text) and in no menu, header, footer, sidebar, notice, advert, form, script, style or comment section;
constant texts aren't main text, in an article container or not. On a page without one, runs that are mostly links, on
the page as on the host, aren't main text either.

Pages are dealt by host. Hosts with more than a quarter of a task's fair share of the pages are spread over as many
tasks as they need; there are at most four such hosts a task, which bounds the only side that is broadcast. A task
takes its pages in host order, `PAGES` at a time, and keeps hashes of what they have in common. Every page takes part.

Defined cases: a null or empty html has an empty text; a null url or one without a host belongs to the host ''; an
unclosed tag, comment or script ends with the page; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import ship, shuffle_width

PAGES = 64
#: So many pages that differ make a text that all of them hold a constant.
DIFFERENT = 3
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tag names, by what they do to text: fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
OUT = set("nav footer aside form button select option dialog menu head title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class, id and role that mark what isn't main text, and what is.
BAD = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies dialog "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination pager "
    "popup promo promotion promoted related recommendations recommended reply replies responses search share sharing sidebar signup "
    "skyscraper social sponsor sponsored subscribe teaser teasers toolbar widget widgets complementary contentinfo alert alertdialog".split()
)
GOOD = set("articlebody article-body main-content maincontent post-content entry-content story-body".split())


def number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def label(names: list[tuple[str, str]]) -> str:
    """Classes and ids, but for words with digits, which tell pages of one template apart."""
    return "".join(("." if k == "class" else "#") + w for k, v in names if k in ("class", "id") for w in v.split() if not any(map(str.isdigit, w)))


class Node:
    """A container on the way to a block: what its labels hash to, and what is known of it and those around it."""

    __slots__ = ("name", "label", "path", "above", "size", "bad", "main", "inside")

    def __init__(self, name: str, label: str, above: "Node | None", bad: bool, main: bool):
        self.name, self.label, self.above, self.bad, self.main, self.inside = name, label, above, bad, main, main
        if above is None:
            self.path, self.size = number(label), len(label)
        else:
            self.path, self.size = number(str(above.path), label), above.size + 1 + len(label)
            self.bad, self.inside = bad or above.bad, main or above.inside
            self.main = (above.main or main) and not bad

    def shown(self) -> str:
        labels, node = [], self
        while node is not None and node.above is not None:
            labels.append(node.label)
            node = node.above
        return "/".join(labels[::-1])


TOP = Node("", "", None, False, False)


def parse(page: str) -> list[tuple]:
    """Blocks in page order: (node, text, characters in links, in an article container, shut out).

    A container is hashed once, from the hash of the one around it; open names are counted and the nearest container that isn't
    inline is known at each depth, so nothing looks through the containers and the time is in proportion to the page.
    """
    out, stack, opened = [], [], {}  # stack: (name, node of the nearest container, its place in the stack)
    text, linked = [], 0

    def flush() -> None:
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            node = stack[-1][1] if stack else TOP
            out.append((node, joined, min(linked, len(joined)), node.main, node.bad))
        text, linked = [], 0

    def shorten(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop()[0]] -= 1

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            decoded = entities.unescape(token) if "&" in token else token
            text.append(decoded)
            if opened.get("a"):
                linked += len(decoded.strip())
            continue
        if m[1] or token.startswith("<!") or token.startswith("<?"):
            continue
        tag = TAG.match(token)
        if not tag:
            continue
        name = tag[1].lower()
        if token[1] == "/":
            if name not in INLINE:
                flush()
            if opened.get(name):
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                shorten(to)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
            shut = CLOSES.get(name, set())
            if name in PARAGRAPH_ENDS:
                shut = shut | {"p"}
            if stack and stack[-1][1].name in shut:
                shorten(stack[-1][2])
        if name in VOID or token.endswith("/>"):
            continue
        names = [(k.lower(), (a or b or c).lower()) for k, a, b, c in NAMED.findall(token)] if "=" in token else []
        words = {w for k, v in names for w in re.split(r"[\s_]+|(?<=[a-z])-(?=[a-z])", v)}
        whole = {w for k, v in names for w in v.split()}
        around, at = (stack[-1][1], stack[-1][2]) if stack else (TOP, -1)
        main = name in ("article", "main") or ("role", "main") in names or bool(whole & GOOD)
        bad = name in OUT or (name == "header" and not around.inside) or (name not in ("html", "body", "article", "main") and not whole & GOOD and bool((words | whole) & BAD))
        if name in ("html", "body"):
            bad = main = False
        opened[name] = opened.get(name, 0) + 1
        if name in INLINE:  # no part of the path, but it may shut out or mark what it holds
            node = around
            if bad or main:
                node = Node(around.name, "", around, bad, main)
                node.label, node.path, node.size, node.above = around.label, around.path, around.size, around.above
            stack.append((name, node, at))
        else:
            stack.append((name, Node(name, name + label(names), around, bad, main), len(stack)))
    flush()
    return out


class Field:
    __slots__ = ("node", "path", "pages", "texts", "seen", "repeated", "optional")

    def __init__(self, node: Node):
        self.node, self.path, self.pages, self.texts, self.seen = node, node.path, 0, set(), []
        self.repeated = self.optional = False

    def take(self, blocks: list[tuple], mark: int) -> None:
        now = {b[1] for b in blocks}
        self.texts = now if self.pages == 0 else self.texts & now
        self.pages += 1
        self.seen = least(self.seen, [mark])
        self.repeated |= len(blocks) > 1


def container(page: list[tuple[int, list[tuple]]]) -> list[str]:
    return [b[1] for _, blocks in page for b in blocks if b[3] and not b[4]]


def least(a: list[int], b: list[int]) -> list[int]:
    """The DIFFERENT least of both; enough to know whether there are that many, in any order of merging."""
    return sorted({*a, *b})[:DIFFERENT]


def mark(page: list[tuple[int, list[tuple]]]) -> int:
    """A number for what could be main text of a page: pages with the same are copies."""
    return number(*(container(page) or [b[1] for _, blocks in page for b in blocks if not b[4] and b[2] * 2 <= len(b[1])]))


def runs(blocks: list[tuple]) -> list[tuple[int, list[tuple]]]:
    """(path, blocks): neighbouring blocks of one path together."""
    out: list[tuple[int, list[tuple]]] = []
    for b in blocks:
        if out and out[-1][0] == b[0].path:
            out[-1][1].append(b)
        else:
            out.append((b[0].path, [b]))
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places with equal items, rising on both sides.

    Equal ends first; between them the nth occurrence of an item meets its nth on the other side, and of these pairs a
    longest rising run stays (patience sorting): n log n steps, however often an item repeats.
    """
    low, end = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    where: dict[tuple[int, int], int] = {}
    count: dict[int, int] = {}
    for j in range(low, len(b) - end):
        where[b[j], count.get(b[j], 0)] = j
        count[b[j]] = count.get(b[j], 0) + 1
    count, tails, ends, before = {}, [], [], []
    pairs = []
    for i in range(low, len(a) - end):
        j = where.get((a[i], count.get(a[i], 0)))
        count[a[i]] = count.get(a[i], 0) + 1
        if j is None:
            continue
        k = bisect.bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [j], [len(pairs)]
        pairs.append((i, j))
    middle, at = [], ends[-1] if ends else -1
    while at >= 0:
        middle.append(pairs[at])
        at = before[at]
    return [(i, i) for i in range(low)] + middle[::-1] + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


class Wrapper:
    """Fields in order; `learn` aligns one page more, `expression` is the union-free regular expression."""

    def __init__(self):
        self.fields: list[Field] = []
        self.pages = 0

    def learn(self, page: list[tuple[int, list[tuple]]]) -> list[Field]:
        """The field of each of the page's runs."""
        fields, taken, own = [], [], mark(page)
        i = j = 0
        for to_i, to_j in [*aligned([f.path for f in self.fields], [p for p, _ in page]), (len(self.fields), len(page))]:
            for f in self.fields[i:to_i]:
                f.optional = True
                fields.append(f)
            for _, blocks in page[j:to_j]:
                f = Field(blocks[0][0])
                f.optional = self.pages > 0
                f.take(blocks, own)
                fields.append(f)
                taken.append(f)
            if to_i < len(self.fields) and to_j < len(page):
                f = self.fields[to_i]
                f.take(page[to_j][1], own)
                fields.append(f)
                taken.append(f)
            i, j = to_i + 1, to_j + 1
        self.fields, self.pages = fields, self.pages + 1
        return taken

    def expression(self) -> str:
        body = lambda f: f"<{f.node.shown()}>" + (" ".join(f.texts) if f.texts and f.pages > 1 and not f.repeated else "#TEXT")
        return " ".join(f"({body(f)}){'+' if f.repeated else ''}{'?' if f.optional else ''}" for f in self.fields)


def ordered(page: list[tuple[int, list[tuple]]]):
    """(path, how many runs of the path came before on the page, blocks)."""
    before: dict[int, int] = {}
    for path, blocks in page:
        yield path, before.get(path, 0), blocks
        before[path] = before.get(path, 0) + 1


class Host:
    """What the wrappers of a host's pages, or of a part of them, have in common: numbers only."""

    def __init__(self):
        self.texts: dict[int, dict[int, list[int]]] = {}  # path: constant text: marks of its pages
        self.links: dict[int, list[int]] = {}  # path and place: characters, those in links, pages

    def learn(self, pages: list[str]) -> None:
        wrapper, plain = Wrapper(), {}
        for p in pages:
            page = runs(parse(p)) if p else []
            wrapper.learn(page)
            for path, place, blocks in ordered(page):
                sums = self.links.setdefault(number(str(path), str(place)), [0, 0, 0])
                sums[0] += sum(len(b[1]) for b in blocks)
                sums[1] += sum(b[2] for b in blocks)
                sums[2] += 1
        for f in wrapper.fields:
            constant = plain.setdefault(f.path, {})
            for t in f.texts:
                k = number(str(f.path), "", t)
                constant[k] = least(constant.get(k, []), f.seen)
        for path, constant in plain.items():
            had = self.texts.get(path)
            self.texts[path] = constant if had is None else {k: least(had[k], m) for k, m in constant.items() if k in had}

    def rows(self):
        """(path, item, marks, characters, linked, pages): the path itself, its constants, and its places as paths of their own."""
        for path, constant in self.texts.items():
            yield path, None, [], 0, 0, 0
            for k, marks in constant.items():
                yield path, k, marks, 0, 0, 0
        for k, sums in self.links.items():
            yield k, k, [], *sums

    def model(self) -> tuple[set[int], set[int]]:
        constant = {k for c in self.texts.values() for k, marks in c.items() if len(marks) == DIFFERENT}
        return constant, {k for k, (chars, linked, pages) in self.links.items() if linked * 2 <= chars and pages >= DIFFERENT}


def lies_in(node: Node, container: int, known: dict[int, bool]) -> bool:
    """Whether a node is the container or lies in it; every node is looked at once a page."""
    chain = []
    while node is not None and node.path not in known and node.path != container:
        chain.append(node.path)
        node = node.above
    found = node is not None and (node.path == container or known[node.path])
    known.update(dict.fromkeys(chain, found))
    return found


def apply(page: str, constant: set[int], plain: set[int]) -> str:
    """The main text of a page by its host's model: constant texts, and places that are mostly unlinked over several pages."""
    parsed = runs(parse(page)) if page else []
    kept = [b[1] for path, blocks in parsed for b in blocks if b[3] and not b[4] and number(str(path), "", b[1]) not in constant]
    if not container(parsed):
        weight: dict[int, int] = {}
        size: dict[int, int] = {}
        usable = []
        for path, place, blocks in ordered(parsed):
            if sum(b[2] for b in blocks) * 2 > sum(len(b[1]) for b in blocks) and number(str(path), str(place)) not in plain:
                continue
            blocks = [b for b in blocks if not b[4] and number(str(path), "", b[1]) not in constant]
            if not blocks:
                continue
            usable.append((path, blocks))
            parent = blocks[0][0].above or TOP
            weight[parent.path] = weight.get(parent.path, 0) + sum(len(b[1]) - b[2] for b in blocks)
            size[parent.path] = parent.size
        best = max(weight, key=lambda k: (weight[k], -size[k]), default=TOP.path)
        within: dict[int, bool] = {}
        kept = [b[1] for path, blocks in usable if lies_in(blocks[0][0], best, within) for b in blocks]
    return " ".join(kept)


def extract(pages: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    host = Host()
    host.learn(pages)
    model = host.model()
    return [apply(p, *model) for p in pages]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    ship(pages.sparkSession)
    width = shuffle_width(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    read = pages.select(
        F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(html_col).cast("string").alias("__html"), host.alias("__host")
    )
    counts = pages.select(host.alias("__host")).groupBy("__host").count()
    share = counts.agg(F.greatest(F.sum("count") / (4 * width), F.lit(1.0)).alias("share"))
    large = counts.crossJoin(F.broadcast(share)).where("count > share").select("__host", F.ceil(F.col("count") / F.col("share")).alias("parts"))
    # `large` has fewer than 4 * width rows, by its definition
    dealt = read.join(F.broadcast(large), "__host", "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64("__id", "__url"), F.col("parts")), F.lit(0))
    )
    dealt = dealt.withColumn("__parts", F.coalesce("parts", F.lit(1)).cast("long")).select("__id", "__url", "__html", "__host", "__salt", "__parts").repartition(width, "__host", "__salt")

    def learn(batches):
        def summary(name, parts, host):
            found = list(host.rows())
            columns = list(zip(*found)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array([name] * len(found), pa.string()), pa.array([parts] * len(found), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))]
            return pa.RecordBatch.from_arrays(arrays, names=["h", "parts", "path", "item", "marks", "chars", "linked", "pages"])

        last = host = None
        held: list[str] = []
        for got in batches:
            for h, name, parts in zip(*(got.column(k).to_pylist() for k in ("__html", "__host", "__parts"))):
                if host is not None and name != last[0]:
                    host.learn(held)
                    yield summary(*last, host)
                    host, held = None, []
                elif len(held) >= batch:
                    host.learn(held)
                    held = []
                host, last = host or Host(), (name, parts)
                held.append(h or "")
        if host is not None:
            host.learn(held)
            yield summary(*last, host)

    # a task's part of a host is one row a path and text, so no group has more than a row a task
    partial = dealt.sortWithinPartitions("__host", "__id").mapInArrow(learn, "h string, parts long, path long, item long, marks array<long>, chars long, linked long, pages long")
    items = partial.groupBy("h", "parts", "path", "item").agg(
        F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("marks"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("pages").alias("pages")
    )
    paths = items.groupBy("h", "parts", "path").agg(F.max(F.when(F.col("item").isNull(), F.col("n"))).alias("of"), F.collect_list(F.struct("item", "n", "marks", "chars", "linked", "pages")).alias("items"))
    chosen = lambda c: F.transform(F.filter("items", c), lambda x: x["item"])
    paths = paths.select(
        "h", "parts", chosen(lambda x: x["item"].isNotNull() & (x["n"] == F.col("of")) & (x["marks"] >= DIFFERENT)).alias("constant"),
        chosen(lambda x: (x["linked"] * 2 <= x["chars"]) & (x["pages"] >= DIFFERENT)).alias("plain"),
    )
    models = paths.groupBy("h", "parts").agg(F.flatten(F.collect_list("constant")).alias("__constant"), F.flatten(F.collect_list("plain")).alias("__plain"))
    models = models.select(F.col("h").alias("__host"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("__salt"), "__constant", "__plain")

    def run(batches):
        key = model = None
        for got in batches:
            ids, urls, pages_, hosts, salts, nth, constant, plain = (got.column(k) for k in ("__id", "__url", "__html", "__host", "__salt", "__nth", "__constant", "__plain"))
            found = []
            for i, now in enumerate(zip(hosts.to_pylist(), salts.to_pylist())):
                if nth[i].as_py() == 1:
                    key, model = now, (set(constant[i].as_py() or ()), set(plain[i].as_py() or ()))
                if now != key:
                    raise RuntimeError("a host's pages came apart from its model")
                found.append(apply(pages_[i].as_py() or "", *model))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()), urls.cast(pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()),
                ],
                names=["__id", "__url", "text", "n_chars"],
            )

    # a host's model travels with the first of its pages in a task
    nth = F.row_number().over(Window.partitionBy("__host", "__salt").orderBy("__id"))
    first = dealt.withColumn("__nth", nth).alias("d")
    models = models.select(F.col("__host").alias("h"), F.col("__salt").alias("s"), "__constant", "__plain")
    joined = first.join(models, (F.col("__host") == F.col("h")) & (F.col("__salt") == F.col("s")) & (F.col("__nth") == 1), "left")
    # all columns of `dealt`, so that its one shuffle serves both passes
    out = joined.drop("h", "s").mapInArrow(run, "__id long, __url string, text string, n_chars long")
    return out.withColumnRenamed("__id", id_col).withColumnRenamed("__url", url_col)
