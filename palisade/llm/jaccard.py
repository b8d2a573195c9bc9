"""N-gram Jaccard join by a prefix tree.

Every document becomes its set of distinct word n-grams. The join finds all pairs of sets whose Jaccard
similarity reaches a threshold and reports the components that those links form.

How it runs, and why it holds at scale:

1. `_sets` reads each text once and deals the set's members out by hash range as packed arrays, four bytes a
   member. `_count` has one range at a time, counts in how many documents each member lies and keeps those of two
   documents or more. The number of ranges follows the session's parallelism, so a range's arrays stay bounded, and
   a member that a third of all documents hold adds four bytes a document to one range.
2. `_gather` brings each batch of documents together again. A set can only have a partner if as many of its members
   as the smallest possible overlap are shared at all; the others are settled as singletons here.
3. Equal sets become one representative by their digest; then 1 and 2 run again, over representatives only.
4. Members have one global order, frequent first. A set's last places (its prefix in the rare-first order) must hold
   a member common with every partner. Those places are the postings that candidates come from.
5. Documents are dealt to tries of bounded size by their smallest pivot (a posting's pivot is its smallest document),
   so a group of copies shares tries. A trie keeps its sets in global order: a traversal shares the partial overlap of
   common beginnings and prunes a subtree when what remains of it and of the probe can't reach the required overlap.
   All links inside a trie are resolved there.
6. Links between tries: first two documents of each component found so far probe the other tries that hold one of their
   postings, which joins the parts of a large group; then every document that isn't in the largest component of one of
   its postings probes them. Of two documents with a common posting and different components one is such a document, so
   no link between components is lost. Probes are (document, trie) rows; pairs of documents are never rows.

Defined cases: a null or wordless text has an empty set and no links; fewer words than n give the whole sequence as
the one n-gram; repeated rows are documents of their own and link to each other; a null id stays null and counts as
larger than any other id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import components, cut, ship, shuffle_width

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Members that one packed batch holds at most, unless a single document has more.
BATCH = 1_000_000
#: Words whose hashes a worker remembers.
KNOWN = 150_000
#: Sets that one trie is meant to hold, and probes that one task puts to it.
TRIE, PROBES = 512, 1024
#: Postings of one document that a task joins at a time.
SPREAD = 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, n: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; empty for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z alone; splits at 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MIX[2] + w[i : len(w) - k + 1 + i]
    return np.unique(_mixed(h))


def need(n: int, num: int, den: int) -> int:
    """The least overlap that a set of n can have with any partner."""
    return -(-n * num // den)


_PACKED = "batch long, range int, kind int, head binary, body binary"


def _pack(batch: int, docs: list, sets: list, ranges: int):
    """Rows (one per range that has members, and one that names the documents) of a batch of sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    all_ = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    part = ((all_ >> np.uint64(32)) % np.uint64(ranges)).astype(np.uint16)
    order = np.argsort(part, kind="stable")  # owners ascend already
    low = (all_ & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
    part, owner = part[order], owner[order].astype(np.uint32)
    ends = np.searchsorted(part, np.arange(ranges + 1).astype(np.int64))
    rows = [(batch, int(batch % ranges), 0, docs, b"")]
    for r in range(ranges):
        a, b = ends[r], ends[r + 1]
        if a < b:
            own, counts = np.unique(owner[a:b], return_counts=True)
            head = np.concatenate([own, counts.astype(np.uint32)]).astype(np.uint32)
            rows.append((batch, r, 1, head.tobytes(), low[a:b].tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in rows], pa.int64()),
            pa.array([x[1] for x in rows], pa.int32()),
            pa.array([x[2] for x in rows], pa.int32()),
            pa.array([x[3] for x in rows], pa.binary()),
            pa.array([x[4] for x in rows], pa.binary()),
        ],
        names=["batch", "range", "kind", "head", "body"],
    )


_DOC = np.dtype([("key", "<i8"), ("id", "<i8"), ("null", "<i8"), ("n", "<i8"), ("d1", "<i8"), ("d2", "<i8")])


def _sets(n: int, ranges: int):
    def run(batches):
        from pyspark import TaskContext

        base, row, known = TaskContext.get().partitionId() << 40, 0, _Words()
        docs, sets, held = [], [], 0
        for got in batches:
            for i, text in zip(got.column(0).to_pylist(), got.column(1)):
                h = shingle_hashes(text.as_py(), n, known)
                if len(known) > KNOWN:
                    known.clear()
                d1, d2 = int(h.sum(dtype=np.uint64)), int(_mixed(h + _MIX[2]).sum(dtype=np.uint64))
                docs.append((base + row, i or 0, i is None, len(h), d1 - (d1 >> 63 << 64), d2 - (d2 >> 63 << 64)))
                sets.append(h)
                row, held = row + 1, held + len(h)
                if held >= BATCH:
                    yield _pack(docs[0][0], np.array(docs, _DOC).tobytes(), sets, ranges)
                    docs, sets, held = [], [], 0
        if docs:
            yield _pack(docs[0][0], np.array(docs, _DOC).tobytes(), sets, ranges)

    return run


def _again(ranges: int):
    """As _sets, from sets whose members are known."""

    def run(batches):
        docs, sets, held = [], [], 0
        for got in batches:
            for row in got.to_pylist():
                h = np.frombuffer(row["members"], np.uint64)
                docs.append((row["key"], row["doc"] or 0, row["doc"] is None, row["n"], row["d1"], row["d2"]))
                sets.append(h)
                held += len(h)
                if held >= BATCH:
                    yield _pack(docs[0][0], np.array(docs, _DOC).tobytes(), sets, ranges)
                    docs, sets, held = [], [], 0
        if docs:
            yield _pack(docs[0][0], np.array(docs, _DOC).tobytes(), sets, ranges)

    return run


def _count(table: pa.Table) -> pa.Table:
    """One range: keep the members that lie in two documents or more, each with its count."""
    kinds = table.column("kind").to_pylist()
    heads, bodies = table.column("head").to_pylist(), table.column("body").to_pylist()
    batches, range_ = table.column("batch").to_pylist(), table.column("range")[0].as_py()
    out = [(batches[i], 0, heads[i], b"") for i, k in enumerate(kinds) if k == 0]
    rows = [i for i, k in enumerate(kinds) if k == 1]
    if rows:
        parts = [np.frombuffer(bodies[i], np.uint32) for i in rows]
        all_ = np.concatenate(parts)
        order = np.argsort(all_)
        inside = all_[order]
        first = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
        runs = np.diff(np.r_[first, len(inside)])
        df = np.empty(len(all_), np.uint32)
        df[order] = np.repeat(runs, runs)
        at = 0
        for i, p in zip(rows, parts):
            own = df[at : at + len(p)]
            at += len(p)
            head = np.frombuffer(heads[i], np.uint32)
            docs, sizes = head[: len(head) // 2], head[len(head) // 2 :]
            shared = own > 1
            if shared.any():
                key = (np.uint64(0xFFFF) - np.minimum(own[shared], 0xFFFF).astype(np.uint64)) << np.uint64(48)
                key |= np.uint64(range_ & 0xFFFF) << np.uint64(32) | p[shared].astype(np.uint64)
                out.append((batches[i], 1, np.repeat(docs, sizes)[shared].tobytes(), key.tobytes()))
    return pa.table(
        {
            "batch": pa.array([x[0] for x in out], pa.int64()),
            "kind": pa.array([x[1] for x in out], pa.int32()),
            "head": pa.array([x[2] for x in out], pa.binary()),
            "body": pa.array([x[3] for x in out], pa.binary()),
        }
    )


_SETS = "key long, doc long, n long, d1 long, d2 long, members binary"


def _gather(num: int, den: int):
    """One batch of documents: members in global order for those that can have a partner, null for the others."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        heads, bodies = table.column("head").to_pylist(), table.column("body").to_pylist()
        docs = np.frombuffer(next(h for h, k in zip(heads, kinds) if k == 0), _DOC)
        owner = np.concatenate([np.frombuffer(h, np.uint32) for h, k in zip(heads, kinds) if k] or [np.empty(0, np.uint32)])
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b, k in zip(bodies, kinds) if k] or [np.empty(0, np.uint64)])
        shared = np.bincount(owner, minlength=len(docs))
        least = -(-docs["n"] * num // den)
        alive = (shared >= least) & (docs["n"] > 0)
        keep = alive[owner]
        owner, keys = owner[keep], keys[keep]
        order = np.lexsort((keys, owner))
        keys, ends = keys[order], np.cumsum(np.where(alive, shared, 0))
        members = [keys[e - s : e].tobytes() if a else None for a, e, s in zip(alive, ends, shared)]
        return pa.table(
            {
                "key": pa.array(docs["key"]),
                "doc": pa.array(docs["id"], mask=docs["null"] > 0),
                "n": pa.array(docs["n"]),
                "d1": pa.array(docs["d1"]),
                "d2": pa.array(docs["d2"]),
                "members": pa.array(members, pa.binary()),
            }
        )

    return run


def _pruned(packed: DataFrame, num: int, den: int) -> DataFrame:
    counted = packed.groupBy("range").applyInArrow(_count, "batch long, kind int, head binary, body binary")
    return counted.groupBy("batch").applyInArrow(_gather(num, den), _SETS)


def _posted(num: int, den: int):
    """(member, key, n) for the members of each set's prefix in the rare-first order that are shared at all."""

    def run(batches):
        for got in batches:
            member, key, size = [], [], []
            for row in got.to_pylist():
                m, n = np.frombuffer(row["members"], np.int64), row["n"]
                prefix = n - need(n, num, den) + 1 - (n - len(m))
                member.append(m[len(m) - prefix :])
                key.append(np.full(prefix, row["key"]))
                size.append(np.full(prefix, n))
            if member:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in (member, key, size)], names=["member", "key", "n"]
                )

    return run


class _Trie:
    """Sets in global order, common beginnings stored once. Members are numbered by their order."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.members = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        rows = [np.searchsorted(self.members, s).astype(np.int32) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: rows[i].astype(">i4").tobytes())
        rows = [rows[i] for i in order]
        common = [0] * len(rows)
        for i in range(1, len(rows)):
            k = min(len(rows[i - 1]), len(rows[i]))
            differ = np.flatnonzero(rows[i - 1][:k] != rows[i][:k])
            common[i] = int(differ[0]) if len(differ) else k
        #: (edge, its last member, smallest set below, longest way below, sets that end here, first child, next sibling)
        self.nodes: list[tuple] = []
        self.kids: list[list[int]] = []
        stack = [(0, len(rows), 0, -1)] if rows else []
        while stack:
            lo, hi, depth, parent = stack.pop()
            end = min(common[lo + 1 : hi]) if hi - lo > 1 else len(rows[lo])
            edge = rows[lo][depth:end]
            number = len(self.nodes)
            if parent >= 0:
                self.kids[parent].append(number)
            smallest, longest = min(sizes[order[i]] for i in range(lo, hi)), max(len(rows[i]) for i in range(lo, hi)) - end
            ends = []
            while lo < hi and len(rows[lo]) == end:
                ends.append((order[lo], sizes[order[lo]]))
                lo += 1
            self.nodes.append((edge, int(edge[-1]) if len(edge) else -1, smallest, longest, ends))
            self.kids.append([])
            start = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or common[i] <= end:
                    if start < i:
                        stack.append((start, i, end, number))
                    start = i

    def search(self, probe: np.ndarray, n: int, num: int, den: int) -> list[tuple[int, int]]:
        """(row, overlap) of the sets whose similarity with the probe reaches num / den."""
        if not self.nodes:
            return []
        at = np.searchsorted(self.members, probe)
        at = at[(at < len(self.members)) & (self.members[np.minimum(at, len(self.members) - 1)] == probe)]
        held = np.zeros(len(self.members), np.int32)
        held[at] = 1
        upto = np.cumsum(held)
        total, both, found, stack = len(at), num + den, [], [(0, 0)]
        while stack:
            number, overlap = stack.pop()
            edge, last, smallest, longest, ends = self.nodes[number]
            if len(edge):
                overlap += int(held[edge].sum())
            left = total - (int(upto[last]) if last >= 0 else 0)
            if (overlap + (left if left < longest else longest)) * both < num * (n + smallest):
                continue
            for row, size in ends:
                if overlap * both >= num * (n + size):
                    found.append((row, overlap))
            for kid in self.kids[number]:
                stack.append((kid, overlap))
        return found


def _inside(num: int, den: int):
    """One trie's documents: (node, root), the components that the links inside it form."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["key", "n", "members"]).to_pylist(), key=lambda r: r["key"])
        keys, sizes = [r["key"] for r in rows], [r["n"] for r in rows]
        sets = [np.frombuffer(r["members"], np.uint64) for r in rows]
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        if len(rows) > 1:
            trie = _Trie(sets, sizes)

            def probe(i: int) -> None:
                for j, _ in trie.search(sets[i], sizes[i], num, den):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)

            # whatever ends in the anchor's component needs no probe of its own: the other side of a pair has one
            first = range(0, len(rows), max(1, len(rows) // 8))
            for i in first:
                probe(i)
            size = np.bincount([find(i) for i in range(len(rows))])
            anchor = int(size.argmax())
            for i in range(len(rows)):
                if i not in first and find(i) != find(anchor):
                    probe(i)
        return pa.table({"node": pa.array(keys, pa.int64()), "root": pa.array([keys[find(i)] for i in range(len(rows))], pa.int64())})

    return run


def _between(num: int, den: int):
    """Probes against one trie: (a, b), pairs of components that a link joins."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["key", "root", "n", "members", "asks"]).to_pylist()
        held, asked = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
        trie = _Trie([np.frombuffer(r["members"], np.uint64) for r in held], [r["n"] for r in held])
        links = set()
        for r in asked:
            for i, _ in trie.search(np.frombuffer(r["members"], np.uint64), r["n"], num, den):
                if held[i]["root"] != r["root"]:
                    links.add((r["root"], held[i]["root"]))
        links = sorted(links)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _probed(asked: DataFrame, posted: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components that the documents `asked` (key) find in the tries that hold their postings.

    posted: member, key, root, trie; sets: key, n, members, root, trie.
    """
    held = posted.groupBy("member", "trie").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mine = posted.join(asked, "key", "left_semi").select("member", "key", "root")
    routes = cut(
        mine.join(held, "member").where((F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))).select("key", F.col("trie").alias("to")).distinct()
    )
    tasks = cut(routes.groupBy("to").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts")))
    probes = (
        routes.join(tasks, "to").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        .join(sets.drop("trie"), "key").select("to", "part", "key", "root", "n", "members", F.lit(True).alias("asks"))
    )
    kept = sets.join(tasks.withColumnRenamed("to", "trie"), "trie").select(
        F.col("trie").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "root", "n", "members", F.lit(False).alias("asks")
    )
    return probes.unionByName(kept).groupBy("to", "part").applyInArrow(_between(num, den), "a long, b long").distinct()


def jaccard_components(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class) for each row of documents.

    component_id is the smallest id that links of similarity num / den or more reach; n_class counts the rows with
    the same set.
    """
    spark = documents.sparkSession
    ship(spark)
    ranges = 64
    while ranges < 4 * shuffle_width(spark) and ranges < 1 << 16:
        ranges *= 2
    read = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_pruned(read.mapInArrow(_sets(n, ranges), _PACKED), num, den))
    alive = rows.where("members IS NOT NULL")
    # equal sets: one representative, the row with the smallest id
    classes = cut(
        alive.groupBy("n", "d1", "d2").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "key")).alias("least"), F.count("*").alias("n_class"))
        .select("n", "d1", "d2", F.col("least.doc").alias("rep_doc"), F.col("least.key").alias("rep"), "n_class")
    )
    single = alive.join(classes.select(F.col("rep").alias("key")), "key", "left_semi")
    sets = cut(_pruned(single.mapInArrow(_again(ranges), _PACKED), num, den).where("members IS NOT NULL").select("key", "n", "members"))
    posted = cut(sets.mapInArrow(_posted(num, den), "member long, key long, n long"))

    pivots = posted.groupBy("member").agg(F.min(F.struct("n", "key")).alias("pivot"), F.count("*").alias("held"))
    # a member that only one set holds in its prefix can't lead to a partner
    near = posted.join(pivots.where("held > 1").select("member", "pivot"), "member").groupBy("key").agg(F.min("pivot").alias("pivot"))
    homes = near.select("key", F.col("pivot.key").alias("home"))
    tries = homes.groupBy("home").agg(F.ceil(F.count("*") / TRIE).cast("int").alias("tries"))
    placed = cut(homes.join(tries, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("tries"))).alias("trie")))
    full = cut(sets.join(placed, "key"))
    labels = cut(full.groupBy("trie").applyInArrow(_inside(num, den), "node long, root long"))
    # a very long document has many postings: they meet its trie and root in parts of about SPREAD
    parts = F.greatest(F.ceil(F.col("n") / SPREAD), F.lit(1)).cast("long")
    spread = posted.select("member", "key", F.pmod(F.xxhash64("member"), parts).alias("salt"))
    for last in (False, True):
        known = labels.select(F.col("node").alias("key"), "root")
        of = full.select("key", "n", "trie").join(known, "key").select("key", "trie", "root", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
        at = cut(spread.join(of, ["key", "salt"]).select("member", "key", "trie", "root"))
        mixed = at.groupBy("member").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("member")
        at = cut(at.join(mixed, "member", "left_semi"))
        if last:
            # the largest component of each posting need not ask
            sizes = at.groupBy("member", "root").agg(F.count("*").alias("c"))
            main = sizes.groupBy("member").agg(F.max(F.struct("c", "root")).alias("m")).select("member", F.col("m.root").alias("main"))
            asked = at.join(main, "member").where("root <> main").select("key").distinct()
        else:
            turn = F.xxhash64("key")
            asked = at.select("key", "root", "trie").distinct().groupBy("root", "trie").agg(F.min(F.struct(turn, "key")).alias("x"), F.max(F.struct(turn, "key")).alias("y"))
            asked = asked.select(F.explode(F.array("x.key", "y.key")).alias("key")).distinct()
        found = cut(_probed(asked, at, full.join(known, "key"), num, den))
        if not found.isEmpty():
            joined = components(found).select(F.col("node").alias("was"), F.col("root").alias("now"))
            labels = cut(labels.join(joined, labels["root"] == joined["was"], "left").select("node", F.coalesce("now", "root").alias("root")))
    # a component's smallest id, over its representatives; each stands for its class
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", "n_class", "rep_doc", F.coalesce("root", "rep").alias("root"))
    least = named.groupBy("root").agg(F.min("rep_doc").alias("component"))
    named = named.join(least, "root").select("n", "d1", "d2", "n_class", "component")
    out = rows.withColumn("near", F.col("members").isNotNull()).drop("members").join(
        named.withColumn("near", F.lit(True)), ["n", "d1", "d2", "near"], "left"
    )
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("near"), F.col("component")).otherwise(F.col("doc")).alias("component_id"),
        F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"),
    )
