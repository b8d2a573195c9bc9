"""Two versions of a text by lines: what stayed, moved, went and came, patches from that, and renamed files.

Lines that occur once on both sides are anchors; the longest run of anchors in the same order on both sides (patience sorting)
stays, the other anchors moved. From the anchors, and from both ends, equal lines are taken as the same forwards, then
backwards. What is left went or came. Lines are compared by their digests, so texts aren't moved for it.

A pair of files is one group: its size is that of the two files' rows.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palisade.operators.graphs import _cut


def _rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    tails, ends, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def matched(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(kind, old line, new line), lines from 1; kind is same, moved, removed or added."""
    once = lambda side: {x for x, n in Counter(side).items() if n == 1}
    shared, place = once(old) & once(new), {x: j for j, x in enumerate(new)}
    anchors = [(i, place[x]) for i, x in enumerate(old) if x in shared]
    kept = [anchors[k] for k in _rising([j for _, j in anchors])]
    pairs, moved = dict(kept), dict(anchors)
    ahead = (-1, -1)
    for end in [*kept, (len(old), len(new))]:
        (i, j), (to_i, to_j) = ahead, end
        while i + 1 < to_i and j + 1 < to_j and old[i + 1] == new[j + 1]:
            i, j = i + 1, j + 1
            pairs[i] = j
        while to_i - 1 > i and to_j - 1 > j and old[to_i - 1] == new[to_j - 1]:
            to_i, to_j = to_i - 1, to_j - 1
            pairs[to_i] = to_j
        ahead = end
    out = [("same", i + 1, j + 1) for i, j in pairs.items()]
    taken = set(pairs.values())
    moves = {i: j for i, j in moved.items() if i not in pairs and j not in taken}
    out += [("moved", i + 1, j + 1) for i, j in moves.items()]
    taken |= set(moves.values())
    out += [("removed", i + 1, None) for i in range(len(old)) if i not in pairs and i not in moves]
    return out + [("added", None, j + 1) for j in range(len(new)) if j not in taken]


def line_map(lines: DataFrame) -> DataFrame:
    """(pair, kind, old_line, new_line) for each line of both sides.

    lines: (pair, side, line, text) with side old or new and lines from 1 without gaps; a null text counts as an empty line. A pair
    that has one side alone is all removed or all added; an empty table gives an empty result.
    """
    hashed = lines.select("pair", "side", "line", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line")
        sides = [frame.loc[frame["side"] == s, "digest"].tolist() for s in ("old", "new")]
        out = pd.DataFrame(matched(*sides), columns=["kind", "old_line", "new_line"]).astype({"old_line": "Int64", "new_line": "Int64"})
        out["pair"] = pd.Series([frame["pair"].iloc[0]] * len(out), dtype=frame["pair"].dtype)
        return out[["pair", "kind", "old_line", "new_line"]]

    kind = dict(lines.dtypes)["pair"]
    return hashed.groupBy("pair").applyInPandas(one, f"pair {kind}, kind string, old_line long, new_line long")


def patch(lines: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The map with the text of added lines: all that turns the old side into the new one."""
    mapping = line_map(lines) if mapping is None else mapping
    new = lines.where("side = 'new'").select("pair", F.col("line").cast("long").alias("new_line"), "text", F.lit("added").alias("kind"))
    return mapping.join(new, ["pair", "kind", "new_line"], "left").select("pair", "kind", "old_line", "new_line", "text")


def apply_patch(old: DataFrame, changes: DataFrame) -> DataFrame:
    """(pair, line, text) of the new side from (pair, line, text) of the old side and a patch.

    Lines that the patch takes from where the old side has none come out as null texts.
    """
    kept = old.select("pair", F.col("line").cast("long").alias("old_line"), F.col("text").alias("was"))
    out = changes.where("kind <> 'removed'").join(kept, ["pair", "old_line"], "left")
    return out.select("pair", F.col("new_line").alias("line"), F.when(F.col("kind") == "added", F.col("text")).otherwise(F.col("was")).alias("text"))


def renames(old: DataFrame, new: DataFrame, share: float = 0.5, shortest: int = 12) -> DataFrame:
    """(old_path, new_path, shared, similarity): files of one snapshot that go on under another name in the other.

    old, new: (path, text). Files whose path is in both aren't asked about. A line of `shortest` characters or more that exactly
    one file of either side holds speaks for a pair; a pair stands if each is the other's best (most lines, then the least
    path) and shares `share` or more of the larger one's distinct such lines. Null texts have no lines.
    """
    # a file is its distinct lines' digests, 128 bits of SHA-256 each, before anything is moved
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= shortest)
    digests = F.transform(F.array_distinct(trimmed), lambda x: F.substring(F.unhex(F.sha2(x, 256)), 1, 16))
    before, after = (side.where("path IS NOT NULL").select("path", digests.alias("lines")).dropDuplicates(["path"]) for side in (old, new))
    gone, came = before.join(after.select("path"), "path", "left_anti"), after.join(before.select("path"), "path", "left_anti")
    only = lambda side, name: side.select("path", F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").select("line", name)
    size = lambda side, name: side.select(F.col("path").alias(f"{name}_path"), F.size("lines").cast("long").alias(f"{name}_lines"))
    votes = _cut(only(gone, "old_path").join(only(came, "new_path"), "line").groupBy("old_path", "new_path").agg(F.count("*").alias("shared")))
    best = lambda key, other: votes.groupBy(key).agg(F.min_by(other, F.struct(-F.col("shared"), other)).alias(other))
    pairs = votes.join(best("old_path", "new_path"), ["old_path", "new_path"], "left_semi").join(best("new_path", "old_path"), ["old_path", "new_path"], "left_semi")
    out = pairs.join(size(gone, "old"), "old_path").join(size(came, "new"), "new_path").withColumn("similarity", F.col("shared") / F.greatest("old_lines", "new_lines"))
    return out.where(F.col("similarity") >= share).select("old_path", "new_path", "shared", "similarity")
