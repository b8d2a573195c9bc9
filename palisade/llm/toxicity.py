"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut at white space into windows
of about `WINDOW` bytes, every window is compressed with either dictionary, and what the toxic one saves is the window's
distance. A text's features are its largest distance, the sum of its distances above the window threshold, and the
number of such windows; a logistic curve calibrated on texts that trained no dictionary turns them into a score.

Most of a toxic text is ordinary, and a dictionary trained on all of it mostly holds ordinary text. So the toxic samples
are words: those that at least `LEAST` toxic texts hold, and hold `CONTRAST` times as often as ordinary ones. The toxic
dictionary is the ordinary one with what zstandard's trainer picks from those samples and their commonest spellings
behind it, so a window of ordinary text costs the same with either. The README has the figures of dictionaries that were
trained on whole windows or passages; they tell the classes apart far less well.

Learning takes a bounded sample of labelled rows (at most `DOCS` a class, those with the smallest hash of their id, and
at most `CLASS_BYTES` of their text in UTF-8, a text a document); every row is scored on its whole text.

Defined cases: null and empty texts have no windows and get the score of a text without any distance; texts are
compared in lower case; repeated rows stay; a document with labels of both classes teaches neither, and one with several
texts teaches its least; without labels of both classes every score is the share of toxic labels (0 without labels); the
score column takes the place of one of its name, other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import ship

DOCS, CLASS_BYTES, WINDOW, DICTIONARY, LEVEL = 2000, 6_000_000, 36, 16_384, 3
#: A word's share among toxic texts over that among ordinary ones, and how many toxic texts must hold it.
CONTRAST, LEAST = 40.0, 5
#: Rounds in which ordinary windows that look toxic join the ordinary samples, and their bytes in each.
ROUNDS, HARD_BYTES = 3, 6_000


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in pieces of about `size` bytes, cut at white space where there is any."""
    data = text.lower().encode("utf-8", "surrogatepass")
    out, at, n = [], 0, len(data)
    while at < n:
        end = at + size
        if end < n:
            space = data.rfind(b" ", at + size // 2, end)
            end = space if space > 0 else end
        out.append(data[at:end])
        at = end
    return out


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, cut: int, weights: tuple):
        self.ordinary, self.toxic, self.cut, self.weights = ordinary, toxic, cut, weights
        self._made = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.cut, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._made is None:
            self._made = []
            for raw in (self.ordinary, self.toxic):
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self._made.append(
                    zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress
                )
        return self._made

    def distances(self, text: str) -> list[int]:
        if not (self.ordinary and self.toxic):
            return []
        ordinary, toxic = self._compressors()
        return [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]

    def features(self, text: str) -> tuple[float, ...]:
        d = self.distances(text)
        above = [x for x in d if x >= self.cut]
        return float(max(d, default=0)), math.log1p(sum(above)), math.log1p(len(above)), math.log1p(len(d))

    def score(self, text: str | None) -> float:
        f = self.features(text or "")
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer picks from the samples; the samples themselves if they are too few for it."""
    joined = b"".join(samples)
    if len(joined) > 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return joined[-size:]


def _logistic(rows: list[tuple], labels: list[int], steps: int = 60) -> tuple:
    """Newton's method with a small ridge; features are few."""
    import numpy as np

    x = np.column_stack([np.ones(len(rows)), np.array(rows, float).reshape(len(rows), -1)])
    y, w = np.array(labels, float), np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, 1 if toxic). Every third row of a class trains no dictionary and calibrates."""
    split = {y: list(dict.fromkeys(t for t, label in rows if label == y)) for y in (0, 1)}
    if not split[0] or not split[1]:
        share = len(split[1]) / len(rows) if rows else 0.0
        z = math.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return Model(b"", b"", 1, (max(-30.0, min(30.0, z)), 0.0, 0.0, 0.0, 0.0))
    train = {y: [t for i, t in enumerate(v) if i % 3] or v for y, v in split.items()}
    held = [(t, y) for y, v in split.items() for i, t in enumerate(v) if i % 3 == 0]
    share = {y: Counter(w for t in v for w in _words(t)) for y, v in train.items()}
    n = {y: len(v) for y, v in train.items()}
    telling = {
        w for w, c in share[1].items()
        if c >= min(LEAST, n[1]) and len(w) > 2 and c / n[1] >= CONTRAST * (share[0][w] + 0.5) / n[0]
    }
    around = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(telling))) + r")\b") if telling else None
    passages = [b" " + m[0].encode() + b" " for t in train[1] for m in (around.finditer(t.lower()) if around else [])]
    ordinary = [w for t in train[0] for w in windows(t)]
    base = _dictionary(ordinary, DICTIONARY)
    # passages end the dictionary, where matches are cheapest; ordinary text is the same in both
    toxic = _dictionary(passages, DICTIONARY // 4) if passages else base[:1]
    kinds = b" ".join(p for p, _ in Counter(passages).most_common(300))
    model = Model(base, base + toxic + b" " + kinds + b" ", 1, (0.0,) * 5)
    for _ in range(ROUNDS):
        hard = Counter(w for t in train[0] for w, d in zip(windows(t), model.distances(t)) if d >= 2)
        add, room = [], HARD_BYTES
        for w, _ in sorted(hard.items(), key=lambda x: (-x[1], x[0])):
            room -= len(w)
            if room < 0:
                break
            add.append(w)
        if not add:
            break
        base = b"".join(add) + base
        model = Model(base, base + toxic + b" " + kinds + b" ", 1, model.weights)
    # the window threshold: the least distance that fewer than one in a thousand ordinary windows reach
    far = Counter(d for t, y in held if not y for d in model.distances(t))
    total, seen, cut = sum(far.values()), 0, max(far, default=0) + 1
    for d in sorted(far, reverse=True):
        seen += far[d]
        if seen * 1000 > total:
            break
        cut = d
    model.cut = max(1, cut)
    model.weights = _logistic([model.features(t) for t, _ in held], [y for _, y in held])
    return model


def learn(documents: DataFrame, labels: DataFrame, docs: int = DOCS, class_bytes: int = CLASS_BYTES, text_col: str = "text") -> Model:
    """Fit on at most `docs` labelled documents a class. labels: (doc_id, toxic), only rows that may be learnt from."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most")).where("toxic = most").drop("most")
    )
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
        drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * docs rows of two numbers: the only side that is broadcast
    texts = documents.select(F.col("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    got = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    rows, used = [], {0: 0, 1: 0}
    for r in got.toLocalIterator():
        if used[r["toxic"]] < class_bytes:
            used[r["toxic"]] += len(r["text"].encode("utf-8", "surrogatepass"))
            rows.append((r["text"], r["toxic"]))
    return fit(rows)


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with a score between 0 and 1 for each row's whole text, higher for likelier toxic."""
    ship(documents.sparkSession)

    def run(batches):
        for got in batches:
            at = got.schema.get_field_index(text_col)
            values = [model.score(v.as_py()) for v in got.column(at)]
            kept = [c for c in got.schema.names if c != score_col]
            yield pa.RecordBatch.from_arrays(
                [*(got.column(got.schema.get_field_index(c)) for c in kept), pa.array(values, pa.float64())], names=[*kept, score_col]
            )

    kept = documents.drop(score_col)
    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{score_col} double"]))
