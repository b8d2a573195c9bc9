"""BPE encoding and decoding with a tokenisation automaton.

The merges are compiled into a deterministic automaton over tokens. It starts with one state and a loop for each
byte. The gadget of merge number k, (a, b) -> c, takes the arc b off the state that a leads to (at time 2k), and gives
every state that still has an arc a another arc c beside it (at time 2k + 1); c leads to what b led to before the cut.
After the last gadget exactly one path spells any string, and its arcs are the string's tokens in merge order.

A state is named by the token that leads to it. What a gadget did to a state is kept as three tables: the time at
which an arc leaves a state, and the parents (left: the arc beside which an arc was put; right: the state of which a
state is a copy). `Automaton.arc` unrolls those gadgets for one state and arc and stores the answer in the transition
table, so rows are filled as text first needs them. Encoding a word walks the table along the one path that spells it,
trying longer arcs first and leaving a place for good once no path leads on. Decoding emits the labels of the arcs.

Texts are cut into pieces a whole Arrow batch at a time (`pieces`), and each distinct piece is split and encoded once.
What pieces became stays in a cache that is bounded by bytes; texts and words have no limits, and a text's tokens don't
depend on what was remembered before.

Defined cases: null and empty texts have no tokens and decode to the empty text; a control string of the vocabulary
inside a text is its control token, as the public library does by default; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import ship
from palisade.llm.pieces import Cache, joined

_ENDLESS, _SPREAD = 1 << 40, np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are encoded one by one; and how many words take their steps together.
LONG, TOGETHER = 48, 40_000
#: What closes a word in labels: no byte is this character.
CLOSE = chr(256)
#: Bytes of remembered pieces in a generation of a worker's cache.
REMEMBERED = 64 << 20


def byte_labels() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A fixed map from non-negative whole numbers to whole numbers, read a whole array at a time."""

    def __init__(self, keys: list[int], values: list[int]):
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, of = np.array(keys, np.int64), np.array(values, np.int64)
        at = self.slots(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]  # of several the last one stays
            placed = self.keys[at] == left
            self.values[at[placed]] = of[placed]
            left, of, at = left[~placed], of[~placed], (at[~placed] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self.slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found >= 0) & (found != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found, wanted = self.keys[at], keys[left]
            hit = found == wanted
            out[left[hit]] = self.values[at[hit]]
            more = (found >= 0) & ~hit
            left, at = left[more], at[more]
        return out


class Automaton:
    """label: of each token, its text as a string of bytes' code points; merges: pairs of tokens, in order."""

    def __init__(self, label: dict[int, str], merges: list[tuple[int, int, int]], transitions: int = 400_000):
        self.label, self.most = label, transitions
        self.by_label = {s: i for i, s in label.items()}
        size = max(label) + 1
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.leaves: dict[tuple[int, int], int] = {}
        for k, (a, b, c) in enumerate(merges):
            self.leaves.setdefault((a, b), k)
            if self.born[c] < 0:
                self.born[c], self.left[c], self.right[c] = k, a, b
        self.lengths: dict[str, set[int]] = {}  # of the labels that begin with three characters
        for s in self.by_label:
            if len(s) > 2:
                self.lengths.setdefault(s[:3], set()).add(len(s))
        self.table: dict[int, bool] = {}
        self.reach: dict[str, tuple[int, ...]] = {}
        self._arrays()

    @classmethod
    def of(cls, vocab: dict[str, int], merges: list, suffix: str = "") -> Automaton:
        """Of a byte-level vocabulary; a suffix that closes words becomes the character `CLOSE`."""
        plain = byte_labels()

        def label(s: str) -> str:
            closed = bool(suffix) and s.endswith(suffix)
            return "".join(chr(plain[c]) for c in (s[: -len(suffix)] if closed else s)) + (CLOSE if closed else "")

        pairs = (pair if isinstance(pair, (list, tuple)) else pair.split(" ") for pair in merges)
        return cls({i: label(s) for s, i in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has the arc token on the state."""
        born, left, right, leaves, time = self.born, self.left, self.right, self.leaves, _ENDLESS
        while True:
            k = leaves.get((state, token))
            if k is not None and 2 * k < time:
                return False
            if born[token] >= born[state]:
                if born[token] < 0:
                    return True
                time, token = 2 * born[token] + 1, left[token]
            else:
                time, state = 2 * born[state], right[state]

    def _arrays(self) -> None:
        """The same tables for whole arrays of words: gadgets, a trie of the labels, and remembered transitions."""
        self.born_, self.left_, self.right_ = (np.array(x, np.int64) for x in (self.born, self.left, self.right))
        self.leaves_ = Table([a << 20 | b for a, b in self.leaves], list(self.leaves.values()))
        self.length_ = np.zeros(len(self.born), np.int64)
        steps, token = {}, [-1]
        for i, s in self.label.items():
            self.length_[i], node = len(s), 0
            for c in s:
                key = node << 9 | ord(c)
                node = steps.get(key)
                if node is None:
                    node = steps[key] = len(token)
                    token.append(-1)
            token[node] = i
        self.steps_, self.token_ = Table(list(steps), list(steps.values())), np.array(token, np.int64)
        self.seen_ = np.full(1 << 20, -1, np.int64)  # transition * 2 + whether it exists

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`arc` for arrays."""
        out = np.zeros(len(state), bool)
        at, time = np.arange(len(state)), np.full(len(state), _ENDLESS)
        while len(at):
            k = self.leaves_[state << 20 | token]
            gone = (k >= 0) & (2 * k < time)
            bt, bs = self.born_[token], self.born_[state]
            by_token = bt >= bs
            out[at[~gone & by_token & (bt < 0)]] = True
            more = ~gone & ~(by_token & (bt < 0))
            at, state, token, by_token, bt, bs = (x[more] for x in (at, state, token, by_token, bt, bs))
            time = np.where(by_token, 2 * bt + 1, 2 * bs)
            state, token = np.where(by_token, state, self.right_[state]), np.where(by_token, self.left_[token], token)
        return out

    def _known(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the transitions exist, from the table where it has them."""
        key = state << 20 | token
        at = ((key.astype(np.uint64) * _SPREAD) >> np.uint64(44)).astype(np.int64)
        held = self.seen_[at]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            held[new] = key[new] << 1 | self._arcs(state[new], token[new])
            self.seen_[at[new]] = held[new]
        return (held & 1).astype(bool)

    def encode_all(self, words: list[bytes], closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, where each word's begin): every word takes its next step of the walk at the same time."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        symbols = np.frombuffer((b"\xff" if closed else b"").join([*words, b""]), np.uint8).astype(np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words)) + closed
        if closed:  # this byte is in no text of UTF-8
            symbols = np.where(symbols == 255, ord(CLOSE), symbols)
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        base = start + np.arange(len(words))  # of the states before and behind each symbol
        states = np.full(int(n.sum()) + len(words), -1, np.int64)
        for i in range(int(n.max())):
            w = np.flatnonzero(n > i) if i == 0 else w[n[w] > i]
            if i:
                reached = w[states[base[w] + i] >= 0]
            else:
                reached = w
            node, s, k = np.zeros(len(reached), np.int64), states[base[reached] + i], i
            while len(reached):
                node = self.steps_[node << 9 | symbols[start[reached] + k]]
                k += 1
                on = node >= 0
                reached, node, s = reached[on], node[on], s[on]
                token = self.token_[node]
                is_ = np.flatnonzero(token >= 0)
                if len(is_):
                    r, t = reached[is_], token[is_]
                    if i:
                        ok = self._known(s[is_], t)
                        r, t = r[ok], t[ok]
                    states[base[r] + k] = t
                more = n[reached] > k
                reached, node, s = reached[more], node[more], s[more]
        # back along the paths, last tokens first
        at, w, found, of = n.copy(), np.flatnonzero(n > 0), [], []
        while len(w):
            u = states[base[w] + at[w]]
            found.append(u)
            of.append(w)
            at[w] -= self.length_[u]
            w = w[at[w] > 0]
        count = np.zeros(len(words), np.int64)
        for w in of:
            count[w] += 1
        bounds = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(int(bounds[-1]), np.int64)
        last = bounds[1:].copy()
        for u, w in zip(found, of):
            last[w] -= 1
            out[last[w]] = u
        return out, bounds

    def _reach(self, ahead: str) -> tuple[int, ...]:
        """The lengths that labels beginning as the next three characters can have, longest first."""
        found = set(self.lengths.get(ahead, ()))
        found.update(k for k in range(1, min(len(ahead), 2) + 1) if ahead[:k] in self.by_label)
        if len(self.reach) >= self.most:
            self.reach.clear()
        self.reach[ahead] = out = tuple(sorted(found, reverse=True))
        return out

    def tokens(self, split: list[list[bytes]], closed: bool = False) -> Iterator[list[int]]:
        """The tokens of each list of words."""
        at = 0
        while at < len(split):
            end, some = at, 0
            while end < len(split) and some < TOGETHER:
                some += len(split[end])
                end += 1
            short = [w for ws in split[at:end] for w in ws if len(w) <= LONG]
            ids, bounds = self.encode_all(short, closed)
            ids, bounds, k = ids.tolist(), bounds.tolist(), 0
            for ws in split[at:end]:
                first, out = k, []
                for w in ws:
                    if len(w) <= LONG:
                        k += 1
                    else:
                        out += ids[bounds[first] : bounds[k]] + self.encode(w.decode("latin-1") + (CLOSE if closed else ""))
                        first = k
                yield out + ids[bounds[first] : bounds[k]]
            at = end

    def encode(self, word: str) -> list[int]:
        """The tokens on the one path that spells the word.

        The longest arc is tried first. A place has one state at most, as each prefix has one path; so a place from
        which the end can't be reached is never entered again, and the walk is linear.
        """
        if not word:
            return []
        n, by_label, table, reach = len(word), self.by_label, self.table, self.reach
        path: list[int] = []
        tried: list = []  # for each state of the path, the lengths that are left
        dead: set[int] = set()
        i, state, left = 0, -1, None
        while True:
            if left is None:
                ahead = word[i : i + 3]
                left = iter(reach.get(ahead) or self._reach(ahead))
            for length in left:
                j = i + length
                if j > n or j in dead:
                    continue
                u = by_label.get(word[i:j])
                if u is None:
                    continue
                if state >= 0:
                    key = state << 20 | u
                    ok = table.get(key)
                    if ok is None:
                        if len(table) >= self.most:
                            table.clear()
                        table[key] = ok = self.arc(state, u)
                    if not ok:
                        continue
                path.append(u)
                if j == n:
                    return path
                tried.append((i, state, left))
                i, state, left = j, u, None
                break
            else:
                dead.add(i)
                if not tried:
                    raise ValueError(f"no path spells {word!r}")
                i, state, left = tried.pop()
                path.pop()


class Codec:
    """Encoding and decoding with a byte-level vocabulary file of the tokenizers library."""

    #: How such vocabularies split text before merging: fixed by the public file format.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, most: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.automaton = Automaton.of(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: s.encode("latin-1") for i, s in self.automaton.label.items()} | {i: s.encode() for s, i in self.special.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._words = regex.compile(self.SPLIT).findall
        self._known = Cache(most)

    def _split(self, piece: str) -> list[bytes]:
        if piece.isascii() and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):
            return [piece.encode()]
        return [w.encode("utf-8", "surrogatepass") for w in self._words(piece)]

    def _made(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, each with a comma behind it; bytes that their arcs emit) of pieces without control strings."""
        split = list(map(self._split, pieces))
        label, out = self.label.__getitem__, []
        for ids in self.automaton.tokens(split):
            out.append((b"%d," * len(ids) % tuple(ids), b"".join(map(label, ids))))
        return out

    def look(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        return self._known.all(pieces, self._made)

    def _controlled(self, text: str) -> list[bytes]:
        """The same for a whole text that holds control strings."""
        parts = []
        for k, piece in enumerate(self._cut.split(text)):
            if k % 2:
                i = self.special[piece]
                parts.append((b"%d," % i, self.label[i]))
            elif piece:
                parts.append(self._made([piece])[0])
        return [b"".join(p[k] for p in parts) for k in (0, 1)]

    def parts(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """[ids, each with a comma behind it; the bytes that decoding emits] of each text of an Arrow array."""
        held = None
        for s in self.special:
            has = pc.match_substring(texts, s)
            held = has if held is None else pc.or_(held, has)
        odd = set(np.flatnonzero(held.fill_null(False).to_numpy(zero_copy_only=False)).tolist()) if held is not None else set()
        if odd:  # these are read on their own
            kept = pa.array([i not in odd for i in range(len(texts))])
            plain = pc.if_else(kept, texts, pa.scalar("", texts.type))
        else:
            plain = texts
        for i, got in enumerate(joined(plain, self.look, 2)):
            yield self._controlled(texts[i].as_py()) if i in odd else got

    def encode(self, text: str | None) -> list[int]:
        ids, _ = next(self.parts(pa.array([text], pa.string())))
        return list(map(int, ids.split(b",")[:-1]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


FIELDS = {
    "ids": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def bpe(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fields: tuple = ("ids", "decoded")) -> DataFrame:
    """(id, *fields) for each row of documents: its tokens, what they decode to, their number, or digests of both.

    path: of a byte-level BPE vocabulary file that every executor can read.
    """
    ship(documents.sparkSession)

    def run(batches):
        c = codec(path)
        kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
        for got in batches:
            columns = {f: [] for f in fields}
            for ids, emitted in c.parts(got.column(1)):
                if "ids" in columns:
                    columns["ids"].append(np.array(ids.split(b",")[:-1], np.int32))
                if "n_tokens" in columns:
                    columns["n_tokens"].append(ids.count(b","))
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(ids[:-1]).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    text = emitted.decode("utf-8", "replace")
                    if "decoded" in columns:
                        columns["decoded"].append(text)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [got.column(0), *(pa.array(columns[f], kinds[FIELDS[f]]) for f in fields)], names=["__id", *fields]
            )

    read = documents.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return read.mapInArrow(run, "__id long, " + ", ".join(f"{f} {FIELDS[f]}" for f in fields)).withColumnRenamed("__id", id_col)
