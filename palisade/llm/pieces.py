"""Texts of Arrow batches as pieces that tokenise alone, and what became of the pieces.

`cut` finds places where no match of a byte-level vocabulary's splitting pattern can cross, by looking at three bytes: before
a space that a visible character follows, around the last of other white space before a visible character, and between a
letter and an ASCII mark. Pieces are views of the batch's own buffer. Equal pieces of a batch are found by a dictionary
encoding, so Python sees each of them once a slice; what they became is remembered in a `Cache` bounded by bytes. Where
pieces become ids alone, `Ids` remembers them in arrays, and `ids_of_texts` makes no object for a piece at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are looked at and pieces that are joined at a time.
WINDOW, SLICE = 1 << 22, 1 << 19
#: Pieces, and bytes of pieces (unless one has more), whose ids are put together at a time.
MANY, BYTES = 1 << 20, 1 << 22

_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _QUOTE, _LEAD, _REST = range(8)


def _classes() -> np.ndarray:
    of = np.full(256, _REST, np.uint8)
    of[0x21:0x7F] = _MARK
    for first, last, kind in ((0x30, 0x39, _DIGIT), (0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0x09, 0x0D, _BLANK), (0xC3, 0xF4, _LEAD)):
        of[first : last + 1] = kind
    of[0x20], of[0x27] = _SPACE, _QUOTE
    of[0xE1:0xE4] = _REST  # some characters that these begin are white space
    return of


_CLASS = _classes()


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: sorted places in data, among them the offsets of all texts that aren't empty."""
    first, last = int(offsets[0]), int(offsets[-1])
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    found = []
    for low in range(first, last, WINDOW):
        high = min(low + WINDOW, last)
        start = max(low - 2, first)
        raw = data[start : min(high + 1, last)]
        kind = _CLASS[raw]
        visible = (kind >= _LETTER) & (kind <= _LEAD)
        next_visible = np.zeros(len(kind), bool)
        next_visible[:-1] = visible[1:]
        blank = kind == _BLANK
        at = ((kind == _SPACE) | blank) & next_visible  # the last white space before something visible
        at[1:] |= blank[:-1] & visible[1:]
        letter = kind == _LETTER
        mark = kind == _MARK
        at[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        # two bytes that are a letter from U+00C0 to U+017F, but for the signs of multiplication and division, and for
        # the one letter whose lower case ends with a mark
        two = raw[:-2].astype(np.uint16) << 8 | raw[1:-1]
        wide = (raw[:-2] >= 0xC3) & (raw[:-2] <= 0xC5) & (two != 0xC397) & (two != 0xC3B7) & (two != 0xC4B0)
        at[2:] |= wide & mark[2:]
        # white space that ends a text has nothing visible behind it
        a, b = np.searchsorted(offsets, (low, high), side="right")
        ends = offsets[a:b] - 1 - start
        at[ends[(kind[ends] == _SPACE) | (kind[ends] == _BLANK)]] = False
        a, b = np.searchsorted(begins, (low, high))
        at[begins[a:b] - start] = True
        found.append(np.flatnonzero(at[low - start : high - start]) + low)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Cache:
    """What keys became, in two generations of at most `most` bytes each, by a rough count."""

    def __init__(self, most: int):
        self.most, self.held, self.elder, self.bytes = most, {}, {}, 0

    def all(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of keys; make: from the list of those that aren't known to theirs."""
        held, elder = self.held, self.elder
        out = list(map(held.get, keys))
        if elder:
            for i, v in enumerate(out):
                if v is None and (v := elder.get(keys[i])) is not None:
                    out[i] = v
                    self.put(keys[i], v)
        new = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(new, make([keys[i] for i in new]) if new else ()):
            out[i] = v
            self.put(keys[i], v)
        return out

    def put(self, key, value) -> None:
        weight = 180 + 2 * len(key) + (len(value) if isinstance(value, bytes) else sum(map(len, value)) + 120)
        if weight > self.most >> 4:
            return
        if self.bytes + weight > self.most:
            self.elder, self.held, self.bytes = self.held, {}, 0
        self.held[key] = value
        self.bytes += weight


def _laid(texts: pa.Array) -> tuple[pa.Buffer | None, np.ndarray, list[int]]:
    """The bytes of texts, where pieces begin and the last one ends, and the first piece of each text and behind the last."""
    n = len(texts)
    texts = texts.cast(pa.string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts, pa.array([], pa.string())])
    buffer = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: n + 1]
    places = cut(np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8), offsets)
    return buffer, np.append(places, offsets[-1]).astype(np.int32), np.searchsorted(places, offsets).tolist()


def joined(texts: pa.Array, look: Callable[[list[str]], list], columns: int) -> Iterator[list[bytes]]:
    """For each text, in order, the joined values of its pieces: one bytes value for each of `columns`.

    look: from distinct pieces to their values; bytes where there is one column, else tuples.
    """
    n = len(texts)
    if not n:
        return
    buffer, bounds, first = _laid(texts)
    places = bounds[:-1]
    held: list[list[bytes]] = [[] for _ in range(columns)]  # of the text that is not complete yet
    t = 0
    for low in range(0, max(len(places), 1), SLICE):
        high = min(low + SLICE, len(places))
        values = [[] for _ in range(columns)]
        if high > low:
            part = pa.StringArray.from_buffers(high - low, pa.py_buffer(np.ascontiguousarray(bounds[low : high + 1])), buffer)
            coded = part.dictionary_encode()
            made = look(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy()
            for k in range(columns):
                of = np.empty(len(made), object)
                of[:] = made if columns == 1 else [m[k] for m in made]
                values[k] = of[at].tolist()
        while t < n:
            a, b = max(first[t], low) - low, min(first[t + 1], high) - low
            done = first[t + 1] <= high
            if b > a:
                for k in range(columns):
                    held[k].append(b"".join(values[k][a:b]))
            if not done:
                break
            yield [b"".join(h) for h in held]
            held = [[] for _ in range(columns)]
            t += 1


def spread(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of the ranges, one range behind the other."""
    n = ends - begins
    return np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Ids:
    """The ids of the pieces that were made last, in arrays of at most `most` bytes, by a rough count.

    When they would be more, the oldest go until half is left.
    """

    def __init__(self, most: int):
        self.most = most
        self.pieces, self.weight = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def all(self, pieces: pa.Array, make: Callable[[pa.Array], tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each of the distinct pieces begin, and where they end).

        make: from pieces that aren't known to (ids of all, where each piece's begin and the last one's end).
        """
        at = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy()
        begins, ends, ids = self.bounds[at], self.bounds[at + 1], self.ids
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            made, bounds = make(fresh)
            begins[new], ends[new] = bounds[:-1] + len(ids), bounds[1:] + len(ids)
            ids = np.concatenate((ids, made))
            self._put(fresh, made, bounds)
        return ids, begins, ends

    def _put(self, pieces: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        n = np.diff(bounds)
        weight = 24 + 4 * n + pc.binary_length(pieces).to_numpy().astype(np.int64)
        if weight.max() > self.most >> 4:
            kept = np.flatnonzero(weight <= self.most >> 4)
            pieces, weight, ids = pieces.take(pa.array(kept)), weight[kept], ids[spread(bounds[kept], bounds[kept + 1])]
            bounds = np.concatenate(([0], np.cumsum(n[kept])))
        all_, first = np.concatenate((self.weight, weight)), 0
        if all_.sum() > self.most:
            first = len(all_) - int(np.searchsorted(np.cumsum(all_[::-1]), self.most >> 1, side="right"))
        a, b = min(first, len(self.pieces)), max(first - len(self.pieces), 0)
        gone = self.bounds[a]
        self.pieces, self.weight = pa.concat_arrays([self.pieces.slice(a), pieces.slice(b)]), all_[first:]
        self.ids = np.concatenate((self.ids[gone:], ids[bounds[b] :]))
        self.bounds = np.concatenate((self.bounds[a:-1] - gone, bounds[b:] - bounds[b] + self.bounds[-1] - gone))


def ids_of_texts(texts: pa.Array, known: Ids, make: Callable[[pa.Array], tuple]) -> Iterator[bytes]:
    """For each text, in order, the ids of its pieces as 32-bit words. make: as `Ids.all` takes it."""
    n = len(texts)
    if not n:
        return
    buffer, bounds, first = _laid(texts)
    count, low, t, held = len(bounds) - 1, 0, 0, []  # held: of the text that is not complete yet
    while t < n:
        full = bounds.dtype.type(min(int(bounds[low]) + BYTES, int(bounds[-1])))
        high = min(max(int(np.searchsorted(bounds, full, side="right")) - 1, low + 1), low + MANY, count)
        ids, behind = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if high > low:
            part = pa.StringArray.from_buffers(high - low, pa.py_buffer(np.ascontiguousarray(bounds[low : high + 1])), buffer)
            coded = part.dictionary_encode()
            ids, begins, ends = known.all(coded.dictionary, make)
            at = coded.indices.to_numpy()
            begins, ends = begins[at], ends[at]
            ids = ids[spread(begins, ends)]
            behind = np.concatenate(([0], np.cumsum(ends - begins)))
        while t < n:
            a, b = max(first[t], low) - low, min(first[t + 1], high) - low
            if b > a:
                held.append(ids[behind[a] : behind[b]].tobytes())
            if first[t + 1] > high:
                break
            yield held[0] if len(held) == 1 else b"".join(held)
            held = []
            t += 1
        low = high
