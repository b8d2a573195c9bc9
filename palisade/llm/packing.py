"""Hierarchical multi-length packing.

Documents are tokenised, and each is routed to the context-size tier that its remainder (after full windows of the
largest tier) just fits. From the longest tier down, every remainder opens a window of its tier; the gap is filled with
the largest remainders of shorter tiers that fit whole, and the last gap with a cut of the next one. Windows that no
shorter document is left to fill fall apart into the tiers below; what is smaller than the smallest tier at the very end
of a task is cut at powers of two. So sequences have a tier's length, and next to nothing is padded.

Each task packs the rows of its own partition, in buffers of bounded size; texts aren't shuffled, and no other task's
loss matters. Windows of one tier are dealt to step groups of equal token counts, so a training step has one length; the
groups are numbered over all tasks, by prefix sums of each task's windows.

Defined cases: null and empty texts are a document of the end token alone; a text of any length is cut into windows;
repeated rows are documents of their own; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.bpe import LONG, TOGETHER, Automaton
from palisade.llm.common import cut, ship
from palisade.llm.pieces import Ids, ids_of_texts, spread

TIERS = (2048, 1024, 512, 256)
#: Tokens that a packing buffer holds at least before it is packed, and windows' tokens in a step group.
BUFFER, STEP = 2_000_000, 16 * 2048
#: A piece of one word at most, of letters that are composed already and lower-case one by one, each to one character.
_ONE_WORD = "^[\t-\r ]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+[\t-\r ]*$"


class WordIds:
    """Token ids of whole texts by a vocabulary file whose words can't cross white space.

    Texts are cut into pieces a batch at a time (`pieces`). A piece of Latin letters and marks is lower-cased, split by
    the file's own pattern and walked through the automaton of the file's merges; any other is encoded by the
    tokenizers library. Pieces of one word, nearly all of them, are told and lower-cased as an array. A text that holds
    a control string, or an information separator (white space to some), is given to the library whole.
    """

    def __init__(self, path: str, most: int = 24 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "[\x1c-\x1f]" + "".join("|" + re.escape(s).replace("/", "\\/") for s in special)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(split["pattern"]["Regex"]).findall if split.get("invert") and split["behavior"] == "Removed" else None
        model = spec["model"]
        self.closed = bool(model["end_of_word_suffix"])
        self.automaton = Automaton.of(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.known = Ids(most)

    def _encode(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, piece: str) -> list[bytes] | None:
        """The words of a piece; None if the library has to look at it.

        Letters and marks below U+0250 are composed already and lower-case one by one, all but one to one character.
        """
        if not self.split or "<" in piece or not piece.isascii() and (max(piece) >= "\u0250" or "\u0130" in piece):
            return None
        low = piece.strip().lower()
        return [low.encode()] if low.isalpha() else [w.encode() for w in self.split(low)]

    def _made(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's begin and the last one's end)."""
        short = pc.less_equal(pc.binary_length(pieces), LONG)  # lower case has as many bytes
        one = pc.and_(pc.match_substring_regex(pieces, _ONE_WORD), short).to_numpy(zero_copy_only=False) & bool(self.split)
        single, other = np.flatnonzero(one), np.flatnonzero(~one)
        ids, n, order = [], np.zeros(len(pieces), np.int64), np.concatenate((single, other))
        words = pc.utf8_lower(pc.ascii_trim(pieces.take(pa.array(single)), " \t\n\x0b\x0c\r")).cast(pa.binary())
        for low in range(0, len(words), TOGETHER):
            of, bounds = self.automaton.encode_all(words[low : low + TOGETHER].to_pylist(), self.closed)
            ids.append(of.astype(np.uint32))
            n[single[low : low + TOGETHER]] = np.diff(bounds)
        texts = pieces.take(pa.array(other)).to_pylist()
        split = list(map(self._words, texts))
        tokens = self.automaton.tokens([ws or [] for ws in split], self.closed)
        rest = [self._encode(p) if ws is None else array("I", of).tobytes() for p, ws, of in zip(texts, split, tokens)]
        ids.append(np.frombuffer(b"".join(rest), np.uint32))
        n[other] = np.fromiter(map(len, rest), np.int64, len(rest)) >> 2
        # the ids lie in the order of `order`; bring them into that of the pieces
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids)[spread(begins, begins + n)], np.concatenate(([0], np.cumsum(n)))

    def all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array, as 32-bit words."""
        held = pc.match_substring_regex(texts, self.odd).fill_null(False)
        odd = set(np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist())
        plain = pc.if_else(held, pa.scalar("", texts.type), texts) if odd else texts
        for i, ids in enumerate(ids_of_texts(plain, self.known, self._made)):
            yield self._encode(texts[i].as_py()) if i in odd else ids

    def __call__(self, text: str) -> bytes:
        return next(self.all(pa.array([text], pa.string())))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS.clear()
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


class Packer:
    """Packs documents, given one after another as (name, length); pieces come out as (name, start, length, sequence, offset, tier)."""

    def __init__(self, tiers: tuple = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.top, self.sequence, self.pieces = self.tiers[0], 0, []
        self.rest: list[tuple[int, int, int]] = []  # (length, name, start), by length
        self.held = 0

    def add(self, name: int, length: int) -> None:
        full = length // self.top
        for k in range(full):
            self._emit([(name, k * self.top, self.top)], self.top)
        if length % self.top:
            insort(self.rest, (length % self.top, name, full * self.top))
        self.held += length

    def _emit(self, window: list, tier: int) -> None:
        at = 0
        for name, start, length in window:
            self.pieces.append((name, start, length, self.sequence, at, tier))
            at += length
        self.sequence += 1

    def _fill(self, window: list, gap: int) -> int:
        """Fill the gap with whole remainders, the largest first, and then with a cut of the smallest that is left."""
        rest = self.rest
        while gap and rest:
            i = bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if i >= 0:
                length, name, start = rest.pop(i)
                window.append((name, start, length))
                gap -= length
            else:
                length, name, start = rest.pop(0)
                window.append((name, start, gap))
                insort(rest, (length - gap, name, start + gap))
                gap = 0
        return gap

    def pack(self, last: bool) -> list[tuple]:
        """Pack what is held. Unless it is the last call, windows that can't be filled wait for the next one."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.rest and self.rest[-1][0] > below:
                length, name, start = self.rest.pop()
                window = [(name, start, length)]
                gap = self._fill(window, tier - length)
                if not gap:
                    self._emit(window, tier)
                elif last:
                    self._break(window, below)
                else:
                    for name, start, length in window:
                        insort(self.rest, (length, name, start))
                    break
            else:
                continue
            break
        self.held = sum(x[0] for x in self.rest)
        out, self.pieces = self.pieces, []
        return out

    def _break(self, window: list, below: int) -> None:
        """Deal a window that can't be filled over shorter tiers, and below the shortest over powers of two."""
        total, tier = sum(x[2] for x in window), below
        while total:
            size = tier if tier and total >= tier else 0
            if not size and tier:
                tier = next((t for t in self.tiers if t < tier), 0)
                continue
            size = size or 1 << (total.bit_length() - 1)
            part, room = [], size
            while room:
                name, start, length = window.pop(0)
                take = min(length, room)
                part.append((name, start, take))
                room -= take
                if take < length:
                    window.insert(0, (name, start + take, length - take))
            self._emit(part, size)
            total -= size


_PIECES = (
    "__id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, place long"
)


def pack(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple = TIERS, end: int = 1) -> DataFrame:
    """One row a piece of a document: where it lies in the document and in its sequence.

    path: of a vocabulary file that every executor can read; end: the id that closes a document. sequence_id: unique
    over all tasks. tier: its sequence's length; step_group: sequences that one step takes together. Groups are counted
    over all tasks, so that a tier has one incomplete group at most.
    """
    ship(documents.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, ids_of = TaskContext.get().partitionId(), word_ids(path)
        base, packer, held, count = task << 32, Packer(tiers), {}, 0
        closing = np.array([end], "<u4").tobytes()
        places: dict[int, int] = {}
        ids_left: dict[int, int] = {}

        def rows(last: bool):
            out = []
            for name, start, length, sequence, offset, tier in packer.pack(last):
                doc, ids = held[name]
                if not offset:
                    places[tier] = places.get(tier, -1) + 1
                out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + sequence, offset, tier, task, places[tier]))
                ids_left[name] -= length
                if not ids_left[name]:
                    del held[name], ids_left[name]
            table = list(zip(*out)) if out else [[]] * 10
            kinds = [*[pa.int64()] * 7, pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([*map(pa.array, table, kinds)], names=[f.split()[0] for f in _PIECES.split(", ")])

        for got in batches:
            for doc, ids in zip(got.column(0).to_pylist(), ids_of.all(got.column(1))):
                ids += closing
                held[count] = (doc, ids)
                ids_left[count] = len(ids) // 4
                packer.add(count, len(ids) // 4)
                count += 1
                if packer.held >= BUFFER:
                    yield rows(False)
        yield rows(True)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    read = documents.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    pieces = cut(read.mapInArrow(run, _PIECES))  # a row a piece: numbers only
    # a row a task and tier: the only side that is broadcast
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        pieces.groupBy(F.col("tier").alias("tier"), F.col("task").alias("task")).agg((F.max("place") + 1).alias("n"))
        .select(F.col("tier").alias("tier0"), F.col("task").alias("task0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    group = F.col("tier").cast("long") * (1 << 40) + F.floor((F.col("first") + F.col("place")) / F.greatest(F.lit(1), F.floor(F.lit(STEP) / F.col("tier"))))
    return (
        pieces.join(F.broadcast(totals), (F.col("tier") == F.col("tier0")) & (F.col("task") == F.col("task0")))
        .withColumn("step_group", group.cast("long")).withColumnRenamed("__id", id_col).drop("tier0", "task0", "first", "task", "place")
    )
