import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palisade.llm import pieces
from palisade.llm.packing import Packer, WordIds, pack
from tests.llm.common import TEXTS, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    library = Tokenizer.from_file(PATH)
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert total == sum(map(len, ids)) and padded <= 0.01 * total
    return ids


def test_pieces_cover_each_document_once(spark):
    rows = pack(documents(spark), PATH).collect()
    ids = check(rows, [t for _, t in TEXTS])
    got, want = defaultdict(int), defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    for (i, _), x in zip(TEXTS, ids):
        want[i] += len(x)
        for r in rows:
            if r.doc_id == i and i in (1, 6, 8):
                assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    assert got == want
    assert pack(empty(spark), PATH).count() == 0


def test_packer_fills_windows():
    rng, packer, pieces, sizes = random.Random(2), Packer(), [], {}
    for i in range(5000):
        sizes[i] = rng.choice([1, 3, 50, 200, 700, 1500, 2048, 5000])
        packer.add(i, sizes[i])
        if packer.held > 200_000:
            pieces += packer.pack(False)
    pieces += packer.pack(True)
    seen, windows = defaultdict(list), defaultdict(int)
    for name, start, length, sequence, offset, tier in pieces:
        seen[name].append((start, length))
        assert offset == windows[sequence]
        windows[sequence] += length
        assert windows[sequence] <= tier
    for i, n in sizes.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n
    assert all(n & (n - 1) == 0 for n in windows.values())


def test_step_groups_are_counted_over_all_tasks(spark):
    rows = documents(spark, [(i, "some words of a text " * (i % 900)) for i in range(400)], clashing=False).repartition(7)
    got = pack(rows, PATH).collect()
    windows = {(r.tier, r.step_group, r.sequence_id) for r in got}
    sizes = defaultdict(int)
    for tier, group, _ in windows:
        sizes[tier, group] += 1
    for tier in {t for t, _, _ in windows}:
        size = max(1, 16 * 2048 // tier)
        of = sorted(n for (t, _), n in sizes.items() if t == tier)
        assert of[-1] <= size and sum(n < size for n in of) <= 1


def test_word_ids_equal_the_library():
    words, rng = WordIds(PATH, most=20_000), random.Random(4)
    for _ in range(800):
        text = "".join(rng.choice("ab The  \n\tÉé1²'sL<|>%  \xa0日\x1ćΣςİ×,.") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(words(text), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids
    vocabulary = [t.removesuffix("</w>") for t in words.library.get_vocab()]
    for text, ids in zip(vocabulary, words.all(pa.array(vocabulary))):
        assert np.frombuffer(ids, "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_350_000_words_are_encoded_once():
    words, rng, encoded = WordIds(PATH), random.Random(5), []
    distinct = set()
    while len(distinct) < 350_000:
        distinct.add("".join(rng.choices("abcdefghiéü", k=9)))
    distinct = sorted(distinct)
    encode = words.automaton.encode_all
    words.automaton.encode_all = lambda some, closed=False: encoded.extend(some) or encode(some, closed)
    texts = pa.array([" ".join(distinct[i : i + 500]) for i in range(0, len(distinct), 500)])
    first = list(words.all(texts))
    assert list(words.all(texts)) == first
    assert sorted(w.decode() for w in encoded) == distinct


def test_ids_of_a_batch_equal_the_library_in_parts_of_any_size(monkeypatch):
    rng, library = random.Random(6), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x41, 0x250)]
    texts = [None, "", *letters, *(f"\t{c}a \n" for c in letters), "Aé" * 30, "b" * 47, "c" * 48, "d" * 49, " \x85a", "\xa0É\xa0", "日本" * 300, "x\x1dy"]
    texts += ["".join(rng.choices("abÉŸſ \t\n\r.'1", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", " "]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size, most in ((16, 400), (4_000, 0), (1 << 20, 1 << 20)):
        monkeypatch.setattr(pieces, "BYTES", size)
        monkeypatch.setattr(pieces, "MANY", max(1, size // 4))
        words = WordIds(PATH, most)
        for first in (0, 1):
            got = words.all(pa.array(texts).slice(first))
            assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want[first:]
            assert words.known.weight.sum() <= most and len(words.known.bounds) == len(words.known.pieces) + 1
