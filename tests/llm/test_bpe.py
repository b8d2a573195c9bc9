import hashlib
import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palisade.llm.bpe import Automaton, Codec, bpe
from tests.llm.common import TEXTS, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_edges_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    fields = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    rows = bpe(documents(spark), PATH, fields=fields).collect()
    got = sorted((str(r.doc_id), r.decoded, list(r.ids), r.n_tokens) for r in rows)
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), t or "", ids, len(ids)))
    assert got == sorted(want)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe(empty(spark), PATH).count() == 0


def test_random_texts_equal_the_library():
    library, codec, rng = Tokenizer.from_file(PATH), Codec(PATH), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("ab the  \n\té1²'sl<|>%$  \xa0日𐍈") for _ in range(rng.randint(0, 50)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_small_caches_change_nothing():
    text = "some words, some other words; and words again " * 50
    assert Codec(PATH, most=4_000).encode(text) == Codec(PATH).encode(text)


def test_one_path_spells_each_prefix():
    """Brute force over all segmentations of short strings: the automaton accepts exactly the merged one."""
    merges = [["a", "b"], ["ab", "a"], ["a", "a"], ["b", "b"], ["aa", "aa"]]
    vocab = {t: i for i, t in enumerate(["a", "b", "ab", "aba", "aa", "bb", "aaaa"])}
    machine = Automaton.of(vocab, merges)

    def merged(word):
        parts = list(word)
        for x, y in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    words = [""]
    for _ in range(9):
        words = [w + c for w in words for c in "ab"]
        for w in words:
            assert machine.encode(w) == merged(w), w
        assert list(machine.tokens([[w.encode() for w in words]])) == [[i for w in words for i in merged(w)]]


def test_cuts_and_blocks_change_nothing():
    """Pieces of an Arrow batch give what the library gives, whatever surrounds the cuts and however texts are grouped."""
    library, codec, rng = Tokenizer.from_file(PATH), Codec(PATH, most=50_000), random.Random(5)
    texts = ["".join(rng.choice("ab 'sL  \n\t\r\x0b\x1c\x85\xa0ÀÉé×÷ſ1²,.-<|> 日𐍈\u0300\u2003") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", "a" * 70_000 + " " * 3000 + "é" * 4000, "\n", " ", "x \n", "x \n y <|endoftext|>\n <|endoftext|>"]
    rows = pa.array([None, *texts, None], pa.string())
    for array in (rows, rows.cast(pa.large_string()), rows.slice(1)):
        got = list(codec.parts(array))
        assert len(got) == len(array)
        for text, (ids, emitted) in zip(array.to_pylist(), got):
            assert [int(i) for i in ids.split(b",")[:-1]] == library.encode(text or "", add_special_tokens=False).ids
            assert emitted == (text or "").encode()
