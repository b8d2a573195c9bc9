"""Logs that grow: every cut gives the same lines, and a stream goes on over restarts."""

import random

import pytest

from palisade.sources import tails


def whole(data: bytes):
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out


DATA = [b"", b"\n", b"no end", b"a\nbb\n", b"\n\n\nx\r\n\n", "hé\n漢字\nz".encode(), b"\xff\xfe\nok\n", b"x" * 300 + b"\n" + b"y" * 5 + b"\ntail"]


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_every_cut_gives_each_line_once(tmp_path, monkeypatch, block):
    monkeypatch.setattr(tails, "BLOCK", block)
    rng = random.Random(block)
    cases = DATA + [bytes(rng.choice(b"ab\n\n\r") for _ in range(rng.randrange(80))) for _ in range(30)]
    for i, data in enumerate(cases):
        path = f"{tmp_path}/{i}"
        open(path, "wb").write(data)
        end = tails.complete(path)
        assert end == data.rfind(b"\n") + 1
        for size in (1, 2, 7, 1000):
            got = [(o, t) for r in tails.ranges(0, end, size) for b in tails.lines_of(path, r, end) for o, t in zip(b.column("offset").to_pylist(), b.column("line").to_pylist())]
            assert got == whole(data), (data, size)
    assert tails.complete(f"{tmp_path}/none") == 0


def test_table_and_restarted_stream(spark, tmp_path):
    path = f"{tmp_path}/log"

    def add(*lines):
        with open(path, "ab") as f:
            f.write("".join(lines).encode())

    def run():
        q = tails.tail(spark, path, 16).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("offset long, line string").json(f"{tmp_path}/out").collect())

    add(*(f'{{"n": {i}}}\n' for i in range(40)), '{"n": 4')
    data = open(path, "rb").read()
    assert run() == whole(data) and len(whole(data)) == 40
    add("0}\n", '{"n": 41}\n')
    data = open(path, "rb").read()
    assert run() == whole(data) == sorted(tuple(r) for r in tails.table(spark, path, 0, 16).collect())
    since = whole(data)[30][0]
    assert sorted(tuple(r) for r in tails.table(spark, path, since, 16).collect()) == whole(data)[30:]
    assert tails.table(spark, path, since, 16).rdd.getNumPartitions() < tails.table(spark, path, 0, 16).rdd.getNumPartitions()
    assert tails.table(spark, f"{tmp_path}/none").count() == 0
    open(path, "wb").write(b"new\n")
    with pytest.raises(Exception, match="had"):
        run()
