"""Line sources and sinks, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from wordlattice import streaming
from wordlattice.functions import columns as fn
from wordlattice.operators import render
from wordlattice.operators.segment import segment
from wordlattice.sources import lexicon as lx
from wordlattice.sources import lines as ls


def rows(df):
    return [(r.number, r.line, r.text, r.ending, r.had_bom) for r in df.orderBy("number").collect()]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\n\nlast\r".encode())
    (tmp_path / "b.txt").write_bytes("x\ry\n﻿z\n".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"ok \xff \xe1\x9e\n")
    got = rows(ls.read_lines(spark, [str(tmp_path / f"{n}.txt") for n in "abcd"]))
    assert got == [
        (1, 1, "one", "\r\n", True), (2, 2, "two", "\n", False), (3, 3, "", "\n", False), (4, 4, "last", "", False),
        (5, 1, "x\ry", "\n", False), (6, 2, "﻿z", "\n", False), (7, 1, "ok � �", "\n", False),
    ]
    with pytest.raises(Exception, match="INVALID_UTF8_STRING: ill-formed at byte 3"):
        ls.read_lines(spark, str(tmp_path / "d.txt"), strict=True).collect()


def test_splits_of_a_file(spark, tmp_path):
    rng = random.Random(4)
    expected, number = [], 0
    for name in ("x", "y"):
        ends = [rng.choice(["\n", "\r\n"]) for _ in range(3000)]
        texts = ["ក" * rng.randrange(40) for _ in ends]
        if name == "y":
            ends[-1], texts[-1] = "", "end"
        bom = "\ufeff" if name == "x" else ""
        (tmp_path / name).write_bytes((bom + "".join(t + e for t, e in zip(texts, ends, strict=True))).encode())
        for i, (t, e) in enumerate(zip(texts, ends, strict=True)):
            number += 1
            expected.append((number, i + 1, t, e, name == "x" and i == 0))
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "20000")
        df = ls.read_lines(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
        assert spark.read.text(str(tmp_path / "x")).rdd.getNumPartitions() > 3
        assert rows(df) == expected
    finally:
        spark.conf.set(conf, before)


def test_fault_offset(spark):
    cases = [(b"", None), ("ក\ufffd".encode(), None), ("\ufffdក".encode() + b"\xff", 6), (b"\xe1\x9e", 0), (b"ab\xc3(\xff", 2), ("\ufffd\ufffd".encode() + b"\xef\xbf!", 6)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, raw binary")
    assert [r.at for r in df.select("i", fn.fault_offset(F.col("raw")).alias("at")).orderBy("i").collect()] == [at for _, at in cases]


def test_endings_and_marks_return(spark, tmp_path):
    content = "\ufeffone\r\ntwo\n\r\nthree\n".encode()
    (tmp_path / "in.txt").write_bytes(content)
    ls.write_lines(ls.read_lines(spark, str(tmp_path / "in.txt")).coalesce(1), str(tmp_path / "back"), ending_col="ending", bom_col="had_bom")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "back").glob("part-*"))) == content


def test_write_lines_in_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "number int, text string").repartition(3)
    ls.write_lines(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).coalesce(1).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("out", ["space", "zwsp", "clusters"])
def test_stream_equals_batch(spark, tmp_path, out):
    lex = lx.from_words(spark, [("ខ្មែរ", 5), ("ភាសា", 3)])
    src = tmp_path / "in"
    src.mkdir()
    texts = ["ភាសាខ្មែរ 12", "", "ខ្មែរ hello", "ភាសា ខ្មែរ!"]
    (src / "1.txt").write_text("\n".join(texts[:2]) + "\n", encoding="utf-8")
    (src / "2.txt").write_text("\r\n".join(texts[2:]), encoding="utf-8")
    stream = streaming.segment_stream(streaming.read_stream(spark, str(src), 1), lex, out=out)
    query = stream.writeStream.format("memory").queryName(f"out_{out}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    shown = {"space": render.to_space, "zwsp": render.to_zwsp, "clusters": render.to_clusters}[out]
    batch = segment(spark.createDataFrame([(t,) for t in texts], "text string"), lex).select("text", shown(F.col("tokens")).alias("segmented"))
    assert sorted(map(tuple, spark.table(f"out_{out}").collect())) == sorted(map(tuple, batch.collect()))
