import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.functions import contents, digests, paths


def normalised(data: bytes) -> list[bytes]:
    data = data.replace(b"\r\n", b"\n")
    if not data:
        return []
    return (data[:-1] if data.endswith(b"\n") else data).split(b"\n")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"\n", b"\r", b"\r\n", b"\xff\xfe", b" ", b""]), max_size=12).map(b"".join), min_size=1, max_size=30))
def test_lines_of_any_bytes(spark, cases):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: [bytes(x) for x in r.b] for r in df.select("i", F.transform(contents.lines(contents.text_of(F.col("content"))), contents.bytes_of).alias("b")).collect()}
    assert got == {i: normalised(c) for i, c in enumerate(cases)}


def frame(b: bytes) -> bytes:
    return len(b).to_bytes(8, "big") + b


def test_digests_equal_plain_python(spark):
    df = spark.createDataFrame([(["one", "", "three"], "{}", None), ([], "x", "y")], "lines array<string>, canonical string, more string")
    got = df.select(digests.lines_digest(F.col("lines")).alias("a"), digests.entry_digest(F.col("canonical")).alias("b"), digests.digest(digests.optional(F.col("more"))).alias("c")).collect()
    for r, (lines, canonical, more) in zip(got, [(["one", "", "three"], "{}", None), ([], "x", "y")], strict=True):
        body = frame(b"driftloom:v2:code") + frame(b"exact_lines_v1") + frame(len(lines).to_bytes(8, "big")) + b"".join(frame(x.encode()) for x in lines)
        assert r.a == hashlib.sha256(body).hexdigest()
        assert r.b == hashlib.sha256(frame(b"driftloom:v2:entry") + frame(canonical.encode())).hexdigest()
        assert r.c == hashlib.sha256(frame(b"\0") if more is None else frame(b"\1") + frame(more.encode())).hexdigest()


def test_paths_and_ids(spark):
    cases = {"a/b.rs": True, "": False, "/a": False, "a//b": False, "a/../b": False, ".": False, "a\\b": False, "c:/x": False, "a\0b": False, "ü/x": True}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    assert {r.p: r.v for r in df.select("p", paths.valid(F.col("p")).alias("v")).collect()} == {**cases, None: False}
    odd = {"con/x": False, "a.": False, "a b": True, "lpt1.txt": False, "x/a?": False, "ok/y.rs": True}
    df = spark.createDataFrame([(k,) for k in odd], "p string")
    assert {r.p: r.v for r in df.select("p", paths.portable(F.col("p")).alias("v")).collect()} == odd
    names = {"": "empty", " a": "surrounding_whitespace", "a" * 257: "too_long", "a\x07b": "control_character", "fine": None}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    assert {r.p: r.v for r in df.select("p", paths.id_fault(F.col("p")).alias("v")).collect()} == names
    one = spark.range(1).select(paths.item_id(F.lit("m"), F.array(F.lit("a"), F.lit("bü")), F.lit("function"), F.lit("f"), F.lit(2)).alias("x")).first().x
    assert one == "rust:v2:crate:1:m:modules:2:1:a:3:bü:kind:8:function:name:1:f:occurrence:1:2"
