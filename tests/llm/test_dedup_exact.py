import hashlib
import random

from driftloom.llm.dedup_exact import CuckooIndex, apply_changes, drop_exact_copies, exact_dedup


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_cuckoo_index_equals_a_dict():
    r, index, plain = random.Random(1), CuckooIndex(2), {}
    for _ in range(20_000):
        k = digest(r.randrange(3000))
        if r.random() < 0.6:
            plain[k] = r.random()
            index.put(k, plain[k])
        else:
            assert index.delete(k) == (plain.pop(k, None) is not None)
    assert dict(index.items()) == plain and index.size == len(plain)
    assert all(index.find(digest(k)) == plain.get(digest(k)) for k in range(4000))
    assert index.buckets >= 256  # it has resized


def test_rows_that_stay(spark):
    rows = [(1, "a b"), (2, "a  b\n"), (3, "ab"), (4, "a\x0b\x0cb\t"), (5, None), (6, ""), (7, " "), (8, "a b"), (9, "x" * 300_000), (10, "x" * 300_000), (10, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "y", 0) for i, t in rows], "doc_id long, text string, _sha string, _id int").repartition(4)
    got = {(r.doc_id): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got == {1: (2, 4, False), 2: (2, 4, True), 3: (2, 4, False), 4: (2, 4, False), 5: (7, 3, False), 6: (7, 3, False), 7: (7, 3, True), 8: (8, 1, True), 9: (9, 3, True), 10: (9, 3, False)}
    assert sorted(r.doc_id for r in drop_exact_copies(df).collect()) == [2, 7, 8, 9]
    assert drop_exact_copies(df).columns == df.columns
    assert exact_dedup(df.limit(0)).count() == 0
    assert [r.doc_id for r in drop_exact_copies(df.where("doc_id = 10")).collect()] == [10]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "t"), (5, "t"), (None, "u")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()}
    assert got == {(None, 5, False), (5, 5, True), (None, None, True)}


def test_live_index_takes_inserts_and_deletes(spark):
    shape = "_sha binary, _doc long, _op string"
    row = lambda k, doc, op: (bytearray(digest(k)), doc, op)
    index = apply_changes(None, spark.createDataFrame([row(k, k, "insert") for k in range(300)] + [row(1, -1, "insert")], shape), 3)
    index = apply_changes(index, spark.createDataFrame([row(k, 0, "delete") for k in range(0, 300, 2)] + [row(2, 7, "insert"), row(999, 0, "delete")], shape), 3)
    got = {bytes(r._sha): r._doc for r in index.collect()}
    assert got == {**{digest(k): k if k != 1 else -1 for k in range(1, 300, 2)}, digest(2): 7}
