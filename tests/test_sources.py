import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from driftloom.plans.check import Refused, check_signatures, check_sketches, contract_violations, inventory_of
from driftloom.sources import catalogs, documents, snapshots, trees
from driftloom.streaming import checks

CONTRACT = """contract_version: 2
root: src
files: [lib.rs, gone.rs]
signatures:
- f_function: {sketch: one, type: fn, file: lib.rs}
- g_function: {sketch: two, type: fn, file: lib.rs}
- h_function: {sketch: three, type: fn, file: gone.rs}
sketches:
- a: {id: one, file: lib.rs, linked_signature: f_function, signature_type: fn, occurrence: exactly_one, code: "needle\\n"}
- b: {id: two, file: lib.rs, linked_signature: g_function, signature_type: fn, code: "absent"}
- c: {id: three, file: gone.rs, linked_signature: h_function, signature_type: fn, code: "x"}
---
contract_version: 2
root: yes
files: []
"""


@pytest.fixture
def tree(tmp_path):
    for name, data in {"src/lib.rs": b"a\nneedle\r\nneedle\n\xff", "src/deep/x.RS": b"fn x() {}", "src/skip.txt": b"no", "contracts/main.yml": CONTRACT.encode(), "contracts/sub/other.yml": b"x", "contracts/.driftloom/state": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan_and_check(spark, tree):
    sources = trees.scan(spark, f"{tree}/src")
    assert {r.path for r in sources.collect()} == {"lib.rs", "deep/x.RS"}
    contracts = trees.contract_files(spark, f"{tree}/contracts")
    assert {r.path for r in contracts.collect()} == {"main.yml", "sub/other.yml"}
    problems, report = check_sketches(sources, contracts)
    assert {r.snippet_id: r.kind for r in problems.collect()} == {"one": "occurrence_mismatch", "two": "not_matched", "three": "missing_file"}
    got = json.loads(report.first().report)
    assert got["passed"] is False and got["counts"]["snippets"] == 3 and got["counts"]["present_paths"] == 1 and len(got["diagnostics"]) == 3
    parsed = documents.documents(contracts)
    assert {r.document_index: r.root for r in parsed.collect()} == {0: "src", 1: "yes"}
    assert contract_violations(parsed).count() == 0
    broken = contracts.where("path = 'main.yml'").withColumn("content", F.concat("content", F.lit(b"---\na: 1\na: 2\n")))
    with pytest.raises(Refused) as refused:
        check_sketches(sources, broken)
    assert [r.code for r in refused.value.violations.collect()] == ["duplicate_key"]
    wanted = spark.createDataFrame([("lib.rs",), ("none.rs",)], "path string")
    assert {r.path: r.content is None for r in trees.selected(sources, wanted).collect()} == {"lib.rs": False, "none.rs": True}


@pytest.mark.parametrize(("text", "fault"), [("a: 1\na: 2\n", "duplicate_key"), ("a: &x 1\nb: *x\n", "alias"), ("base: {}\n<<: {a: 1}\n", "merge_key"), ("", "empty_document"), ("contract_version: 2\nother: 1\n", "unknown_field"), ("contract_version: 1\n", "version"), ("a: [", "syntax"), ("contract_version: 2\nsketches:\n- {a: {}, b: {}}\n", "one_entry_map"), ("[" * 200 + "]" * 200, "quota"), ("---\na: 1\n" * 1100, "quota")])
def test_strict_yaml(text, fault):
    assert documents.parse(text.encode())[-1]["fault"] == fault


def test_snapshots(spark, tmp_path):
    files = spark.createDataFrame([("b.yml", bytearray(b"\xff\0")), ("a.yml", bytearray(b""))], "path string, content binary")
    one = snapshots.encode(files)
    assert one == snapshots.encode(files.repartition(3))
    held = spark.createDataFrame([("x.gz", bytearray(one)), ("bad.gz", bytearray(b"no"))], "path string, content binary")
    got = {(r.archive, r.path): (bytes(r.content) if r.content is not None else None, r.fault) for r in snapshots.decode(held).collect()}
    assert got == {("x.gz", "a.yml"): (b"", None), ("x.gz", "b.yml"): (b"\xff\0", None), ("bad.gz", None): (None, "damaged")}
    assert json.loads(gzip.decompress(one)) == {"version": 1, "contract_files": [{"path": {"value": "a.yml"}, "bytes": []}, {"path": {"value": "b.yml"}, "bytes": [255, 0]}]}
    pack = lambda v: gzip.compress(json.dumps(v).encode())
    bad = {"trail": one + b"x", "cut": one[:-4], "old": pack({"version": 2, "contract_files": []}), "shape": pack([1]), "byte": pack({"version": 1, "contract_files": [{"path": {"value": "a"}, "bytes": [256]}]}), "bomb": gzip.compress(b" " * (snapshots.EXPANDED + 1)), "path": pack({"version": 1, "contract_files": [{"path": {"value": "../a"}, "bytes": []}]})}
    faults = {r.archive: r.fault for r in snapshots.decode(spark.createDataFrame([(n, bytearray(d)) for n, d in bad.items()], "path string, content binary")).collect()}
    assert faults == {"trail": "trailing_data", "cut": "damaged", "old": "version", "shape": "damaged", "byte": "damaged", "bomb": "too_large", "path": "path"}
    snapshots.write(files, f"{tmp_path}/s")
    assert snapshots.read(spark, f"{tmp_path}/s").count() == 2
    with pytest.raises(Exception, match="exist"):
        snapshots.write(files, f"{tmp_path}/s")


def test_signatures_of_sources(spark, tree):
    sources = trees.scan(spark, f"{tree}/src").where("path = 'deep/x.RS'")
    now = inventory_of(sources)
    assert check_signatures(now, sources).count() == 0
    other = spark.createDataFrame([("deep/x.RS", bytearray(b"pub fn x() {}\nfn y() {}"))], "path string, content binary")
    assert sorted(r.kind for r in check_signatures(now, other).collect()) == ["extra", "mismatched"]


def test_stream_of_files(spark, tree):
    stream = spark.readStream.schema(checks.FILES).format("binaryFile").load(f"{tree}/src").select(F.substring_index("path", "/", -1).alias("path"), "modificationTime", "content")
    snippets = spark.createDataFrame([("one", "lib.rs", "exactly_one", ["needle"]), ("two", "lib.rs", "at_least_one", ["needle"])], "snippet_id string, path string, occurrence string, code array<string>")
    q = checks.start(stream, snippets, f"{tree}/out", f"{tree}/state", delay="1 hour")
    q.awaitTermination(60)
    assert {r.snippet_id: (r.kind, r.hits) for r in spark.read.parquet(f"{tree}/out").collect()} == {"one": ("occurrence_mismatch", 2), "two": ("satisfied", 2)}


def test_catalogs_and_manifests(spark, tmp_path):
    from driftloom.sources import catalogs

    texts = [("map", '{"a.rs": "x", "b.rs": "y", "a.rs": "z"}'), ("list", '[{"path": "a.rs", "content": "x"}, {"path": "../b", "content": ""}]'), ("bad", "{"), ("none", None), ("empty", "{}"), ("shape", '{"a": 1}')]
    got = {(r.name, r.path, r.content): r.fault for r in catalogs.json_catalog(spark.createDataFrame(texts, "name string, text string")).collect()}
    assert got == {("map", "a.rs", "x"): "duplicate_path", ("map", "b.rs", "y"): None, ("map", "a.rs", "z"): "duplicate_path", ("list", "a.rs", "x"): None, ("list", "../b", ""): "invalid_path", ("bad", None, None): "syntax", ("none", None, None): "syntax", ("shape", None, None): "syntax"}
    own = lambda paths, version=3, state="committed", generation=1: json.dumps({"version": version, "journal": {"state": state, "generation": generation, "files": {"documents": [{"path": p, "sha256": "d"} for p in paths]}}})
    cases = {"good": (own(["a", "b"]), None), "none": (own([]), None), "old": (own(["a"], 2), "version"), "busy": (own(["a"], state="updating"), "updating"), "zero": (own(["a"], generation=0), "generation"), "twice": (own(["a", "a"]), "duplicate_path"), "order": (own(["b", "a"]), "unsorted"), "path": (own(["/a"]), "invalid_path"), "junk": ("[", "syntax")}
    rows = catalogs.ownership(spark.createDataFrame([(n, t) for n, (t, _) in cases.items()], "name string, text string")).collect()
    assert {r.name: r.fault for r in rows} == {n: f for n, (_, f) in cases.items()} and sorted(r.path for r in rows if r.name == "good") == ["a", "b"]
    assert catalogs.optional_contracts(spark, f"{tmp_path}/absent").count() == 0


def test_reports(spark):
    from driftloom.sources import reports

    one = lambda passed: spark.createDataFrame([(f'{{"passed":{passed}}}',)], "report string")
    assert json.loads(reports.combined_report(one("true"), one("false")).first().report) == {"passed": False, "signatures": {"passed": True}, "sketches": {"passed": False}}
    counts = spark.createDataFrame([(2, 3)], "expected_groups long, actual_groups long")
    diagnostics = spark.createDataFrame([(1, "w", "warning", None, None), (0, "b", "extra", None, "d"), (0, "a", "missing", "d", None)], "section int, key string, kind string, expected_shape string, actual_shape string")
    shape = spark.createDataFrame([(1, "s")], "groups long, shape_digest string")
    got = json.loads(reports.signature_report(counts, spark.createDataFrame([(False,)], "passed boolean"), diagnostics, shape).first().report)
    assert list(got) == ["passed", "source_shape_digest", "digest_version", "counts", "diagnostics"] and [d["key"] for d in got["diagnostics"]] == ["a", "b", "w"]
    with pytest.raises(Exception, match="too many diagnostics"):
        reports.listed(diagnostics, most=2).collect()
    assert (reports.format_of("x/R.YML"), reports.format_of("a.json")) == ("yaml", "json")
    with pytest.raises(ValueError):
        reports.format_of("a.txt")


def test_changed_members_are_mismatched(spark):
    old, new = b"impl P { pub fn f(a: u8) -> u8 { a } }", b"impl P { pub fn f(a: u16) -> u8 { 0 } }"
    files = lambda t: spark.createDataFrame([("lib.rs", bytearray(t))], "path string, content binary")
    assert [r.kind for r in check_signatures(inventory_of(files(old)), files(new)).collect()] == ["mismatched"]
    assert check_signatures(inventory_of(files(old)), files(old.replace(b"{ a }", b"{ 1 }"))).count() == 0
    with pytest.raises(Refused):
        inventory_of(files(b"impl P {"))


def test_documents_are_strict(spark):
    good = b"contract_version: 2\nroot: src\nfiles: [a.rs]\nsignatures:\n- f: {sketch: s, type: fn, file: a.rs, owned: {x: 1}}\nsketches:\n- f: {id: s, file: a.rs, code: x}\n"
    cases = {
        "good": (good, None),
        "files": (good.replace(b"[a.rs]", b"abc"), "shape"),
        "number": (good.replace(b"[a.rs]", b"[1]"), "shape"),
        "version": (good.replace(b": 2", b": 2.0"), "shape"),
        "occurrence": (good.replace(b"code: x", b"code: x, occurrence: many"), "shape"),
        "code": (good.replace(b"code: x", b"code: [x]"), "shape"),
        "root": (good.replace(b"root: src", b"root: {a: b}"), "shape"),
        "body": (good.replace(b"{id: s, file: a.rs, code: x}", b"text"), "shape"),
        "key": (good + b"? [a, b]\n: c\n", "shape"),
        "deep": (b"[" * 5000 + b"]" * 5000, "quota"),
    }
    rows = documents.documents(spark.createDataFrame([(f"{n}.yml", bytearray(d)) for n, (d, _) in cases.items()], "path string, content binary")).collect()
    assert {r.contract_file[:-4]: r.fault for r in rows} == {n: f for n, (_, f) in cases.items()}


def test_deep_json_and_repeated_paths_are_faults(spark):
    deep = "[" * 200_000
    assert [r.fault for r in catalogs.json_catalog(spark.createDataFrame([("a", deep)], "name string, text string")).collect()] == ["syntax"]
    file = {"path": {"value": "a.rs"}, "bytes": [1]}
    twice = json.dumps({"version": snapshots.VERSION, "contract_files": [file, file]}).encode()
    bad = {"deep": deep.encode(), "twice": twice}
    rows = snapshots.decode(spark.createDataFrame([(n, bytearray(gzip.compress(d))) for n, d in bad.items()], "path string, content binary")).collect()
    assert {r.archive: r.fault for r in rows} == {"deep": "damaged", "twice": "duplicate_path"}


def test_indexed_inventories_are_compared_by_changed_buckets(spark, tmp_path):
    from driftloom.sources import indexed

    old = {f"e{k}": f"d{k % 7}" for k in range(3000)}
    new = {**{k: d for k, d in old.items() if k != "e5"}, "e77": "other", "new": "d1"}
    side = lambda x, name, **more: indexed.write(spark.createDataFrame(list(x.items()), "entry_id string, digest string"), f"{tmp_path}/{name}", **more)
    side(old, "old")
    side(new, "new")
    side({}, "none")
    changed = indexed.changed_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert 1 <= len(changed) <= 3 and all(len(b) == 3 for b in changed)
    found = indexed.differences(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert {tuple(r) for r in found.collect()} == {("e5", "missing", "d5", None), ("e77", "mismatched", "d0", "other"), ("new", "extra", None, "d1")}
    assert len(set(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(b", found._jdf.queryExecution().executedPlan().toString()))) == 2  # both sides
    assert indexed.changed_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/old") == [] and indexed.differences(spark, f"{tmp_path}/old", f"{tmp_path}/old").count() == 0
    assert indexed.differences(spark, f"{tmp_path}/none", f"{tmp_path}/new").where("kind = 'extra'").count() == len(new)
    for rows in ([("a", "x"), ("a", "y")], [(None, "x")], [("a", None)]):
        with pytest.raises(ValueError):
            indexed.write(spark.createDataFrame(rows, "entry_id string, digest string"), f"{tmp_path}/bad{len(rows)}{rows[0]}")
    side(old, "fine", bucket=1)
    with pytest.raises(ValueError):
        indexed.changed_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/fine")
