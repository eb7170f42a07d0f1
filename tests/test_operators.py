import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions import digests
from driftloom.operators import constraints, exports, generate, graph, inventory, items, links, matching, passages, positions, reconcile, signatures, snippets, violations
from driftloom.sources.stages import staged


def test_windows_both_ways_equal_plain_python(spark):
    r = random.Random(4)
    sources = [(f"f{i}", [r.choice("ab ") for _ in range(r.randrange(0, 12))]) for i in range(30)] + [("null", None)]
    cut = [(k, r.choice([s[0] for s in sources] + ["gone"]), r.choice(["exactly_one", "at_least_one"]), [r.choice("ab ") for _ in range(r.randrange(0, 4))]) for k in range(200)]
    s = spark.createDataFrame(sources, "path string, lines array<string>")
    k = spark.createDataFrame(cut, "snippet_id long, path string, occurrence string, code array<string>")
    held = {p: x for p, x in sources if x is not None}
    want = {i: [j + 1 for j in range(len(held.get(p, [])) - len(c) + 1) if c and held[p][j : j + len(c)] == c] for i, p, _, c in cut}
    got = {x.snippet_id: x for x in matching.matched(k, s).collect()}
    assert {i: x.starts for i, x in got.items()} == want
    assert {x.snippet_id: x.starts for x in matching.starts_by_first_line(s, k).collect()} == {i: v for i, v in want.items() if v}
    for i, p, occurrence, _ in cut:
        kind = "missing_file" if p not in held else "not_matched" if not want[i] else "occurrence_mismatch" if occurrence == "exactly_one" and len(want[i]) > 1 else "satisfied"
        assert got[i].kind == kind
    near = {x.snippet_id: (x.start_line, x.end_line, x.score) for x in matching.nearest(matching.matched(k, s)).collect()}
    for i, p, _, c in cut:
        if got[i].kind == "not_matched" and held[p] and c:
            scores = [sum(j + n < len(held[p]) and held[p][j + n] == c[n] for n in range(len(c))) for j in range(len(held[p]))]
            best = scores.index(max(scores))
            assert near.pop(i) == (best + 1, min(best + len(c), len(held[p])), max(scores))
    assert not near


def plain_compare(expected, actual):
    out, known = {}, {e[0]: e for e in actual}
    for i, g, d in sorted(expected):
        if g not in out and (i not in known or known[i][2] != d):
            out[g] = "missing" if i not in known else "mismatched"
    labels = {e[0]: e[1] for e in expected}
    for i, g, _ in sorted(actual):
        if i not in labels:
            out.setdefault(labels.get(g, g), "extra")
    return out


def test_inventory_compare_equals_plain_python(spark):
    r = random.Random(5)
    for _ in range(6):
        e = [(f"e{k}", f"e{r.randrange(4)}", r.choice("xy")) for k in range(10) if r.random() < 0.8]
        a = [(f"e{k}", f"e{r.randrange(12)}", r.choice("xy")) for k in range(13) if r.random() < 0.8]
        frames = [spark.createDataFrame(x, "entry_id string, group_id string, digest string").withColumn("semantic_id", F.col("entry_id")) for x in (e, a)]
        got = {x.key: x.kind for x in inventory.compared(*frames).collect()}
        assert got == plain_compare(e, a)


def test_inventory_diff_cancels_pairs_and_names_peers(spark):
    shape = "label string, shape string, contract string, extraction string, metadata string"
    before = [("a", "s1", "c1", None, "m"), ("a", "s1", "c1", None, "m"), ("b", "s2", "c2", "x", "m"), ("c", "s3", "c3", None, None)]
    after = [("a", "s1", "c1", None, "m"), ("b", "s2", "c9", "y", "m"), ("d", "s3", "c3", None, None), ("e", "s4", "c4", None, None)]
    got = {(x.label, x.change): x.categories for x in inventory.diffed(spark.createDataFrame(before, shape), spark.createDataFrame(after, shape)).collect()}
    assert got == {("a", "removed"): ["source_semantics"], ("b", "changed"): ["extraction_context"], ("c", "removed"): ["labels"], ("d", "added"): ["labels"], ("e", "added"): ["source_semantics"]}


def test_reconcile_covers_the_truth_table(spark):
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, digest string")
    before = {"1": "x", "2": "x", "3": "x", "7": "x", "8": "x", "9": "x", "10": "x"}
    disk = {"1": "z", "2": "x", "3": "x", "4": "y", "5": "z", "7": "z", "8": "x"}
    after = {"1": "y", "2": "x", "3": "y", "4": "y", "5": "y", "6": "y", "10": "y"}
    want = {"1": "error_modified", "2": "unchanged", "3": "write", "4": "adopt", "5": "error_unowned", "6": "write", "7": "error_modified", "8": "remove", "9": "nothing", "10": "write"}
    assert {r.path: r.action for r in reconcile.actions(df(before), df(disk), df(after), adopt=True).collect()} == want
    assert {r.path: r.action for r in reconcile.actions(df(before), df(disk), df(after)).collect()} == {**want, "4": "error_unowned"}


def test_walks_stop_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "parent string, child string")
    walk = graph.closure(spark.createDataFrame([("a",)], "node string"), edges)
    assert {r.path for r in walk.collect()} == {"a", "a/b", "a/b/c", "a/b/d"}
    assert [(r.parent, r.child) for r in graph.cycles(edges, walk).collect()] == [("c", "a")]


def test_snippet_diff_and_refresh(spark):
    shape = "snippet_id string, source_file string, linked_signature string, signature_type string, occurrence string, code array<string>"
    a = spark.createDataFrame([("1", "f", "l", "t", "o", ["x"]), ("2", "f", "l", "t", "o", ["x"]), ("3", "f", "l", "t", "o", ["x"])], shape)
    b = spark.createDataFrame([("1", "g", "l", "t", "o", ["y"]), ("2", "f", "l", "t", "o", ["x"]), ("4", "f", "l", "t", "o", [])], shape)
    assert {r.snippet_id: (r.change, r.fields) for r in snippets.diffed(a, b).collect()} == {"1": ("changed", "source_file,code"), "3": ("removed", ""), "4": ("added", "")}
    seeds = spark.createDataFrame([("1", ["x"]), ("3", ["new"])], "snippet_id string, code array<string>")
    assert {r.snippet_id: (r.linked, r.changed, r.code) for r in snippets.refreshed(a, seeds).collect()} == {"1": (True, False, ["x"]), "2": (False, False, ["x"]), "3": (True, True, ["new"])}
    assert [r.snippet_id for r in snippets.uncovered(a, seeds).collect()] == ["2"]
    shuffled = a.repartition(7)
    assert snippets.catalog_digest(a).first() == snippets.catalog_digest(shuffled).first()


def test_labels_are_kept_qualified_and_numbered(spark):
    rows = [("d", f"i{k}", "k", ["m"], "f", "function", k) for k in range(5)]
    new = spark.createDataFrame(rows, "document string, item_id string, crate string, modules array<string>, name string, kind string, pos int")
    old = spark.createDataFrame([("d", "i1", "mine"), ("d", "gone", "f_function")], "document string, item_id string, label string")
    got = {r.item_id: r.label for r in generate.planned_labels(new, old).collect()}
    assert got == {"i1": "mine", "i0": "k_m_f_function", "i2": "k_m_f_function_2", "i3": "k_m_f_function_3", "i4": "k_m_f_function_4"}
    assert {r.item_id: r.state for r in generate.refresh(new, old).collect()} == {"i0": "added", "i1": "kept", "i2": "added", "i3": "added", "i4": "added", "gone": "stale"}


def test_items_of_a_file(spark):
    text = b'''//! doc
use std::fmt; // "x"
pub(crate) struct P { a: u8 }
#[derive(Debug)] pub enum E { A, B(u8) }
pub fn f(x: &str) -> u8 { let s = "}"; 1 }
mod inner { pub const N: u8 = 1; fn g() {} }
mod out;
impl P { fn m(&self) {} }
'''
    df = spark.createDataFrame([("src/lib.rs", bytearray(text)), ("bad.rs", bytearray(b"fn x() {")), ("odd.rs", bytearray(b"what")), ("empty.rs", bytearray(b"")), ("b.rs", bytearray(b"\xff"))], "path string, content binary")
    found = items.declared(df)
    got = [(r.kind, r.name, r.visibility, r.modules) for r in found.where("path = 'src/lib.rs'").orderBy("pos").collect()]
    assert got == [("reexport", "std::fmt", "private", []), ("struct", "P", "pub(crate)", []), ("enum", "E", "pub", []), ("function", "f", "pub", []), ("module", "inner", "private", []), ("constant", "N", "pub", ["inner"]), ("function", "g", "private", ["inner"]), ("module", "out", "private", []), ("impl", "P", "private", []), ("associated_function", "impl P::m", "private", [])]
    assert {r.path: r.fault for r in found.where("fault IS NOT NULL").collect()} == {"bad.rs": "unbalanced brackets", "odd.rs": "unsupported at 0", "b.rs": "invalid UTF-8"}
    files = spark.createDataFrame([("src/lib.rs",), ("src/out.rs",)], "path string")
    edges, faults = items.module_files(found, files)
    assert [(r.parent, r.child) for r in edges.collect()] == [("src/lib.rs", "src/out.rs")] and faults.count() == 0


def test_constraints(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "k string, is_warning boolean")
    assert [constraints.passed(df, m).first().passed for m in ("default", "strict", "warning")] == [False, False, True]
    assert constraints.passed(df.where("is_warning"), "default").first().passed
    links = spark.createDataFrame([("x",), ("x",), ("z",)], "id string")
    targets = spark.createDataFrame([("x",), ("y",)], "id string")
    assert {r.id: r.times for r in constraints.reference_counts(targets, links, "id").collect()} == {"x": 2, "y": 0}
    assert [r.id for r in constraints.dangling(links, targets, "id").collect()] == ["z"]


def test_names_through_imports(spark):
    declared = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Z")], "module string, name string")
    imports = spark.createDataFrame([("m", "X", "a", "X"), ("n", "Y", "m", "X"), ("o", "X", "a", "X"), ("o", "X", "b", "X"), ("p", "Q", "q", "Q"), ("q", "Q", "p", "Q"), ("c", "Z", "a", "X")], "module string, name string, source string, source_name string")
    names = spark.createDataFrame([("a", "X"), ("n", "Y"), ("o", "X"), ("p", "Q"), ("z", "none"), ("c", "Z")], "module string, name string")
    got = {(r.module, r.name): (r.target, r.fault) for r in links.resolve(names, declared, imports).collect()}
    assert got == {("a", "X"): ("a::X", None), ("n", "Y"): ("a::X", None), ("o", "X"): (None, "ambiguous"), ("p", "Q"): (None, "import_cycle"), ("z", "none"): (None, "unresolved"), ("c", "Z"): ("c::Z", None)}


def test_coordinates(spark):
    texts = spark.createDataFrame([("f", "ab\n\nc")], "path string, text string")
    at = spark.createDataFrame([("f", 1, 3), ("f", 2, 1), ("f", 3, 1), ("f", 3, 9), ("f", 4, 1)], "path string, line long, column long")
    got = {(r.line, r.column): r.byte for r in positions.resolved(at, positions.line_offsets(texts)).collect()}
    assert got == {(1, 3): 2, (2, 1): 3, (3, 1): 4, (3, 9): None, (4, 1): None}


def test_owners_and_modes(spark):
    blocks = spark.createDataFrame([(1, "o"), (2, "none")], "block long, owner_id string")
    have, lack = links.owned(blocks, spark.createDataFrame([("o", "x")], "owner_id string, info string"))
    assert [r.block for r in have.collect()] == [1] and [r.block for r in lack.collect()] == [2]
    docs = spark.createDataFrame([("f", 0, "c", "syntax", "p", "r"), ("g", 0, "c", "compiler", "p", "r"), ("g", 1, "d", "syntax", "p", "r")], "contract_file string, document_index int, crate_id string, mode string, profile string, root string")
    assert [(r.crate_id, r.ways) for r in constraints.mode_conflicts(docs).collect()] == [("c", 2)]


def test_long_chains_have_no_limit(spark):
    n = 60
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(n)], "parent string, child string")
    assert graph.closure(spark.createDataFrame([("n0",)], "node string"), edges).where(f"depth = {n}").count() == 1
    imports = spark.createDataFrame([(f"n{k}", "X", f"n{k + 1}", "X") for k in range(n)], "module string, name string, source string, source_name string")
    got = links.resolve(spark.createDataFrame([("n0", "X")], "module string, name string"), spark.createDataFrame([(f"n{n}", "X")], "module string, name string"), imports)
    assert [(r.target, r.fault) for r in got.collect()] == [(f"n{n}::X", None)]


def test_recovery_takes_absent_files_as_pending(spark):
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, digest string")
    got = reconcile.recovery(df({"a": "x", "b": "x", "c": "x", "d": "x"}), df({"b": "x", "c": "y", "d": "z"}), df({"a": "y", "b": "y", "c": "y", "d": "y"}))
    assert {r.path: r.state for r in got.collect()} == {"a": "pending", "b": "pending", "c": "done", "d": "conflict"}


def test_members_of_bodies(spark):
    text = b"""trait T { const N: u8; type A; fn f(&self) -> u8; fn g() { let x = 1; } }
impl<X> T for P<X> { const N: u8 = 1; pub fn f(&self) -> u8 { 2 } }
impl P { pub fn h(a: u8) {} fn i() {} }
"""
    found = items.declared(spark.createDataFrame([("lib.rs", bytearray(text))], "path string, content binary"))
    got = {(r.kind, r.name): (r.visibility, r.declaration) for r in found.where("fault IS NULL").collect()}
    assert got["associated_constant", "trait T::N"] == ("private", "const N: u8;") and got["associated_function", "trait T::g"] == ("private", "fn g()")
    assert got["associated_function", "impl P::h"] == ("pub", "fn h(a: u8)") and got["associated_function", "impl P::i"][0] == "private"
    assert ("associated_function", "impl <X> T for P<X>::f") in got


def test_passages_anywhere(spark):
    rows = [(1, "one two three four five six"), (2, "a b"), (3, "x"), (4, "lone word end"), (5, None), (6, ""), (7, "two  gaps here now")]
    texts = [(1, "zone two three four five sixth"), (2, "pa bc x"), (3, None), (4, ""), (5, "a lone word ending\ntwo  gaps here now"), (6, "one two three four six")]
    got = passages.contained(spark.createDataFrame(rows, "item long, passage string"), spark.createDataFrame(texts, "path long, text string"))
    want = {(i, p) for i, a in rows if a for p, t in texts if t is not None and a in t}
    assert {(r.item, r.path) for r in got.collect()} == want and len(want) > 4
    assert passages.contained(spark.createDataFrame([], "item long, passage string"), spark.createDataFrame(texts, "path long, text string")).count() == 0


def test_names_bytes_and_orders(spark):
    taken = spark.createDataFrame([("a.gz",), ("a-1.gz",), ("a-3.gz",), ("b.gz",), ("a-02.gz",)], "path string")
    assert signatures.free_name(taken, "a", ".gz").first().path == "a-2.gz" and signatures.free_name(taken, "c", ".gz").first().path == "c.gz"
    docs = spark.createDataFrame([("a", "o", "f", "1", "1"), ("b", "o", "f", "1", "2"), ("c", "o", None, None, None)], "path string, original string, fresh string, meaning_before string, meaning_after string")
    assert {r.path: (r.content, r.changed) for r in signatures.rewritten(docs).collect()} == {"a": ("o", False), "b": ("f", True), "c": ("o", False)}
    seeds = spark.createDataFrame([("b", 0, "1"), ("a", 1, "1"), ("a", 0, "2")], "contract_file string, document_index int, snippet_id string")
    assert [tuple(r) for r in signatures.ordered_seeds(seeds).collect()] == [("a", 0, "2"), ("a", 1, "1"), ("b", 0, "1")]


def test_line_offsets_of_long_and_repeated_files(spark):
    long = spark.range(1).select(F.lit("l").alias("path"), F.array_join(F.array_repeat(F.lit("ab"), 300_000), "\n").alias("text"))
    found = positions.line_offsets(long)
    assert found.count() == 300_000 and found.where("first <> 3 * (line - 1) OR bytes <> 2").isEmpty()
    twice = positions.line_offsets(spark.createDataFrame([("a", "x\n\nyz"), ("a", "x\n\nyz"), ("b", ""), ("c", None)], "path string, text string"))
    assert sorted(map(tuple, twice.collect())) == sorted(2 * [("a", 1, 0, 1), ("a", 2, 2, 0), ("a", 3, 3, 2)] + [("b", 1, 0, 0)])


def test_cycles_of_file_paths(spark):
    edges = spark.createDataFrame([("src/a.rs", "src/b.rs"), ("src/b.rs", "src/a.rs"), ("src/b.rs", "src/c/d.rs"), ("src/c/d.rs", "src/c/d.rs")], "parent string, child string")
    walk = graph.closure(spark.createDataFrame([("src/a.rs",)], "node string"), edges)
    assert {tuple(r) for r in graph.cycles(edges, walk).select("parent", "child").collect()} == {("src/b.rs", "src/a.rs"), ("src/c/d.rs", "src/c/d.rs")}
    nodes = walk.select(F.col("seen").alias("path"))
    assert {r.path[-1] for r in graph.wanted(nodes, nodes.where(F.element_at("path", -1) == "src/b.rs")).collect()} == {"src/a.rs", "src/b.rs", "src/c/d.rs"}


@pytest.mark.parametrize("each", [1, 3, 1000])
def test_first_crossings(spark, each):
    r = random.Random(each)
    rows = [(f"p{k:03}", k % 3, r.choice([0, 1, 5, None]), r.randrange(40)) for k in range(40)]
    want = {}
    for name, at, ceiling in [("a", 2, 20), ("b", 3, 150), ("never", 3, 10**9), ("once", 3, 0)]:
        total = 0
        for row in sorted(rows):
            total += row[at] or 0
            if total > ceiling:
                want[name] = (*row[:2], total, ceiling)
                break
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "path string, part int, a long, b long").withColumns({"never": F.col("b"), "once": F.col("b")})
    got = constraints.first_crossings(df, {"a": 20, "b": 150, "never": 10**9, "once": 0}, "path", "part", each=each)
    assert {x.resource: tuple(x)[1:] for x in got.collect()} == want
    assert constraints.first_crossings(df.limit(0), {"a": 20}, "path").count() == 0


HEADS = {
    "pub const fn f() -> u8 { 1 }": ("function", "f"),
    "const unsafe fn f() {}": ("function", "f"),
    'extern "C" fn f(x: u8) {}': ("function", "f"),
    'pub unsafe extern "system" fn f() {}': ("function", "f"),
    "extern fn f() {}": ("function", "f"),
    "async fn f() {}": ("function", "f"),
    "const X: u8 = { 1 };": ("constant", "X"),
    "const _: () = ();": ("constant", "_"),
    "static mut X: [u8; 2] = [1, 2];": ("static", "X"),
    "extern crate alloc;": ("extern_crate", "alloc"),
    "/* a /* nested */ comment */ struct T;": ("struct", "T"),
    "union U { a: u8 }": ("union", "U"),
    "type T = u8;": ("type_alias", "T"),
    "macro_rules! m { () => {} }": ("macro", "m"),
}


def test_no_item_vanishes(spark):
    files = {f"f{k}.rs": head + " pub struct S;" for k, head in enumerate(HEADS)}
    files |= {"foreign.rs": 'extern "C" { fn g(); } pub struct S;', "open.rs": "/* /* */ struct S;", "bad.rs": "const f() {} struct S;", "deep.rs": "mod a {" * 3000 + "}" * 3000}
    found = items.declared(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")).collect()
    per = {p: [(r.kind, r.name) for r in sorted((x for x in found if x.path == p), key=lambda x: x.pos)] for p in files}
    assert {p: x for p, x in per.items() if p[1:2].isdigit()} == {f"f{k}.rs": [want, ("struct", "S")] for k, want in enumerate(HEADS.values())}
    assert {r.path for r in found if r.fault} == {"foreign.rs", "open.rs", "bad.rs", "deep.rs"}
    member = items.declared(spark.createDataFrame([("a.rs", bytearray(b"impl P { pub const fn new() -> Self { P } const N: u8 = 1; }"))], "path string, content binary")).collect()
    assert [(r.kind, r.name, r.fault) for r in member] == [("impl", "P", None), ("associated_function", "impl P::new", None), ("associated_constant", "impl P::N", None)]
    two = [r.declaration for r in found if r.path in ("f2.rs", "f3.rs") and r.name == "f"]
    assert any('"C"' in d for d in two) and any('"system"' in d for d in two)


def plain_walk(to, at):
    seen = [at]
    while seen[-1] in to and len(seen) <= len(to) + 1:
        seen.append(to[seen[-1]])
        if seen[-1] == at:
            return None, None, "on_cycle"
    return (seen[-1], len(seen) - 1, "ended") if seen[-1] not in to else (None, None, "to_cycle")


def test_jumps_equal_walks_step_by_step(spark, monkeypatch):
    rounds = []
    real = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: rounds.append(1) or real(df))
    r = random.Random(4)
    to = {f"src/chain/{k}.rs": f"src/chain/{k + 1}.rs" for k in range(2000)}
    to |= {f"src/ring/{k}.rs": f"src/ring/{(k + 1) % 500}.rs" for k in range(500)} | {"hang.rs": "src/ring/7.rs", "self.rs": "self.rs"}
    to |= {f"r{k}": f"r{r.randrange(400)}" for k in range(300)}
    found = graph.jumps(spark.createDataFrame(list(to.items()), "at string, to string")).collect()
    assert {x.at: (x.end, x.hops, x.kind) for x in found} == {at: plain_walk(to, at) for at in to} and len(found) == len(to)
    assert len(rounds) < 20
    assert graph.jumps(spark.createDataFrame([(None, "a"), ("a", None)], "at string, to string")).count() == 0


def test_ancestry(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("x", "y"), ("z", "y"), ("y", "w"), ("p", "q"), ("q", "p"), ("q", "o")]
    got = {x.node: (x.top, x.depth, x.fault) for x in graph.ancestry(spark.createDataFrame(edges, "parent string, child string")).collect()}
    assert got == {"b": ("a", 1, None), "c": ("a", 2, None), "y": (None, None, "several_parents"), "w": (None, None, "below_several_parents"), "p": (None, None, "on_cycle"), "q": (None, None, "on_cycle"), "o": (None, None, "below_cycle")}


def test_names_through_forks_and_chains_equal_plain_walks(spark):
    r = random.Random(9)
    leads = {(f"m{r.randrange(60)}", f"m{r.randrange(60)}") for _ in range(60)}
    homes = {f"m{k}" for k in range(0, 60, 9)}

    def plain(at, seen):
        if at in homes:
            return {at}, False
        if at in seen:
            return set(), True
        got = [plain(b, seen | {at}) for a, b in leads if a == at]
        return set().union(*(t for t, _ in got)), any(c for _, c in got)

    want = {}
    for k in range(60):
        t, c = plain(f"m{k}", frozenset())
        want[f"m{k}"] = (f"{min(t)}::x" if len(t) == 1 else None, "ambiguous" if len(t) > 1 else None if t else "import_cycle" if c else "unresolved")
    rows = links.resolve(*(spark.createDataFrame(x, s) for x, s in (([(f"m{k}", "x") for k in range(60)], "module string, name string"), ([(h, "x") for h in homes], "module string, name string"), ([(a, "x", b, "x") for a, b in leads], "module string, name string, source string, source_name string"))))
    assert {x.module: (x.target, x.fault) for x in rows.collect()} == want and {f for _, f in want.values()} >= {None, "unresolved", "import_cycle"}


def test_exports_equal_a_plain_fixpoint(spark):
    r = random.Random(12)
    declared = [(f"m{r.randrange(12)}", r.choice("abcd"), k) for k in range(14)]
    taken = [(f"m{r.randrange(12)}", r.choice("abcde"), f"m{r.randrange(13)}", r.choice("abcde"), False) for _ in range(14)]
    taken += [(f"m{r.randrange(12)}", None, f"m{r.randrange(12)}", None, True) for _ in range(12)] + [("m1", None, "m2", None, True), ("m2", None, "m1", None, True), ("s", "z", "s", "z", False)]
    fixed = {(m, n) for m, n, _ in declared} | {(m, n) for m, n, _, _, g in taken if not g}
    held = set(declared)
    while True:
        more = {(m, n, i) for m, n, s, t, g in taken if not g for a, b, i in held if (a, b) == (s, t)}
        more |= {(m, b, i) for m, _, s, _, g in taken if g for a, b, i in held if a == s and (m, b) not in fixed}
        if more <= held:
            break
        held |= more
    want = {}
    for at in fixed | {x[:2] for x in held}:
        items = {i for m, n, i in held if (m, n) == at}
        want[at] = (min(items) if len(items) == 1 else None, at in fixed, "conflict" if len(items) > 1 else None if items else "unresolved")
    got = exports.expanded(spark.createDataFrame(declared, "module string, name string, item long"), spark.createDataFrame(taken, "module string, name string, source string, source_name string, glob boolean"))
    assert {(x.module, x.name): (x.item, x.explicit, x.fault) for x in got.collect()} == want
    assert {(e, f) for _, e, f in want.values()} >= {(True, None), (False, None), (True, "conflict"), (False, "conflict"), (True, "unresolved")}


def test_exports_through_modules_without_names_are_not_staged_by_name(spark, monkeypatch):
    wrote = []

    def counted(df):
        out = staged(df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(exports, "staged", counted)
    declared = spark.range(40).selectExpr("'top' AS module", "'n' || id AS name", "id AS item")
    taken = spark.range(30).selectExpr("'p' || id AS module", "CAST(NULL AS string) AS name", "CASE WHEN id = 0 THEN 'top' WHEN id < 6 THEN 'p' || (id - 1) ELSE 'p5' END AS source", "CAST(NULL AS string) AS source_name", "true AS glob")
    turn = spark.createDataFrame([("p1", None, "p4", None, True)], taken.schema)
    got = exports.expanded(declared, taken.unionByName(turn))
    assert {(x.module, x.name, x.item, x.explicit, x.fault) for x in got.collect()} == {(m, f"n{k}", k, m == "top", None) for m in ("top", *(f"p{i}" for i in range(30))) for k in range(40)}
    assert sum(wrote) < 40 * 30


def test_contract_rules_take_few_passes(spark):
    documents = spark.createDataFrame([("c", 0, "src", ["f.rs", "f.rs"], None), ("c", 1, " ", ["g.rs"], None), ("c", 2, "src", [], "version")], "contract_file string, document_index long, root string, files array<string>, fault string")
    sketches = spark.createDataFrame([("a", "c", 0, "f.rs", ["x"], "l", "fn"), ("a", "c", 1, "f.rs", [], "l", "fn"), (None, "c", 1, "g.rs", ["x"], "l", "fn"), (None, "c", 1, "g.rs", ["x"], "l", "fn"), ("b\n", "c", 0, "f.rs", ["x"], "k", "fn")],
                                     "snippet_id string, contract_file string, document_index long, path string, code array<string>, linked_signature string, signature_type string")
    signatures = spark.createDataFrame([("l", "c", 0, "a", "fn", "f.rs"), ("l", "c", 0, "a", "type", "f.rs"), (None, "c", 1, None, "fn", None), (None, "c", 1, "none", "fn", "g.rs")], "label string, contract_file string, document_index long, sketch string, signature_type string, file string")
    broken = violations.violations(documents, sketches, signatures)
    nothing = [("orphan_sketch", None, 1), ("invalid_id", None, 1)] * 2
    assert sorted(((x.code, x.name, x.document_index) for x in broken.collect()), key=str) == sorted([
        ("duplicate_file", None, 0), ("blank_root", None, 1), ("version", None, 2), ("duplicate_sketch", "a", 0), ("duplicate_sketch", "a", 1), ("unlisted_file", "a", 1), ("empty_code", "a", 1), ("invalid_id", "b\n", 0),
        ("duplicate_label", "l", 0), ("duplicate_label", "l", 0), ("not_rust", None, 1), ("unlisted_signature_file", None, 1), ("dangling_link", None, 1), ("type_mismatch", "a", 0), ("orphan_sketch", "a", 1), ("orphan_sketch", "b\n", 0), *nothing], key=str)
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 12  # each is a pass over the rows of one kind


def test_inventory_entries_meet_once_and_travel_packed(spark):
    texts = ["", "ab", "AB", "abc", "0g", "é", "a" * 64, None]
    pack = spark.createDataFrame([(x,) for x in texts], "x string").select("x", digests.packed(F.col("x")).alias("p")).select("x", digests.unpacked(F.col("p")).alias("y"), F.length("p").alias("n")).collect()
    assert [x.y for x in pack] == texts and [x.n for x in pack if x.x == "a" * 64] == [33]
    rows = lambda x: spark.createDataFrame(x, "entry_id string, semantic_id string, group_id string, digest string")
    expected, actual = rows([("e1", "s", "g1", "ab"), ("e2", "s", "g2", "AB"), ("e3", "s", "g3", "ab")]), rows([("e1", "s", "h1", "ab"), ("e2", "s", "h2", "ab"), ("e4", "s", "e3", "ab")])
    found = inventory.compared(expected, actual)
    assert {(x.key, x.kind) for x in found.collect()} == {("g2", "mismatched"), ("g3", "missing")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3  # the peers of extra entries and both sides' shapes: the entries' own join is staged


def test_walks_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "staged", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), staged(df))[1])
    found = graph.ancestry(spark.range(1, 40).selectExpr("id - 1 AS parent", "id AS child"))
    assert {(x.node, x.top, x.depth) for x in found.collect()} == {(k, 0, k) for k in range(1, 40)}
    assert len(seen) > 3 and not any("Broadcast" in x for x in [*seen, found._jdf.queryExecution().executedPlan().toString()])
