"""Operators against brute force on small inputs."""

import random

from pyspark.sql import functions as F

from ripplework.functions import paths as P
from ripplework.functions import text as X
from ripplework.functions.wording import reason_label
from ripplework.operators import intent as N
from ripplework.operators import lines as L
from ripplework.operators import maps as M
from ripplework.operators import resolve as R
from ripplework.operators.intervals import innermost_interval, levels_for
from ripplework.operators.python_source import file_facts
from ripplework.sinks import export as E


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_innermost_interval_is_the_shortest_then_the_first(spark):
    rng = random.Random(7)
    intervals = [(k, i, *sorted((rng.randint(0, 300), rng.randint(0, 300)))) for k in "ab" for i in range(60)]
    points = [(k, i, rng.randint(0, 320)) for k in "abc" for i in range(80)]
    got = {(r["k"], r["i"]): r["owner"] for r in innermost_interval(
        spark.createDataFrame(points, "k string, i int, at long"), spark.createDataFrame(intervals, "k string, owner int, s long, e long"),
        keys=["k"], point_id=["k", "i"], at="at", start="s", end="e", order=["owner"], carry=["owner"], levels=levels_for(1000)).collect()}
    for k, i, at in points:
        held = [(e - s, owner) for kk, owner, s, e in intervals if kk == k and s <= at <= e]
        assert got[(k, i)] == (min(held)[1] if held else None)


def test_paths(spark):
    cases = {"tests/test_auth.py": "test", "latest/x.py": None, "a/b_test.go": "test", "web/x.Spec.ts": "test", "test.js": "test",
             "a/Cargo.toml": "dependency", "x.toml": "configuration", "Dockerfile": "configuration", "src/conftest.py": "test"}
    rows = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", P.classify_file("path")).collect()
    assert [(r["path"], r["got"]) for r in rows] == [(r["path"], r["want"]) for r in rows]
    assert one(spark, P.fold_dots(F.lit("./a/./b/../c/../../../d"))) == "../d"
    for path, ignored in ((".state\\events.jsonl", True), ("report.PDF", True), ("report.pdfx", False), (".stateful/x", False)):
        assert one(spark, P.is_ignored(F.lit(path), (".state", "*.pdf"))) is ignored
    for path, secret in ((".env", True), ("a/KEY.pem", True), ("home/.ssh/id", True), ("environment.py", False)):
        assert one(spark, P.is_secret(F.lit(path))) is secret


def test_text(spark):
    for text in ("", "a", "a\n", "a\nb", "\n\n", "a\r\nb\x0bc "):
        assert one(spark, X.line_count(F.lit(text))) == len(text.splitlines())
    assert one(spark, X.normalise_whitespace(F.lit(" a  b\x1cc\t"))) == "a b c"
    assert one(spark, X.task_tokens(F.lit("Add rate limiting to the login_endpoint; rate!"))) == ["rate", "limiting", "login_endpoint"]
    assert one(spark, X.token_forms(F.lit("limiting"))) == ["limiting", "limit"]
    assert one(spark, X.token_forms(F.lit("rating"))) == ["rating"]
    assert one(spark, X.wrap(F.lit("aa bb cccccc d"), 5)) == ["aa bb", "cccccc", "d"]
    assert one(spark, X.looks_binary(F.lit("a\x00b"))) is True
    assert one(spark, X.url_quote(F.lit("a b/c*~"))) == "a%20b%2Fc%2A~"
    assert one(spark, reason_label(F.lit("symbol_removed"), F.lit(0))) == "removed"
    assert tuple(one(spark, X.pytest_counts(F.lit("a\n== 1 failed, 2 passed, 1 error in 1s ==\nx")))) == (2, 2, 0)


def test_line_counts_agree_with_difflib(spark):
    import difflib
    rng = random.Random(3)
    pairs = [("", ""), ("", "a\nb"), ("a\n", ""), ("a\n", "a\nb\n"), ("a", "ab"), ("x\x00", "y")]
    pairs += [("\n".join(rng.choices("abcd", k=6)), "\n".join(rng.choices("abcd", k=6))) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in L.with_line_counts(rows, "a", "b").collect():
        codes = [c for c in difflib.SequenceMatcher(None, r["a"].splitlines(), r["b"].splitlines(), autojunk=False).get_opcodes() if c[0] != "equal"]
        want = (None, None) if "\x00" in r["a"] + r["b"] else (sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes))
        assert (r["insertions"], r["deletions"]) == want


def test_lines_added_after_an_unfinished_line_need_no_python(spark):
    """Counts agree with difflib whatever ends the lines, and no text of a mere addition is sent to a Python worker."""
    import difflib
    olds = ["a", "a\nb", "a\r", "a\r\n", "a\u2028", "a\n", "a\na", "a\x85b"]
    ends = ["\n", "\nb", "\r\nb", "\r", "\n\n", "\x0cx\ny\n", "\u2028a\na", "\x1ea", "\na\na"]
    pairs = [(old, old + end) for old in olds for end in ends]
    counted = L.with_line_counts(spark.createDataFrame([*pairs, ("a", "ab"), ("a\r", "a\rb")], "a string, b string"), "a", "b")
    for r in counted.collect():
        codes = [c for c in difflib.SequenceMatcher(None, r["a"].splitlines(), r["b"].splitlines(), autojunk=False).get_opcodes() if c[0] != "equal"]
        assert (r["insertions"], r["deletions"]) == (sum(c[4] - c[3] for c in codes), sum(c[2] - c[1] for c in codes)), (r["a"], r["b"])
    kept, L._opcode_counts = L._opcode_counts, lambda old, new: F.raise_error(F.concat(F.lit("sent: "), old, new)).cast(L.COUNTS)
    try:
        assert L.with_line_counts(spark.createDataFrame(pairs, "a string, b string"), "a", "b").where("insertions >= 0").count() == len(pairs)
    finally:
        L._opcode_counts = kept


def test_file_diff_states(spark):
    rows = [("r", "a", "x\n", "y\n", False, False, None), ("r", "b", None, None, False, False, None), ("r", "c", "x", "y", True, False, None),
            ("r", "d", "x\x00", "y", False, False, None), ("r", "e", "", "\n".join(map(str, range(900))), False, False, "no")]
    frame = spark.createDataFrame(rows, "repo string, path string, before string, after string, withheld boolean, too_large boolean, recorded_digest string")
    got = {r["path"]: r for r in L.file_diff(frame).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "available", "b": "unavailable", "c": "withheld", "d": "binary", "e": "available"}
    assert got["a"]["lines"][-2:] == ["-x", "+y"] and got["e"]["truncated"] and len(got["e"]["lines"]) == 400 and got["e"]["drifted"]


def _layers(n, edges):
    """Longest path by rounds, then what a cycle holds back, node by node."""
    ranks = {}
    k = 0
    while True:
        ready = [i for i in range(n) if i not in ranks and all(s in ranks for s, t in edges if t == i)]
        if not ready:
            break
        ranks.update(dict.fromkeys(ready, k))
        k += 1
    for i in range(n):
        if i not in ranks:
            before = [ranks[s] for s, t in edges if t == i and s in ranks]
            ranks[i] = (max(before) if before else max(ranks.values(), default=-1)) + 1
    return [ranks[i] for i in range(n)]


def test_layers_with_and_without_cycles(spark):
    rng = random.Random(5)
    cases = [(n, list({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a != b})) for n in (1, 3, 6, 9) for _ in range(4)]
    rows = spark.createDataFrame([(i, n, [(int(a), int(b)) for a, b in e]) for i, (n, e) in enumerate(cases)], "i int, n int, e array<struct<s:int,t:int>>")
    for r in rows.withColumn("ranks", M.layer_ranks(F.col("n"), F.col("e"))).collect():
        assert r["ranks"] == _layers(*cases[r["i"]])


def test_module_names_and_relative_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/pkg/__init__.py", "src/pkg/sub/x.py", "c.py", "a/b/c.py")], "repo string, path string")
    names = {(r["path"], r["name"]) for r in R.module_names(files).collect()}
    assert ("src/pkg/__init__.py", "pkg") in names and ("src/pkg/sub/x.py", "pkg.sub.x") in names
    assert ("src/pkg/sub/x.py", "sub.x") not in names
    assert {r["name"]: r["path"] for r in R.module_index(R.module_names(files)).collect()}["c"] == "c.py"
    candidates = lambda *a: one(spark, R.python_candidates(*[F.lit(x).cast("string") if i in (0, 1, 3) else F.lit(x) for i, x in enumerate(a)]))
    assert candidates("a.b", "c", 0, "x", False) == ["a.b.c", "a.b"]
    assert candidates("", "helper", 1, "pkg", True) == ["pkg.helper", "pkg"]
    assert candidates("m", "z", 2, "pkg.sub.mod", False) == ["pkg.m.z", "pkg.m"]
    assert candidates("", "y", 3, "a.b", False) == []


def test_strip_jsonc(spark):
    text = '{ /* c */ "a": "http://x", // y\n "b": [1, 2,], }'
    assert one(spark, R.strip_jsonc(F.lit(text))).replace("\n", "").replace(" ", "") == '{"a":"http://x","b":[1,2]}'


def test_intent_matches_by_path_symbol_import_and_stem(spark):
    tasks = spark.createDataFrame([("r", "Add rate limiting to the login endpoint for throttle")], "repo string, task string")
    facts = spark.createDataFrame([("r", "auth/login.py", ["a"], []), ("r", "x/ratelimiter.py", ["Gate.check_rate"], []), ("r", "y.py", [], ["lib.throttle"]), ("r", "z.py", [], [])],
                                  "repo string, path string, symbols array<string>, imports array<string>")
    got = {(r["path"], r["token"]): r["kind"] for r in N.intent_matches(tasks, facts).collect()}
    assert got == {("auth/login.py", "login"): "path", ("x/ratelimiter.py", "rate"): "path", ("x/ratelimiter.py", "limiting"): "path", ("y.py", "throttle"): "import"} or \
        got == {("x/ratelimiter.py", "rate"): "path", ("x/ratelimiter.py", "limiting"): "path", ("y.py", "throttle"): "import", ("auth/login.py", "login"): "path"}
    assert N.verdicts(tasks, facts).first()["relatedness"] == "scope_expansion"
    assert N.verdicts(tasks.withColumn("task", F.lit("add the")), facts).first()["relatedness"] == "not_compared"


def test_python_facts_keep_every_marker():
    facts = file_facts(b"@d\nclass A(B, k=1):\n    def f(self, a, /, b: int = 1, *args, c=2, **kw) -> int:\n        x.y(1)\n        z[0](2)\n")
    assert [(d["qualified_name"], d["kind"], d["signature"]) for d in facts["definitions"]] == [
        ("A", "class", "(B, k = 1)"), ("A.f", "method", "self, a, /, b: int = 1, *args, c = 2, **kw -> int")]
    assert facts["calls"] == [{"name": "x.y", "line": 4}]
    moved = file_facts(b"@d\nclass A(B, k=1):\n\n    def f(self, a, /, b: int=1, *args, c=2, **kw) -> int:\n        # note\n        x.y( 1 )\n        z[0](2)\n")
    assert [d["body_fingerprint"] for d in moved["definitions"]] == [d["body_fingerprint"] for d in facts["definitions"]]
    assert file_facts(b"def (:")["parse_error"].startswith("SyntaxError")


def test_python_definitions_are_spelled_like_the_library_and_only_on_demand():
    import ast
    import inspect

    from ripplework.operators import python_source

    for text in (inspect.getsource(ast), inspect.getsource(inspect), "x = f'{a!r:>{w}}' + u'b'\nasync def f(*, a=-1j, **k): yield ...\n"):
        assert [python_source.spelled(x) for x in ast.parse(text).body] == [ast.dump(x) for x in ast.parse(text).body]
    plain = b"import a as x, b\ndef f(a: p.q = None, b=1):\n    a.b(1)\n"
    assert file_facts(plain, symbols=False) == {**file_facts(plain), "definitions": []}
    # What cannot be spelled is a parse error, whatever is asked for.
    deep, long = b"def f(a=" + b"-" * 900 + b"1): pass\n", b"def f(a=0x" + b"f" * 5000 + b"): pass\n"
    for bad in (deep, long):
        assert file_facts(bad)["parse_error"] and file_facts(bad, symbols=False) == file_facts(bad)


def test_an_empty_view_still_opens():
    import json
    from xml.dom.minidom import parseString

    from ripplework.sinks.export import empty_document
    assert parseString(empty_document("change", "svg", "a<b")).documentElement.tagName == "svg"
    assert json.loads(empty_document("change", "json", "r"))["nodes"] == []
    assert json.loads(empty_document("before-after", "excalidraw", "r"))["elements"] == []


def test_a_drawing_reads_its_boxes_once_computed(spark):
    """Views, layers and boxes are tables for the passes after them; a drawing says its numbers to one digit."""
    nodes = spark.createDataFrame([("r", f"p{n}", "modified", 2, 0, "", "") for n in range(5)],
                                  "repo string, path string, state string, state_rank int, distance int, detail string, link string")
    edges = spark.createDataFrame([("r", "p0", "p1", "affects", 1), ("r", "p1", "p2", "affects", 1), ("r", "p2", "p0", "affects", 1)],
                                  "repo string, source string, target string, kind string, evidence long")
    kept, drawn, omitted = M.capped(nodes, edges)
    layered = M.layers(kept, drawn)
    boxes = M.placed(layered)
    assert all(frame.inputFiles() for frame in (kept, drawn, layered, boxes))
    routes = M.routed(boxes, drawn)
    document = E.to_svg("change", boxes, routes, omitted).first().document
    assert document.count("<rect ") == 5 and document.count("<path ") == 3
    at = {r.path: (r.x, r.y) for r in boxes.collect()}
    assert all(f'<rect x="{x:.1f}" y="{y:.1f}" width="236.0" height="64.0"' in document for x, y in at.values())
    ends = [y + 64 for _, y in at.values()] + [p.y for r in routes.collect() for p in r.points]
    right, low = max(x for x, _ in at.values()) + 236 + 32, max(ends) + 32
    assert f'width="{right:.1f}"' in document and f'height="{low:.1f}"' in document
    for value in (0.0, -28.0, 0.25, 0.05, 154.75, 1e9 + 0.5):
        assert one(spark, E._number(F.lit(value))) == one(spark, F.format_string("%.1f", F.lit(value)))


def test_resolving_imports_shuffles_their_columns_once(spark):
    """Keys are looked up without what else an import holds, and only relative imports ask for the name of their file."""
    files = spark.createDataFrame([("r", p) for p in ("app/__init__.py", "app/a.py", "app/b.py", "web/x.ts", "src/m.rs")], "repo string, path string")
    imports = spark.createDataFrame([
        ("r", "app/a.py", 0, "app", "b", None, 0, 1), ("r", "app/a.py", 1, "", "b", "c", 1, 2), ("r", "app/a.py", 2, "os", None, None, 0, 3),
        ("r", "app/a.py", 3, "app.b", None, None, None, 4), ("r", "web/y.ts", 0, "./x", None, None, 0, 1), ("r", "notes.txt", 0, "app", None, None, 0, 1),
        ("r", "src/m.rs", 0, "crate::m::f", "f", None, 0, 9)], "repo string, path string, ordinal int, module string, name string, alias string, level int, line int")
    heads = files.selectExpr("repo", "path", "'' as head")
    resolved = R.resolve_imports(imports, files, heads)
    assert resolved.columns == ["repo", "path", "ordinal", "module", "name", "alias", "level", "line", "target"]
    assert {(r.path, r.ordinal, r.module, r.alias, r.line): r.target for r in resolved.collect()} == {
        ("app/a.py", 0, "app", None, 1): "app/b.py", ("app/a.py", 1, "", "c", 2): "app/b.py", ("app/a.py", 2, "os", None, 3): None,
        ("app/a.py", 3, "app.b", None, 4): "app/b.py", ("web/y.ts", 0, "./x", None, 1): "web/x.ts", ("src/m.rs", 0, "crate::m::f", None, 9): "src/m.rs"}

    def nodes(plan):
        yield plan
        below = plan.children()
        for i in range(below.size()):
            yield from nodes(below.apply(i))

    plan = resolved._jdf.queryExecution().sparkPlan()
    joined = [n.output().mkString(",") for n in nodes(plan) if "Join" in n.nodeName() and "key#" in n.toString().split("\n")[0]]
    assert joined and not any("line#" in x or "alias#" in x for x in joined), joined


def _view(spark):
    nodes = spark.createDataFrame([("r", p, "modified", 2, 0, "d") for p in "abcd"] + [("q", "a", "added", 0, 0, ""), (None, "a", "added", 0, 0, "")],
                                  "repo string, path string, state string, state_rank int, distance int, detail string")
    edges = spark.createDataFrame([("r", "a", "b", "affects", 1), ("r", "b", "c", "affects", 1), ("r", "a", "c", "affects", 1), ("r", "c", "x", "affects", 1),
                                   ("q", "a", "b", "affects", 1)], "repo string, source string, target string, kind string, evidence int")
    return nodes, edges


def test_boxes_and_edges_of_views_travel_once_a_step(spark, monkeypatch):
    """Everything in a view is found by its repository: no end of an edge asks for a shuffle of its own, nor does a layer."""
    monkeypatch.setattr(M, "cut_lineage", lambda frame: frame.localCheckpoint())
    nodes, edges = _view(spark)
    kept, drawn, _ = M.capped(nodes, edges)
    assert sorted((r.source, r.target) for r in drawn.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    layered = M.layers(kept, drawn)
    assert {(r.repo, r.path): r.layer for r in layered.collect()} == {("r", "a"): 0, ("r", "b"): 1, ("r", "c"): 2, ("r", "d"): 0, ("q", "a"): 0}
    boxes = M.placed(layered)
    assert {(r.repo, r.path): (r.x, r.y) for r in boxes.collect()} == {
        ("r", "a"): (0.0, 0.0), ("r", "d"): (0.0, 80.0), ("r", "b"): (308.0, 40.0), ("r", "c"): (616.0, 40.0), ("q", "a"): (0.0, 0.0)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(M, "cut_lineage", lambda frame: frame)
        shuffles = [frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for frame in (M.placed(layered), M.routed(boxes, drawn))]
        assert shuffles == [1, 2]
        assert sorted((r.source, r.target, r.points[0].x) for r in M.routed(boxes, drawn).collect()) == [("a", "b", 236.0), ("a", "c", 236.0), ("b", "c", 544.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exports_gather_rows_and_not_what_is_drawn_of_them(spark, monkeypatch):
    monkeypatch.setattr(M, "cut_lineage", lambda frame: frame.localCheckpoint())
    kept, drawn, omitted = M.capped(*_view(spark))
    layered = M.layers(kept, drawn)
    boxes = M.placed(layered)
    routes = M.routed(boxes, drawn)
    for frame, marks in ((E.to_excalidraw("change", boxes, routes, omitted), ("to_json", "structstojson")), (E.to_svg("change", boxes, routes, omitted), ("<g>", "<path"))):
        lines = frame._jdf.queryExecution().sparkPlan().toString().splitlines()
        gathered = [line for line in lines if "collect_list" in line]
        assert gathered and not any(mark in line for line in gathered for mark in marks)
        assert {r.repo for r in frame.collect()} == {"r", "q"}
