"""Whole analyses on small repositories; every scenario is one ``repo`` of a single run."""

import pytest
from pyspark.sql import functions as F

from ripplework.operators import impact as I
from ripplework.plans.analyze import analyze_change

FUNCTION = "def {name}({args}):\n    return {value}\n"
ROUTE = "from auth.service import authenticate\n\ndef login(user, password):\n    return authenticate(user, password)\n"
CHAIN = {"b.py": "from a import f\n\ndef g():\n    return f(1)\n", "c.py": "from b import g\n\ndef h():\n    return g()\n"}
WIDE = {f"unrelated/m{n}.py": FUNCTION.format(name=f"u{n}", args="", value=n) for n in range(200)}
GO = "package auth\n\nimport \"example.com/m/store\"\n\nfunc Login(u string) bool {\n\treturn store.Find(u)\n}\n"
JAVA = ("package com.app;\nimport com.db.Store;\npublic class UserService {\n  public boolean login(String u) {\n"
        "    return Store.find(u);\n  }\n}\n")
RUST = "use crate::service;\npub fn handle(u: u32) -> bool {\n    service::login(u)\n}\n"
CSHARP = "using App.Data;\nnamespace App.Web {\n  public class Perm {\n    public bool Check(int id) {\n      return Repo.Validate(id);\n    }\n  }\n}\n"
PAGE = "import { helper } from './util/helper';\nexport class TaskController {\n  create(id: string) {\n    return helper(id);\n  }\n}\n"

# name: (files that stay, files before, files after, status of each changed file)
SCENARIOS = {
    "signature": ({"auth/routes.py": ROUTE, "auth/__init__.py": ""}, {"auth/service.py": FUNCTION.format(name="authenticate", args="user, password", value="user")},
                  {"auth/service.py": FUNCTION.format(name="authenticate", args="user, password, mfa=False", value="user")}),
    "body": ({"auth/routes.py": ROUTE, "auth/__init__.py": ""}, {"auth/service.py": FUNCTION.format(name="authenticate", args="user, password", value="user")},
             {"auth/service.py": FUNCTION.format(name="authenticate", args="user, password", value="password")}),
    "chain": (CHAIN, {"a.py": FUNCTION.format(name="f", args="x", value="x")}, {"a.py": FUNCTION.format(name="f", args="x, y", value="x")}),
    "cycle": ({"b.py": "from a import f\n\ndef g():\n    return f()\n", "x.py": "def lone():\n    return 1\n"},
              {"a.py": "from b import g\n\ndef f(x):\n    return g()\n"}, {"a.py": "from b import g\n\ndef f(x, y):\n    return g()\n"}),
    "wide": ({**WIDE, "one.py": "from core import f\n\ndef one():\n    return f()\n", "two.py": "from core import f\n\ndef two():\n    return f()\n"},
             {"core.py": FUNCTION.format(name="f", args="", value=1)}, {"core.py": FUNCTION.format(name="f", args="x", value=1)}),
    "twice": ({"z.py": "from lib import one, two\n\ndef helper():\n    one()\n    two()\n"},
              {"lib.py": "def one(a):\n    pass\n\ndef two(a):\n    pass\n"}, {"lib.py": "def one(a, b):\n    pass\n\ndef two(a, b):\n    pass\n"}),
    "deleted": ({"user.py": "import gone\nimport os\n\ndef use():\n    return gone.f()\n"}, {"gone.py": FUNCTION.format(name="f", args="", value=1)}, {}),
    "dynamic": ({}, {"d.py": "from os import *\n\ndef f(x):\n    return getattr(x, 'a')\n"}, {"d.py": "from os import *\n\ndef f(x, y):\n    return getattr(x, 'a')\n"}),
    "broken": ({}, {"e.py": "x = 1\n"}, {"e.py": "def (:\n"}),
    "plain": ({}, {"notes.txt": "a\n"}, {"notes.txt": "b\n"}),
    "tests": ({"tests/test_a.py": "from a import f\n\ndef test_f():\n    assert f(1)\n"}, {"a.py": FUNCTION.format(name="f", args="x", value="x")},
              {"a.py": FUNCTION.format(name="f", args="x, y", value="x")}),
    "go": ({"go.mod": "module example.com/m\n", "auth/auth.go": GO}, {"store/store.go": "package store\n\nfunc Find(u string) bool {\n\treturn true\n}\n"},
           {"store/store.go": "package store\n\nfunc Find(u string, deep bool) bool {\n\treturn true\n}\n"}),
    "java": ({"src/UserService.java": JAVA}, {"src/Store.java": "package com.db;\npublic class Store {\n  public static boolean find(String u) { return true; }\n}\n"},
             {"src/Store.java": "package com.db;\npublic class Store {\n  public static boolean find(String u, int n) { return true; }\n}\n"}),
    "rust": ({"src/handlers.rs": RUST}, {"src/service.rs": "pub fn login(u: u32) -> bool {\n    true\n}\n"},
             {"src/service.rs": "pub fn login(u: u64) -> bool {\n    true\n}\n"}),
    "csharp": ({"app/Perm.cs": CSHARP}, {"data/Repo.cs": "using System;\nnamespace App.Data {\n  public class Repo {\n    public static bool Validate(int id) { return true; }\n  }\n}\n"},
               {"data/Repo.cs": "using System;\nnamespace App.Data {\n  public class Repo {\n    public static bool Validate(long id) { return true; }\n  }\n}\n"}),
    "typescript": ({"web/task.ts": PAGE, "web/home.ts": "import { TaskController } from '@app/task';\nexport const home = () => {\n  return TaskController.create('1');\n};\n",
                    "tsconfig.json": '{ // aliases\n "compilerOptions": {"paths": {"@app/*": ["web/*"],},}, }'},
                   {"web/util/helper.ts": "export function helper(id: string): string {\n  return id;\n}\nexport function unusedHelper() {\n  return 1;\n}\n"},
                   {"web/util/helper.ts": "export function helper(id: string, x: number): string {\n  return id;\n}\n"}),
}


@pytest.fixture(scope="module")
def report(spark):
    before, after, changes = [], [], []
    for name, (kept, old, new) in SCENARIOS.items():
        before += [(name, path, text) for path, text in old.items()]
        after += [(name, path, text) for path, text in {**kept, **new}.items()]
        changes += [(name, path, "deleted" if path not in new else "added" if path not in old else "modified", None) for path in {**old, **new}]
    files = "repo string, path string, content string"
    found = analyze_change(
        spark.createDataFrame(before, files), spark.createDataFrame(after, files).repartition(7),
        spark.createDataFrame(changes, "repo string, path string, status string, original_path string"))
    nodes = {}
    for row in found.walk.nodes.collect():
        nodes.setdefault(row["repo"], {})[(row["path"], row["symbol"])] = row
    return found, nodes


def _short(nodes, name):
    return {key: (row["category"], row["reason"], row["distance"]) for key, row in nodes[name].items()}


def test_a_changed_declaration_obliges_its_caller(report):
    node = report[1]["signature"][("auth/routes.py", "login")]
    assert (node["category"], node["reason"], node["distance"], node["confidence"]) == ("indirect", "signature_changed", 1, "confirmed")
    assert node["chain"] == ["auth/service.py", "auth/routes.py"]
    assert [e["kind"] for e in node["evidence"]] == ["symbol_change", "call_expression"]
    assert node["evidence"][1]["detail"] == "authenticate reaches auth/service.py#authenticate"


def test_a_changed_body_only_may_matter(report):
    assert _short(report[1], "body")[("auth/routes.py", "login")] == ("potential", "body_changed", 1)


def test_impact_attenuates_with_distance(report):
    found = _short(report[1], "chain")
    assert found[("b.py", "g")] == ("indirect", "signature_changed", 1)
    assert found[("c.py", "h")] == ("potential", "indirect_dependency", 2)


def test_a_cycle_ends_and_reaches_its_origin(report, spark):
    found = _short(report[1], "cycle")
    assert set(found) == {("a.py", "f"), ("b.py", "g")}
    reaches = report[0].walk.reaches.where("repo = 'cycle'").collect()
    assert [(r["path"], r["symbol"], r["reason"], r["distance"]) for r in reaches] == [("a.py", "f", "indirect_dependency", 2)]


def test_unrelated_files_stay_out(report):
    assert len(report[1]["wide"]) == 3


def test_two_routes_to_one_symbol_are_one_node_and_one_reach(report):
    found = report[1]["twice"]
    assert sum(1 for key in found if key[0] == "z.py") == 1
    reach = report[0].walk.reaches.where("repo = 'twice' and path = 'z.py'").collect()
    assert [(r["reason"], r["arrivals"]) for r in reach] == [("signature_changed", 1)]
    evidence = report[0].walk.evidence.where("repo = 'twice' and path = 'z.py' and kind = 'call_expression'").count()
    assert evidence == 2


def test_a_deleted_module_leaves_a_dangling_import(report):
    found = _short(report[1], "deleted")
    assert found[("gone.py", "f")] == ("direct", "file_deleted", 0)
    assert found[("user.py", None)] == ("indirect", "dangling_import", 1)
    assert [r["module"] for r in report[0].external.where("repo = 'deleted'").collect()] == ["os"]


def test_limits_are_stated(report):
    texts = [r["text"] for r in report[0].limitations.where("repo = 'dynamic'").orderBy("rank").collect()]
    assert texts[0].startswith("1 import(s) lead out of the repository")
    assert texts[1].startswith("d.py:1 imports everything by wildcard") and texts[2].startswith("d.py:4 calls getattr")
    broken = [r["text"] for r in report[0].limitations.where("repo = 'broken'").collect()]
    assert len(broken) == 1 and "nothing is known of the symbols" in broken[0]


def test_files_without_an_analyzer_are_findings_themselves(report):
    assert _short(report[1], "plain") == {("notes.txt", None): ("direct", "file_modified", 0)}


def test_a_reached_test_is_a_test(report):
    assert _short(report[1], "tests")[("tests/test_a.py", "test_f")] == ("test", "signature_changed", 1)


@pytest.mark.parametrize("name, caller", [
    ("go", ("auth/auth.go", "Login")), ("java", ("src/UserService.java", "UserService::login")), ("rust", ("src/handlers.rs", "handle")),
    ("csharp", ("app/Perm.cs", "Perm::Check")), ("typescript", ("web/task.ts", "TaskController.create"))])
def test_every_language_reaches_its_caller(report, name, caller):
    assert _short(report[1], name)[caller] == ("indirect", "signature_changed", 1)


def test_an_alias_carries_the_walk_on_and_removal_is_seen(report):
    found = _short(report[1], "typescript")
    assert found[("web/home.ts", "home")] == ("potential", "indirect_dependency", 2)
    assert found[("web/util/helper.ts", "unusedHelper")] == ("direct", "symbol_removed", 0)


def test_review_counts_obligations_only(report):
    found, _ = report
    review = I.requiring_review(found.walk.nodes, found.walk.reaches).groupBy("repo").agg(F.count("*").alias("k"))
    counted = {r["repo"]: r["k"] for r in review.collect()}
    assert counted["signature"] == 2 and "body" not in counted and counted["deleted"] == 2
