"""The ring walk against a call-by-call simulation, on shuffled inputs."""

import random

import pytest
from pyspark.sql import functions as F

from ripplework.operators import impact as I

CALLS = ("repo string, source string, line int, call_name string, ordinal int, target string, confidence string, caller string, "
         "name_position int, name string")
CHANGES = "repo string, path string, qualified_name string, change string, line_start int, detail string"


def simulate(changes, calls, depth):
    """One frontier entry, one source and one call after the other, as a reader would."""
    nodes = {(c[1], c[2]): (0, f"symbol_{c[3]}") for c in changes}
    reaches = {}
    kinds = {"signature_changed": "signature_changed", "removed": "symbol_removed", "body_changed": "body_changed"}
    frontier = [(c[1], c[2], kinds[c[3]], 0) for c in sorted(changes, key=lambda c: (c[1], c[4], c[2])) if c[3] != "added"]
    truncated = False
    for ring in range(1, depth + 2):
        if not frontier:
            break
        if ring > depth:
            truncated = True
            break
        following = []
        for path, name, reason, distance in frontier:
            sources = [path] + sorted({c[1] for c in calls if c[5] == path and c[1] != path})
            for source in sources:
                for call in sorted((c for c in calls if c[1] == source and c[5] == path), key=lambda c: (c[2], c[3], c[4])):
                    if name is not None and call[9] != name:
                        continue
                    if name is None and call[8] != 0:
                        continue
                    key = (source, call[7])
                    if key in nodes:
                        reaches.setdefault((*key, reason), (distance + 1, 0))
                        at, n = reaches[(*key, reason)]
                        reaches[(*key, reason)] = (at, n + 1)
                    else:
                        nodes[key] = (distance + 1, reason)
                        following.append((source, call[7], "indirect_dependency", distance + 1))
        frontier = following
    return nodes, reaches, truncated


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_walk_meets_calls_in_reading_order(spark, seed):
    rng = random.Random(seed)
    files = [f"m{n}.py" for n in range(12)]
    symbols = ["f", "g", None]
    calls = []
    for ordinal in range(70):
        source, target = rng.choice(files), rng.choice(files)
        calls.append(("r", source, rng.randint(1, 9), f"c{rng.randint(0, 3)}", ordinal, target, "confirmed", rng.choice(symbols), 0, rng.choice("fg")))
    changed = [("r", path, name, rng.choice(["signature_changed", "removed", "body_changed", "added"]), rng.randint(1, 5), "d")
               for path in rng.sample(files, 3) for name in "fg"]
    depth = rng.choice([2, 5])
    nodes, reaches, truncated = simulate(changed, calls, depth)

    rng.shuffle(calls)
    changes = spark.createDataFrame(changed, CHANGES).repartition(3)
    listed = changes.selectExpr("repo", "path", "'modified' as status", "true as analysed").distinct()
    none = spark.createDataFrame([], "repo string, path string, added bigint, removed bigint")
    found = I.walk(I.direct_nodes(listed, changes, none), I.seeds_of(changes), spark.createDataFrame(calls, CALLS).repartition(5), depth)
    got = {(r["path"], r["symbol"]): (r["distance"], r["reason"]) for r in found.nodes.collect()}
    assert got == nodes
    assert {(r["path"], r["symbol"], r["reason"]): (r["distance"], r["arrivals"]) for r in found.reaches.collect()} == reaches
    assert (found.truncated.count() > 0) == truncated


def test_only_rows_that_meet_a_key_stay(spark):
    """A ring moves the rows its frontier may reach, not all calls; nulls and every true match stay."""
    rows = spark.range(20000).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.when(F.col("id") % 2 == 0, "x").alias("name"))
    keys = rows.where("path % 500 = 0")
    kept = I.candidates(rows, keys, ["repo", "path", "name"])
    assert kept.columns == rows.columns
    assert kept.join(keys, ["repo", "path"], "left_semi").count() == keys.count() == 40
    assert kept.count() < 3000
    assert I.candidates(rows, keys.limit(0), ["repo", "path", "name"]).isEmpty()


def test_a_walk_looks_up_the_edges_of_the_calls_it_meets(spark):
    """With edges given to the walk, a call into another file counts only along one; within a file always."""
    change = spark.createDataFrame([("r", "a.py", "f", "signature_changed", 1, "d")], "repo string, path string, qualified_name string, change string, line_start int, detail string")
    listed = spark.createDataFrame([("r", "a.py", "modified", True)], "repo string, path string, status string, analysed boolean")
    none = spark.createDataFrame([], "repo string, path string, added bigint, removed bigint")
    called = spark.createDataFrame(
        [("r", s, 1, "f", 0, "a.py", ["f"], "confirmed", c) for s, c in (("b.py", "g"), ("c.py", None), ("d.py", "h"), ("a.py", "own"))]
        + [("r", "e.py", 2, "c", 0, "c.py", ["anything"], "confirmed", "late")],
        "repo string, path string, line int, name string, ordinal int, target string, names array<string>, confidence string, caller string")
    edges = spark.createDataFrame([("r", "b.py", "a.py"), ("r", "c.py", "a.py"), ("r", "e.py", "c.py")], "repo string, source_path string, target_path string")
    direct, seeds = I.direct_nodes(listed, change, none), I.seeds_of(change)
    lazily = I.walk(direct, seeds, I.walkable_calls(called), 5, edges).nodes
    assert {(x.path, x.symbol, x.distance) for x in lazily.collect()} == {
        ("a.py", "f", 0), ("a.py", "own", 1), ("b.py", "g", 1), ("c.py", None, 1), ("e.py", "late", 2)}
    assert sorted(map(str, lazily.collect())) == sorted(map(str, I.walk(direct, seeds, I.walkable_calls(called, edges), 5).nodes.collect()))


def test_a_ring_carries_what_a_route_is_told_from(spark):
    """Neither chain nor evidence is shuffled with every arrival; both are told in full, also past an entry without a name."""
    change = spark.createDataFrame([("r", "a.py", "f", "removed", None, "was f")], CHANGES)
    listed = spark.createDataFrame([("r", "a.py", "modified", True)], "repo string, path string, status string, analysed boolean")
    none = spark.createDataFrame([], "repo string, path string, added bigint, removed bigint")
    calls = spark.createDataFrame(
        [("r", "b.py", 3, "a.f", 0, "a.py", "confirmed", None, 0, "f"), ("r", "c.py", 5, "b.any", 1, "b.py", "inferred", "g", 0, "any"),
         ("r", "c.py", 7, "b.two", 2, "b.py", "confirmed", "g", 0, "two")], CALLS)
    seeds = I.seeds_of(change)
    entries = seeds.select("repo", "path", "name", "propagation", "ord", F.array().cast("array<string>").alias("trail"), F.col("evidence").alias("origin"))
    assert not {"chain", "evidence", "category", "reason"} & set(I._arrivals(entries, calls).columns)
    found = I.walk(I.direct_nodes(listed, change, none), seeds, calls)
    last = found.nodes.where("path = 'c.py'").first()
    assert (last.category, last.reason, last.confidence, last.chain) == ("potential", "indirect_dependency", "inferred", ["a.py", "b.py", "c.py"])
    assert [tuple(e) for e in last.evidence] == [
        ("symbol_change", "a.py", None, "was f"), ("call_expression", "b.py", 3, "a.f reaches a.py#f"), ("call_expression", "c.py", 5, "b.any reaches b.py#any")]
    again = found.reaches.first()
    assert (again.path, again.symbol, again.reason, again.category, again.confidence, again.chain, again.arrivals) == (
        "c.py", "g", "indirect_dependency", "potential", "confirmed", ["a.py", "b.py", "c.py"], 1)
    assert {e.detail for e in found.evidence.where("reach_reason is not null").collect()} == {"was f", "a.f reaches a.py#f", "b.two reaches b.py#two"}
