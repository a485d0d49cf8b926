"""The evidence graph of a delivery, its capped views, and their layout.

A view holds at most forty nodes per repository, so everything after :func:`capped` works on
arrays of proven size; everything before it is joins and aggregations over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework import model
from ripplework.functions.text import session_url
from ripplework.functions.wording import impact_detail, is_obligation, reach_detail, reason_label
from ripplework.session import cut_lineage

FILE_STATES = {"added": "added", "deleted": "removed"}
# Box geometry.
WIDTH, HEIGHT, COLUMN_GAP, ROW_GAP, DIP, BOW = 236.0, 64.0, 72.0, 16.0, 30.0, 28.0


def _rank(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _report_place() -> Column:
    return F.struct(
        _rank(model.CATEGORY_RANK, F.col("category")).alias("c"), F.col("distance").alias("d"),
        _rank(model.CONFIDENCE_RANK, F.col("confidence")).alias("k"), F.col("path").alias("p"),
        F.coalesce("symbol", F.lit("")).alias("s"))


_NO_PLACE = "struct<c:int,d:int,k:int,p:string,s:string>"


def evidence_graph(files: DataFrame, module_changes: DataFrame, edge_changes: DataFrame, nodes: DataFrame,
                   reaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the evidence graph.

    *files* is (repo, path, status, detail); *module_changes* (repo, path, change);
    *edge_changes* (repo, source_path, target_path, module, line, change). A path that comes
    from several relations is one node: the strongest state, the first description, the
    smallest distance.
    """
    # Both are read by several of the passes below; computed once each.
    nodes = cut_lineage(nodes.select("repo", "path", "symbol", "category", "reason", "distance", "confidence", "chain"))
    reaches = cut_lineage(reaches.select("repo", "path", "symbol", "category", "reason", "distance", "confidence", "chain"))
    empty = F.lit(None).cast(_NO_PLACE)

    def seen(frame: DataFrame, step: int, state: Column, detail: Column, place: Column = empty,
             distance: Column | None = None) -> DataFrame:
        return frame.select(
            "repo", "path", F.struct(F.lit(step).alias("step"), place.alias("place")).alias("position"),
            _rank(model.STATE_RANK, state).alias("state_rank"), detail.cast("string").alias("detail"),
            (F.lit(None).cast("int") if distance is None else distance.cast("int")).alias("distance"))

    file_state = F.coalesce(_rank({k: v for k, v in FILE_STATES.items()}, F.col("status")), F.lit("modified"))
    from_files = seen(files, 0, file_state, F.col("detail"))
    added = F.col("change") == "module_added"
    from_modules = seen(
        module_changes, 1, F.when(added, "added").otherwise("removed"),
        F.when(added, "added by this session").otherwise("removed by this session"))
    from_walk = seen(
        nodes, 2, F.when(F.col("distance") > 0, "affected").otherwise("modified"),
        impact_detail(F.col("category"), F.col("reason"), F.col("distance")), _report_place(), F.col("distance"))

    hops = _hops(nodes, "own").unionByName(_hops(reaches, "reach"))
    removed = nodes.select("repo", "reason", "chain").unionByName(reaches.select("repo", "reason", "chain")).where(
        "reason = 'dangling_import'").groupBy("repo", F.get("chain", F.lit(0)).alias("path")).agg(F.count("*").alias("k"))
    from_removals = seen(removed, 3, F.lit("removed"), F.concat(
        F.lit("removed by this session; still imported by "), F.col("k").cast("string"), F.lit(" file(s)")))

    affects = hops.where("source <> target").groupBy("repo", "source", "target").agg(F.count("*").alias("evidence")).withColumn(
        "kind", F.lit("affects"))
    structural = edge_changes.groupBy(
        "repo", F.col("source_path").alias("source"), F.col("target_path").alias("target"), F.col("change").alias("kind")).agg(
        F.count("*").alias("evidence")).where("source <> target")
    edges = cut_lineage(affects.unionByName(structural.select(affects.columns)))
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("path")).distinct()
    from_ends = seen(ends, 4, F.lit("context"), F.lit(""))

    arrivals = from_files.unionByName(from_modules).unionByName(from_walk).unionByName(from_removals).unionByName(from_ends)
    merged = arrivals.groupBy("repo", "path").agg(
        F.min("state_rank").alias("state_rank"), F.min_by("detail", "position").alias("detail"), F.min("distance").alias("distance"))

    labels = (
        reaches.select("repo", "path", reason_label(F.col("reason"), F.col("distance")).alias("label"),
                       F.struct((~is_obligation(F.col("reason"))).alias("possible"), _report_place().alias("place")).alias("position"))
        .groupBy("repo", "path", "label").agg(F.min("position").alias("position"))
        # At most one label per reason word, so this list is as long as the vocabulary.
        .groupBy("repo", "path").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("labels")))
    inside = hops.where("source = target").groupBy("repo", F.col("target").alias("path")).agg(F.count("*").alias("inside"))
    note = F.concat(F.col("inside").cast("string"), F.lit(" affected inside this file"))
    detail = (
        F.when(F.col("labels").isNotNull(), reach_detail(F.col("labels"), F.col("detail")))
        .when(F.col("inside").isNotNull(), F.concat_ws(" · ", F.when(F.col("detail") != "", F.col("detail")), note))
        .otherwise(F.col("detail")))
    states = F.array(*[F.lit(name) for name in model.STATE_RANK])
    state = F.get(states, F.col("state_rank"))
    changed = F.col("state_rank") <= 2
    graph_nodes = merged.join(labels, ["repo", "path"], "left").join(inside, ["repo", "path"], "left").select(
        "repo", "path", state.alias("state"), "state_rank", "distance", detail.alias("detail"),
        session_url("repo", F.when(changed, F.concat(F.lit("/diff/"), "path")).otherwise("/evidence")).alias("link"))
    return graph_nodes, edges


def chain_edges(chain: Column) -> Column:
    """Consecutive pairs of a chain."""
    n = F.size(chain)
    return F.when(n > 1, F.zip_with(
        F.slice(chain, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chain, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("source"), b.alias("target")))).otherwise(
        F.array().cast("array<struct<source:string,target:string>>"))


def _hops(frame: DataFrame, origin: str) -> DataFrame:
    return frame.select("repo", F.explode(chain_edges(F.col("chain"))).alias("hop")).select(
        "repo", "hop.source", "hop.target", F.lit(origin).alias("origin"))


def symbols_of(files_symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, path, symbol): names drawn on a file, from its changes and from the walk."""
    walked = nodes.where("symbol is not null").select("repo", "path", F.substring_index("symbol", ".", -1).alias("symbol"))
    return files_symbols.select("repo", "path", "symbol").unionByName(walked).distinct()


def change_map(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What changed and what it reaches, with the arrows the walk followed."""
    drawn = edges.where("kind = 'affects'")
    return capped(_touched(nodes, drawn, F.col("state") != "context"), drawn)


def before_after(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The import relationships a session added and removed."""
    drawn = edges.where("kind in ('import_added', 'import_removed')")
    return capped(_touched(nodes, drawn, F.lit(False)), drawn)


def _touched(nodes: DataFrame, edges: DataFrame, own: Column) -> DataFrame:
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("path")).distinct().withColumn("end", F.lit(True))
    return nodes.join(ends, ["repo", "path"], "left").where(own | F.col("end")).drop("end")


def capped(nodes: DataFrame, edges: DataFrame, limit: int = model.MAX_MAP_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted): the nearest *limit* nodes per repository and what was left out.

    Spark applies the rank limit before the shuffle too, so a repository with most of the
    nodes sends no more than *limit* per task.
    """
    place = Window.partitionBy("repo").orderBy("state_rank", F.coalesce("distance", F.lit(0)), "path")
    # Views, their layers and their boxes are each read by several later passes; computed once each.
    kept = cut_lineage(nodes.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit))
    omitted = nodes.groupBy("repo").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    # A view's paths are one row of proven size, so an edge meets both its ends in one join.
    shown = kept.groupBy("repo").agg(F.collect_set("path").alias("shown"))
    drawn = edges.join(shown, "repo").where(F.array_contains("shown", F.col("source")) & F.array_contains("shown", F.col("target"))).select(
        "repo", "target", "source", *[name for name in edges.columns if name not in ("repo", "source", "target")])
    return kept, cut_lineage(drawn), omitted


# --------------------------------------------------------------------------------- layout


def layer_ranks(count: Column, edges: Column) -> Column:
    """A column per node: the longest path from a node nothing points at.

    Nodes are the numbers below *count*, *edges* structs (s, t). Each round places the nodes
    whose predecessors all have a column; the round number is the longest path. What a cycle
    holds back is placed node by node after its deepest placed predecessor.
    """
    unplaced = F.transform(F.sequence(F.lit(1), count), lambda _: F.lit(-1))

    def one_round(ranks: Column, n: Column) -> Column:
        waiting = F.array_distinct(F.transform(F.filter(edges, lambda e: F.get(ranks, e["s"]) < 0), lambda e: e["t"]))
        return F.transform(ranks, lambda r, i: F.when(r >= 0, r).when(~F.array_contains(waiting, i), n).otherwise(F.lit(-1)))

    placed = F.aggregate(F.sequence(F.lit(0), count - 1), unplaced, one_round)

    def one_node(ranks: Column, i: Column) -> Column:
        before = F.array_max(F.transform(
            F.filter(edges, lambda e: (e["t"] == i) & (F.get(ranks, e["s"]) >= 0)), lambda e: F.get(ranks, e["s"])))
        own = F.coalesce(before, F.array_max(ranks)) + 1
        return F.when(F.get(ranks, i) >= 0, ranks).otherwise(F.transform(ranks, lambda r, j: F.when(j == i, own).otherwise(r)))

    return F.when(F.exists(placed, lambda r: r < 0), F.aggregate(F.sequence(F.lit(0), count - 1), placed, one_node)).otherwise(placed)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """*nodes* of capped views with ``layer``. A view has at most forty nodes per repository."""
    views = nodes.groupBy("repo").agg(F.collect_list(F.struct(*nodes.columns)).alias("view"))
    arrows = edges.where("source <> target").groupBy("repo").agg(F.collect_set(F.struct("source", "target")).alias("arrows"))

    def numbers(path: Column) -> Column:
        return F.transform(F.filter("view", lambda n: n["path"] == path), lambda n: n["place"] - 1)

    none = F.array().cast("array<struct<source:string,target:string>>")
    pairs = F.flatten(F.transform(F.coalesce("arrows", none), lambda e: F.flatten(F.transform(
        numbers(e["source"]), lambda s: F.transform(numbers(e["target"]), lambda t: F.struct(s.alias("s"), t.alias("t")))))))
    # One step each, so that pairs and ranks are made once a view and not once a node.
    paired = views.where("repo is not null").join(arrows, "repo", "left").select("repo", "view", pairs.alias("pairs"))
    ranked = paired.select("repo", F.explode(F.array(F.struct("view", layer_ranks(F.size("view"), F.col("pairs")).alias("ranks")))).alias("v"))
    rows = ranked.select("repo", F.explode("v.view").alias("n"), F.col("v.ranks").alias("ranks"))
    return cut_lineage(rows.select(
        "repo", *[F.col(f"n.{name}").alias(name) for name in nodes.columns if name != "repo"],
        F.get("ranks", F.col("n.place") - 1).alias("layer")).where("layer is not null"))


def placed(layered: DataFrame) -> DataFrame:
    """Boxes with coordinates: a column per layer, centred on the tallest column."""
    column = Window.partitionBy("repo", "layer").orderBy("state_rank", "path")
    whole = Window.partitionBy("repo")
    size = F.count("*").over(Window.partitionBy("repo", "layer"))
    # All three windows are within a repository: dealt by it, boxes travel once.
    stacked = layered.repartition("repo").withColumn("row", F.row_number().over(column) - 1).withColumn(
        "stack", size * HEIGHT + (size - 1) * ROW_GAP)
    tallest = F.max("stack").over(whole)
    return cut_lineage(stacked.select(
        *layered.columns, (F.col("layer") * (WIDTH + COLUMN_GAP)).alias("x"),
        ((tallest - F.col("stack")) / 2 + F.col("row") * (HEIGHT + ROW_GAP)).alias("y"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")))


def routed(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with four points: a curve forward, a detour below the boxes otherwise."""
    at = boxes.groupBy("repo").agg(F.collect_list(F.struct("path", "x", "y")).alias("at"))

    def boxes_at(end: str) -> Column:
        return F.explode(F.filter("at", lambda box: box["path"] == F.col(end)))

    joined = edges.join(at, "repo").withColumn("from", boxes_at("source")).withColumn("to", boxes_at("target")).select(
        *edges.columns, F.col("from.x").alias("sx"), F.col("from.y").alias("sy"), F.col("to.x").alias("tx"), F.col("to.y").alias("ty"))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    right, s_mid, t_mid = F.col("sx") + WIDTH, F.col("sy") + HEIGHT / 2, F.col("ty") + HEIGHT / 2
    bow = F.greatest(F.lit(BOW), (F.col("tx") - right) / 2)
    forward = F.array(point(right, s_mid), point(right + bow, s_mid), point(F.col("tx") - bow, t_mid), point(F.col("tx"), t_mid))
    bottom = F.greatest(F.col("sy"), F.col("ty")) + HEIGHT + DIP
    s_x, t_x = F.col("sx") + WIDTH / 2, F.col("tx") + WIDTH / 2
    below = F.array(point(s_x, F.col("sy") + HEIGHT), point(s_x, bottom), point(t_x, bottom), point(t_x, F.col("ty") + HEIGHT))
    ahead = F.col("tx") > right + 4.0
    label = F.when(ahead, point((right + F.col("tx")) / 2, (s_mid + t_mid) / 2)).otherwise(point((s_x + t_x) / 2, bottom))
    return joined.select(*edges.columns, F.when(ahead, forward).otherwise(below).alias("points"), label.alias("label_at"))


def graph_notes(units: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(repo, position, note): what the map cannot show."""
    def note(position: int, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(position).alias("position"), text.alias("note")))

    rules = F.array_compact(F.array(
        note(1, F.coalesce("truncated", F.lit(False)), F.concat(
            F.lit("The impact walk stopped at depth "), F.col("max_depth").cast("string"), F.lit(", so files further out are not on this map."))),
        note(2, F.coalesce("unresolved_imports", F.lit(0)) > 0, F.concat(
            F.col("unresolved_imports").cast("string"), F.lit(" import(s) point outside the repository and are not drawn."))),
        note(3, F.coalesce("parse_errors", F.lit(0)) > 0, F.concat(
            F.col("parse_errors").cast("string"), F.lit(" file(s) could not be parsed and have no place on this map.")))))
    found = units.select("repo", F.explode(rules).alias("n")).select("repo", "n.*")
    if external is None:
        return found
    place = Window.partitionBy("repo").orderBy("module")
    distinct = external.select("repo", "module").distinct()
    shown = distinct.withColumn("r", F.row_number().over(place)).where("r <= 3").groupBy("repo").agg(
        F.array_sort(F.collect_list("module")).alias("names"))
    total = distinct.groupBy("repo").agg(F.count("*").alias("k"))
    outside = shown.join(total, "repo").select(
        "repo", F.lit(4).alias("position"), F.concat(
            F.lit("Imported but not in this repository: "), F.array_join("names", ", "),
            F.when(F.col("k") > 3, F.concat(F.lit(" and "), (F.col("k") - 3).cast("string"), F.lit(" more"))).otherwise(""),
            F.lit(".")).alias("note"))
    return found.unionByName(outside)


