"""Views as JSON, SVG and Excalidraw documents, one row per repository, byte for byte stable.

A view has at most forty boxes, so gathering one view in one row is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.functions.text import clip, element_id, element_seed, html_escape, wrap

FORMAT = "ripplework.evidence-graph"
VERSION = 1
PATH_CHARS, DETAIL_CHARS, PAD = 30, 40, 16.0
# A colour per state and per edge kind.
STATE_COLOURS = {"added": "#1a7f37", "removed": "#cf222e", "modified": "#0969da", "affected": "#9a6700", "context": "#656d76"}
EDGE_COLOURS = {"affects": "#9a6700", "import_added": "#1a7f37", "import_removed": "#cf222e"}
BOX, ARROW = ("path", "state", "detail", "x", "y", "width", "height"), ("points",)
#: What is drawn for a row, from the row as a struct.
Piece = Callable[[Column], Column]
TITLES = {"change": "Change map", "before-after": "Before and after"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _number(value: Column) -> Column:
    return value.cast("double").cast("decimal(18,1)").cast("string")


def _gather(nodes: DataFrame, edges: DataFrame, box: Piece, arrow: Piece, of_box: tuple[str, ...], of_arrow: tuple[str, ...],
            of_boxes: tuple[Column, ...] = (), of_arrows: tuple[Column, ...] = ()) -> DataFrame:
    """(repo, boxes, arrows): rendered pieces in drawing order, and what else is asked of them.

    Pieces are many times as long as the columns *of_box* and *of_arrow* that they are made from: these are gathered, and
    pieces made of them where they stand.
    """
    def pieces(rows: DataFrame, place: list[str], made_of: tuple[str, ...], piece: Piece, name: str, more: tuple[Column, ...]) -> DataFrame:
        held = rows.groupBy("repo").agg(F.collect_list(F.struct(*dict.fromkeys([*place, *made_of]))).alias(name), *more)
        drawn = F.array_sort(F.transform(name, lambda r: F.struct(*[r[x].alias(x) for x in place], piece(r).alias("piece"))))
        return held.withColumn(name, F.transform(drawn, lambda x: x["piece"]))

    boxes = pieces(nodes, ["place"], of_box, box, "boxes", of_boxes)
    return boxes.join(pieces(edges, ["kind", "source", "target"], of_arrow, arrow, "arrows", of_arrows), "repo", "left")


def to_json(view: str, nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    """(repo, document): a view in its declared key order."""
    of_box, of_arrow = ("path", "state", "distance", "detail", "link"), ("source", "target", "kind", "evidence")

    def box(r: Column) -> Column:
        return F.struct(r["path"].alias("id"), *[r[name].alias(name) for name in of_box])

    def arrow(r: Column) -> Column:
        return F.struct(*[r[name].alias(name) for name in of_arrow])

    gathered = _gather(nodes, edges, box, arrow, of_box, of_arrow).join(omitted, "repo", "left")
    document = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(view).alias("view"),
        F.lit(TITLES[view]).alias("title"), F.col("repo").alias("repository"),
        F.coalesce("omitted", F.lit(0)).alias("omitted"), F.col("boxes").alias("nodes"),
        F.coalesce("arrows", F.array()).alias("edges"))
    return gathered.select("repo", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def empty_document(view: str, kind: str, repo: str) -> str:
    """What an export says when its view has no node: a document that opens and explains itself."""
    title = f"{TITLES[view]} — {repo}"
    if kind == "svg":
        shown = escape(title)
        return (f'<svg xmlns="http://www.w3.org/2000/svg" width="560.0" height="80.0" viewBox="0 0 560 80" role="img"><title>{shown}</title>'
                f'<text x="12" y="26" font-size="11">{shown}</text><text x="12" y="46" font-size="10">There is nothing to draw.</text></svg>')
    if kind == "json":
        return json.dumps({"format": FORMAT, "version": VERSION, "view": view, "title": TITLES[view], "repository": repo,
                           "omitted": 0, "nodes": [], "edges": []}, ensure_ascii=False)
    return json.dumps({"type": "excalidraw", "version": 2, "source": "ripplework", "elements": [],
                       "appState": {"viewBackgroundColor": "#ffffff"}, "files": {}})


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph, uncapped, as one JSON line per node and per edge."""
    lines = nodes.select("repo", F.lit("node").alias("part"), F.to_json(F.struct("path", "state", "distance", "detail", "link")).alias("line"))
    return lines.unionByName(edges.select(
        "repo", F.lit("edge").alias("part"), F.to_json(F.struct("source", "target", "kind", "evidence")).alias("line")))


def to_svg(view: str, boxes: DataFrame, routes: DataFrame, omitted: DataFrame) -> DataFrame:
    """(repo, document): a view drawn; a repository without nodes has no row."""
    def text(x: Column, y: Column, size: int, fill: Column, words: Column) -> Column:
        return F.concat(F.lit('<text x="'), _number(x + 10), F.lit('" y="'), _number(y),
                        F.lit(f'" font-size="{size}" fill="'), fill, F.lit('">'), html_escape(words), F.lit("</text>"))

    def box(r: Column) -> Column:
        colour, x, y = _lookup(STATE_COLOURS, r["state"]), r["x"], r["y"]
        return F.concat(
            F.lit("<g><title>"), html_escape(F.concat_ws(" — ", r["path"], r["state"])), F.lit("</title>"),
            F.lit('<rect x="'), _number(x), F.lit('" y="'), _number(y), F.lit('" width="'), _number(r["width"]),
            F.lit('" height="'), _number(r["height"]), F.lit('" rx="8" fill="#ffffff" stroke="'), colour, F.lit('"/>'),
            text(x, y + 18, 9, colour, F.upper(r["state"])), text(x, y + 38, 11, F.lit("#1f2328"), clip(r["path"], PATH_CHARS)),
            F.when(F.coalesce(r["detail"], F.lit("")) != "", text(x, y + 56, 10, F.lit("#656d76"), clip(r["detail"], DETAIL_CHARS))).otherwise(""),
            F.lit("</g>"))

    def arrow(r: Column) -> Column:
        def at(n: int) -> Column:
            p = F.get(r["points"], F.lit(n))
            return F.concat(_number(p["x"]), F.lit(","), _number(p["y"]))

        return F.concat(
            F.lit('<path fill="none" stroke="'), _lookup(EDGE_COLOURS, r["kind"]), F.lit('" d="M'), at(0), F.lit(" C"), at(1), F.lit(" "),
            at(2), F.lit(" "), at(3), F.lit('"/>'))

    extent = F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")
    low = F.max(F.array_max(F.transform("points", lambda p: p["y"]))).alias("low")
    gathered = _gather(boxes, routes, box, arrow, BOX, ARROW, extent, (low,)).join(omitted, "repo", "left")
    width = _number(F.col("right") + 2 * PAD)
    height = _number(F.greatest("bottom", F.coalesce("low", F.lit(0.0))) + 2 * PAD)
    left_out = F.when(F.col("omitted") > 0, F.concat(F.lit(" "), F.col("omitted").cast("string"), F.lit(" further node(s) are not drawn."))).otherwise("")
    return gathered.select("repo", F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), width, F.lit('" height="'), height,
        F.lit(f'" viewBox="-{PAD:.1f} -{PAD:.1f} '), width, F.lit(" "), height, F.lit('" role="img"><title>'), F.lit(f"{TITLES[view]} — "),
        html_escape("repo"), F.lit("</title><desc>"), F.lit(TITLES[view] + "."), left_out, F.lit("</desc>"),
        F.array_join(F.coalesce("arrows", F.array().cast("array<string>")), ""), F.array_join("boxes", ""), F.lit("</svg>"),
    ).alias("document"))


def _element(kind: str, key: Column, x: Column, y: Column, width: Column, height: Column, colour: Column, **extra: Column) -> Column:
    """The fields every drawing element carries, spelled out; identity gives id and seed."""
    return F.to_json(F.struct(
        element_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"),
        F.round(width, 2).alias("width"), F.round(height, 2).alias("height"), F.lit(0).alias("angle"),
        colour.alias("strokeColor"), F.lit("transparent").alias("backgroundColor"), F.lit("solid").alias("fillStyle"),
        F.lit(1).alias("strokeWidth"), F.lit("solid").alias("strokeStyle"), F.lit(1).alias("roughness"), F.lit(100).alias("opacity"),
        F.array().cast("array<string>").alias("groupIds"), element_seed(key).alias("seed"), F.lit(1).alias("version"),
        element_seed(key).alias("versionNonce"), F.lit(False).alias("isDeleted"), F.lit(False).alias("locked"),
        *[value.alias(name) for name, value in extra.items()]))


def to_excalidraw(view: str, boxes: DataFrame, routes: DataFrame, omitted: DataFrame) -> DataFrame:
    """(repo, document): the same view as an editable drawing."""
    def box(r: Column) -> Column:
        colour = _lookup(STATE_COLOURS, r["state"])
        words = F.concat_ws("\n", F.upper(r["state"]), clip(r["path"], PATH_CHARS), F.when(r["detail"] != "", clip(r["detail"], DETAIL_CHARS)))
        return F.concat_ws(
            ",", _element("rectangle", r["path"], r["x"], r["y"], r["width"], r["height"], colour),
            _element("text", r["path"], r["x"] + 10, r["y"] + 8, r["width"] - 20, r["height"] - 16, colour,
                     text=words, fontSize=F.lit(12), fontFamily=F.lit(3), textAlign=F.lit("left"), verticalAlign=F.lit("top")))

    def arrow(r: Column) -> Column:
        first, last = F.get(r["points"], F.lit(0)), F.get(r["points"], F.lit(3))
        key = F.concat_ws("|", r["source"], r["target"], r["kind"])
        shifted = F.transform(r["points"], lambda p: F.array(p["x"] - first["x"], p["y"] - first["y"]))
        return _element("arrow", key, first["x"], first["y"], F.abs(last["x"] - first["x"]), F.abs(last["y"] - first["y"]),
                        _lookup(EDGE_COLOURS, r["kind"]), points=shifted, endArrowhead=F.lit("arrow"))

    gathered = _gather(boxes, routes, box, arrow, BOX, ARROW).join(omitted, "repo", "left")
    caption = wrap(F.concat(F.col("repo"), F.lit(f" — {TITLES[view]}. "), F.when(
        F.col("omitted") > 0, F.concat(F.col("omitted").cast("string"), F.lit(" further node(s) are not drawn."))).otherwise("")))
    header = _element("text", F.lit(f"header:{view}"), F.lit(0.0), F.lit(-60.0), F.lit(600.0), F.lit(30.0), F.lit("#1f2328"),
                      text=F.array_join(caption, "\n"), fontSize=F.lit(12), fontFamily=F.lit(3))
    elements = F.concat_ws(",", header, F.array_join("boxes", ","), F.array_join("arrows", ","))
    return gathered.select("repo", F.concat(
        F.lit('{"type":"excalidraw","version":2,"source":"ripplework","elements":['), elements,
        F.lit('],"appState":{"viewBackgroundColor":"#ffffff"},"files":{}}')).alias("document"))
