"""Diagrams as draw.io files, one a flow: lanes, nodes and edges as cells of a graph."""

from __future__ import annotations

from xml.etree import ElementTree as Xml

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import graph

#: Styles of cells, and words of conditions whose edges are dashed.
LANE_STYLE = "rounded=0;html=1;fillColor=none;strokeColor=#666666;verticalAlign=top;fontStyle=1;"
STYLES = {"process": "rounded=0;whiteSpace=wrap;html=1;", "decision": "rhombus;whiteSpace=wrap;html=1;", "end": "rounded=1;arcSize=50;whiteSpace=wrap;html=1;"}
EDGE_STYLE, DASHED = "edgeStyle=orthogonalEdgeStyle;rounded=0;html=1;", "dashed=1;"
NEGATIVE = ("否", "不符合", "不", "未", "fail")
START, END = "开始", "结束"


def drawing(title: str, lanes: list[str], nodes: list[dict], edges: list[dict]) -> bytes:
    """The file of a diagram. Nodes have id, label, kind, x, y and height; edges have src, dst and label."""
    file = Xml.Element("mxfile", host="tallystone")
    model = Xml.SubElement(Xml.SubElement(file, "diagram", id="flow", name=title or "flow"), "mxGraphModel", grid="1", gridSize="10")
    root = Xml.SubElement(model, "root")
    Xml.SubElement(root, "mxCell", id="0")
    Xml.SubElement(root, "mxCell", id="1", parent="0")

    def box(id: str, value: str, style: str, x: float, y: float, width: float, height: float) -> None:
        cell = Xml.SubElement(root, "mxCell", {"id": id, "value": value, "style": style, "vertex": "1", "parent": "1"})
        Xml.SubElement(cell, "mxGeometry", {"x": str(x), "y": str(y), "width": str(width), "height": str(height), "as": "geometry"})

    def line(id: str, src: str, dst: str, value: str) -> None:
        style = EDGE_STYLE + (DASHED if any(w in value for w in NEGATIVE) else "")
        cell = Xml.SubElement(root, "mxCell", {"id": id, "value": value, "style": style, "edge": "1", "parent": "1", "source": src, "target": dst})
        Xml.SubElement(cell, "mxGeometry", {"relative": "1", "as": "geometry"})

    bottom = max([n["y"] + n["height"] for n in nodes], default=graph.FIRST_ROW) + graph.ROW_GAP
    for i, lane in enumerate(lanes):
        box(f"lane-{i}", lane, LANE_STYLE, graph.FRAME_LEFT + i * graph.LANE_WIDTH, graph.FRAME_TOP, graph.LANE_WIDTH, bottom + 80 - graph.FRAME_TOP)
    for n in nodes:
        box(f"node-{n['id']}", n["label"], STYLES.get(n["kind"], STYLES["process"]), n["x"], n["y"], graph.NODE_WIDTH, n["height"])
    if nodes:
        box("start", START, STYLES["end"], nodes[0]["x"], graph.FRAME_TOP + 100, graph.NODE_WIDTH, 40)
        box("end", END, STYLES["end"], nodes[-1]["x"], bottom, graph.NODE_WIDTH, 40)
        line("edge-start", "start", f"node-{nodes[0]['id']}", "")
        line("edge-end", f"node-{nodes[-1]['id']}", "end", "")
    known = {n["id"] for n in nodes}
    for i, e in enumerate(edges):
        if e["src"] in known and e["dst"] in known:
            line(f"edge-{i}", f"node-{e['src']}", f"node-{e['dst']}", e["label"] or "")
    return Xml.tostring(file, encoding="utf-8", xml_declaration=True)


def drawings(nodes: DataFrame, diagram: str, order: str, node: str, label: str, lane: str, targets: str, kind: str, docs: str) -> DataFrame:
    """(name, content) of a draw.io file for each diagram, its nodes laid out by ``graph.layout``.

    Targets may be ids or structs (id, condition); a diagram is written by one task.
    """
    element = nodes.schema[targets].dataType.elementType
    plain = F.transform(F.col(targets), lambda t: t["id"].cast("string")) if hasattr(element, "fields") else F.col(targets).cast("array<string>")
    said = F.transform(F.col(targets), lambda t: F.coalesce(t["condition"], F.lit(""))) if hasattr(element, "fields") else F.transform(F.col(targets), lambda t: F.lit(""))
    rows = nodes.withColumns({"__ids": plain, "__said": said})
    placed = graph.layout(rows, diagram, order, node, lane, "__ids", kind, docs).withColumnsRenamed({"lane_no": "__lane_no", "x": "__x", "y": "__y", "height": "__height"})
    both = rows.join(placed, [diagram, order]).select(
        F.col(diagram).cast("string").alias("__d"), F.col(order).alias("__o"), F.col(node).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.trim(F.coalesce(F.col(lane), F.lit(graph.NO_LANE))).alias("lane"),
        F.col(kind).cast("string").alias("kind"), "__ids", "__said", F.col("__x").alias("x"), F.col("__y").alias("y"), F.col("__height").alias("height"),
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__o", kind="stable")
        cells = [{"id": r.id, "label": r.label or "", "kind": r.kind, "x": int(r.x), "y": int(r.y), "height": int(r.height)} for r in pdf[["id", "label", "kind", "x", "y", "height"]].itertuples()]
        edges = []
        for i, (src, ids, said) in enumerate(zip(pdf["id"], pdf["__ids"], pdf["__said"], strict=True)):
            if ids is not None:
                edges += [{"src": src, "dst": d, "label": s} for d, s in zip(ids, said, strict=True)]
            elif i + 1 < len(cells):
                edges.append({"src": src, "dst": cells[i + 1]["id"], "label": ""})
        name = pdf["__d"].iloc[0] or ""
        return pd.DataFrame({"name": [f"{name}.drawio"], "content": [drawing(name, list(dict.fromkeys(x for x in pdf["lane"] if x)), cells, edges)]})

    return both.groupBy("__d").applyInPandas(draw, "name string, content binary")
