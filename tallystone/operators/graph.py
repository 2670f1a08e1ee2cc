"""Ownership and process graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.session import checkpointed


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """Nodes reached from the roots and their smallest depth; cycles end as nodes are visited once.

    Edges and each level are checkpointed, so a level reads the one before it
    and no level is derived twice; it ends early where a level is empty.
    """
    edges = checkpointed(edges.select("parent", "child"))
    front = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: duplicate ids, dangling edges, isolated nodes, mutual edges and a score."""
    duplicates = nodes.groupBy("node").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_duplicates"))
    ids = nodes.select("node").distinct()
    dangling = edges.join(ids, edges["dst"] == ids["node"], "left_anti").agg(F.count(F.lit(1)).alias("n_dangling"))
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    isolated = ids.join(ends, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_isolated"))
    loops = mutual(edges).agg(F.count(F.lit(1)).alias("n_mutual"))
    one = duplicates.join(F.broadcast(dangling)).join(F.broadcast(isolated)).join(F.broadcast(loops))  # single rows
    score = F.greatest(F.lit(0), 100 - 20 * (F.col("n_duplicates") + F.col("n_dangling")) - 5 * (F.col("n_isolated") + F.col("n_mutual")))
    return one.withColumn("score", score.cast("long"))


#: Fields that every node of a diagram has to have, and its types.
NODE_FIELDS = ["id", "step", "type", "swimlane_role", "node_role"]
NODE_TYPES = ["process", "decision"]


def field_errors(nodes: DataFrame, key: str, targets: str) -> DataFrame:
    """(key, error) once for each fault of a node's fields: null fields, unknown types, blank steps and roles, null and blank targets.

    ``key`` names the row, as a node's own id may be what is missing. Row-wise, no shuffle.
    """
    blank = lambda c: F.trim(c) == ""
    faults = [F.when(F.col(f).isNull(), F.lit(f"null {f}")) for f in NODE_FIELDS]
    faults += [F.when(~F.col("type").isin(NODE_TYPES), F.lit("unknown type"))] + [F.when(blank(F.col(f)), F.lit(f"blank {f}")) for f in ("step", "swimlane_role")]
    ends = F.transform(F.coalesce(F.col(targets), F.array().cast(nodes.schema[targets].dataType)), lambda x: F.when(x.isNull(), "null target").when(blank(x.cast("string")), "blank target"))
    return nodes.select(key, F.explode(F.array_compact(F.concat(F.array(*faults), ends))).alias("error"))


def isolated(nodes: DataFrame, diagram: str, order: str, node: str, targets: str) -> DataFrame:
    """(diagram, node) of nodes without targets that none points to; not the first and the last, and none in diagrams of fewer than three."""
    named = nodes.select(diagram, F.explode(targets).alias(node)).distinct()
    ends = nodes.groupBy(diagram).agg(F.min(order).alias("__first"), F.max(order).alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n >= 3")
    loose = nodes.where(F.size(F.coalesce(F.col(targets), F.array().cast(nodes.schema[targets].dataType))) == 0).join(named, [diagram, node], "left_anti")
    return loose.join(ends, diagram).where((F.col(order) != F.col("__first")) & (F.col(order) != F.col("__last"))).select(diagram, node)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs of nodes with edges both ways, the smaller first."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return pairs.groupBy("a", "b").agg(F.max("up").alias("up"), F.min("up").alias("down")).where("up and not down").select("a", "b")


def lanes(nodes: DataFrame, lane: str, order: str, rows_a_range: int = 1 << 20) -> DataFrame:
    """Swim lanes in order of first appearance, and each node's row in its lane.

    Lanes are few; a lane may hold any share of the nodes. It is cut at
    approximate quantiles of ``order`` (a number or time) into ranges, rows are numbered inside
    a range, and the ranges' sizes are summed before them, so no task holds a lane.
    Approximate quantiles may differ from one run to the next, so they are kept before use.
    """
    n = max(1, min(10_000, nodes.count() // rows_a_range))
    cuts = F.percentile_approx(order, [k / n for k in range(1, n)]) if n > 1 else F.array().cast(f"array<{nodes.schema[order].dataType.simpleString()}>")
    first = nodes.groupBy(lane).agg(F.min(order).alias("__first"), (cuts if n > 1 else F.first(cuts)).alias("__cuts"))
    numbered = F.broadcast(checkpointed(first.withColumn("lane_no", F.row_number().over(Window.orderBy("__first")))))  # a row for each lane
    ranged = nodes.join(numbered, lane).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts", "__first")
    before = Window.partitionBy(lane).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(lane, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(lane, "__range").orderBy(order)))
    return rows.join(offsets, [lane, "__range"]).withColumn("row_no", F.col("__before") + F.col("__k")).drop("__range", "__k", "__before")


def next_edges(nodes: DataFrame, diagram: str, order: str, node: str, targets: str) -> DataFrame:
    """Edges (diagram, src, dst): the stated targets, or the next node where none are stated (null, not empty)."""
    after = F.lead(node).over(Window.partitionBy(diagram).orderBy(order))
    implied = F.when(after.isNotNull(), F.array(after)).otherwise(F.array().cast(nodes.schema[targets].dataType))
    rows = nodes.select(diagram, F.col(node).alias("src"), F.coalesce(F.col(targets), implied).alias("__t"))
    return rows.select(diagram, "src", F.explode("__t").alias("dst"))


def row_offsets(nodes: DataFrame, diagram: str, row: str, height: str, gap: int) -> DataFrame:
    """Height of each row (its tallest node) and where it begins, one gap after the row above."""
    tall = nodes.groupBy(diagram, row).agg(F.max(height).alias("row_height"))
    above = Window.partitionBy(diagram).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return tall.withColumn("y", F.coalesce(F.sum(F.col("row_height") + gap).over(above), F.lit(0)))


def penetrate(edges: DataFrame, roots: DataFrame, threshold: float = 50.0, max_depth: int = 5) -> DataFrame:
    """``reach`` over edges (parent, child, ratio) whose ratio, a percentage as text, is the threshold or more."""
    from tallystone.functions.numbers import parse_ratio

    return reach(edges.where(parse_ratio(F.col("ratio")) >= threshold).select("parent", "child"), roots, max_depth)


#: Sizes of a diagram's parts, and the lane of nodes that name none.
LANE_WIDTH, FRAME_LEFT, FRAME_TOP, NODE_WIDTH = 280, 40, 40, 120
ROLE_HEIGHT, STEP_HEIGHT, DOC_HEIGHT, DECISION_HEIGHT, ROW_GAP = 30, 40, 40, 60, 100
FIRST_ROW = FRAME_TOP + 60 + 40 + 80
NO_LANE = "未定义部门"


def place_rows(lanes: list[int], before: list[list[int]]) -> list[int]:
    """The row of every node of a diagram, in the nodes' order.

    ``lanes`` numbers each node's lane, ``before`` lists the nodes with an edge to
    it. A node joins the row at hand unless its lane is taken there, or an edge
    from a node of the row would pass through a taken lane; then a row begins.
    """
    rows: list[int] = []
    row, taken = 0, set()
    for i, lane in enumerate(lanes):
        beside = (lanes[p] for p in before[i] if p < i and rows[p] == row)
        if lane in taken or any(min(a, lane) < t < max(a, lane) for a in beside for t in taken):
            row, taken = row + 1, set()
        rows.append(row)
        taken.add(lane)
    return rows


def layout(nodes: DataFrame, diagram: str, order: str, node: str, lane: str, targets: str, kind: str, docs: str) -> DataFrame:
    """(diagram, order, lane_no, row_no, x, y, height) of every node: lanes from 0 by first appearance, rows from 0.

    Where a node goes depends on those before it, so a diagram is folded by one
    task; diagrams are dealt to tasks. ``targets`` is an array of ids; null means the
    next node, an empty array none. A row is as high as its tallest node.
    """
    import pandas as pd

    kept = nodes.select(F.col(diagram).alias("__d"), F.col(order).alias("__o"), F.col(node).cast("string").alias("__id"), F.trim(F.coalesce(F.col(lane), F.lit(NO_LANE))).alias("__lane"), F.col(targets).cast("array<string>").alias("__t"), F.col(kind).alias("__kind"), F.trim(F.coalesce(F.col(docs), F.lit(""))).alias("__docs"))
    types = nodes.schema
    schema = f"`{diagram}` {types[diagram].dataType.simpleString()}, `{order}` {types[order].dataType.simpleString()}, lane_no int, row_no int, x int, y int, height int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__o", kind="stable")
        names = pdf["__lane"].tolist()
        number = {n: i for i, n in enumerate(dict.fromkeys(n for n in names if n))}
        lanes = [number.get(n, 0) for n in names]
        place: dict[str, list[int]] = {}
        ids = pdf["__id"].tolist()
        for i, listed in enumerate(pdf["__t"].tolist()):
            if listed is not None:
                for t in listed:
                    place.setdefault(str(t), []).append(i)
            elif i + 1 < len(ids):
                place.setdefault(str(ids[i + 1]), []).append(i)
        rows = place_rows(lanes, [place.get(str(i), []) for i in ids])
        plain = ROLE_HEIGHT + STEP_HEIGHT
        heights = [DECISION_HEIGHT if k == "decision" else plain + DOC_HEIGHT * (d != "" and d.lower() != "nan") for k, d in zip(pdf["__kind"], pdf["__docs"])]
        tallest: dict[int, int] = {}
        for r, h in zip(rows, heights):
            tallest[r] = max(tallest.get(r, 0), h)
        tops, y = {}, FIRST_ROW
        for r in sorted(tallest):
            tops[r] = y
            y += tallest[r] + ROW_GAP
        x = [round((FRAME_LEFT + n * LANE_WIDTH + (LANE_WIDTH - NODE_WIDTH) / 2) / 10) * 10 for n in lanes]
        return pd.DataFrame({diagram: pdf["__d"], order: pdf["__o"], "lane_no": lanes, "row_no": rows, "x": x, "y": [round(tops[r] / 10) * 10 for r in rows], "height": heights})

    return kept.groupBy("__d").applyInPandas(fold, schema)
