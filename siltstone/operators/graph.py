"""The metadata tree as nodes and edges: closures, listing, search and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 8


def closure(edges: DataFrame, start: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Nodes reachable from start (id): a join for each level that has nodes, and the formats fix how many there can be
    (table, snapshot, manifest list, manifest, file, rows)."""
    found, front = start.select("id").distinct(), start.select("id").distinct()
    for _ in range(levels):
        front = edges.join(front, edges.parent == front.id, "left_semi").select(F.col("child").alias("id")).distinct()
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found.distinct()


def tree(nodes: DataFrame, edges: DataFrame, root: str, levels: int = LEVELS) -> DataFrame:
    """(id, depth, path): the listing in depth-first order of `path`."""
    at = nodes.filter(F.col("id") == root).select("id", F.lit(0).cast("long").alias("depth"), F.array("id").alias("path"))
    out = at
    for k in range(1, levels + 1):
        at = edges.join(at, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), F.lit(k).cast("long").alias("depth"), F.concat("path", F.array("child")).alias("path"))
        if at.isEmpty():
            break
        out = out.unionAll(at)
    return out


def search(nodes: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Nodes any of whose fields contains the text, whatever the case."""
    joined = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return nodes.filter(F.contains(joined, F.lit(text.lower())))


def details(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each field of each node."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return nodes.select("id", F.explode(cells).alias("cell")).select("id", "cell.*")


def paged(nodes: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """The first `size` siblings of each parent, and one row that stands for the others."""
    ranked = nodes.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    shown = ranked.filter(F.col("k") <= size).select(by, F.col(order).cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    rest = ranked.filter(F.col("k") > size).groupBy(by).agg(F.lit("more").alias("item"), F.count(F.lit(1)).alias("n"))
    return shown.unionAll(rest)


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON lines: nodes, then edges."""
    a = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("line"))
    return a.unionAll(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("line")))


def write_csv(files: DataFrame, out: str) -> None:
    """A file inventory; `out` is a folder of the caller's, never the table."""
    files.write.option("header", True).mode("errorifexists").csv(out)


# ---- drawing: what is drawn is what someone looks at, so these serve graphs of a screen's size


def layout(nodes: DataFrame, edges: DataFrame, root: str, kind: str = "TREE", across: int = 200, down: int = 40, levels: int = LEVELS) -> DataFrame:
    """(id, x, y) of the nodes below a root. Both kinds put a level in a column. TREE numbers the leaves from the top and
    centres every other node over its own; LAYERED stacks each column by itself. A node with several parents is placed by
    its first path."""
    own = tree(nodes, edges, root, levels)
    own = own.groupBy("id").agg(F.min(F.struct("depth", "path")).alias("at")).select("id", "at.*")
    x = F.col("depth") * across
    if kind == "LAYERED":
        return own.select("id", x.alias("x"), ((F.row_number().over(Window.partitionBy("depth").orderBy("path")) - 1) * down).cast("long").alias("y"))
    leaves = own.join(edges, own.id == edges.parent, "left_anti").withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)
    spans = leaves.select(F.explode("path").alias("over"), "n").groupBy("over").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return own.join(spans, own.id == spans.over).select("id", x.alias("x"), F.floor((F.col("low") + F.col("high")) * down / 2).cast("long").alias("y"))


def step(placed: DataFrame, edges: DataFrame, at: str, direction: str) -> DataFrame:
    """(id) of the node an arrow key goes to, or no row. placed (id, x, y, width, height); edges (parent, child).

    LEFT and RIGHT follow edges to the parent or child whose middle is nearest in height; UP and DOWN go to the nearest node
    above or below whose width overlaps. Ties go to the least id."""
    here = placed.filter(F.col("id") == at).select(*[F.col(c).alias(f"h_{c}") for c in ("id", "x", "y", "width", "height")])
    if direction in ("LEFT", "RIGHT"):
        side, other = ("child", "parent") if direction == "LEFT" else ("parent", "child")
        near = edges.filter(F.col(side) == at).select(F.col(other).alias("id")).distinct()
        pairs = placed.join(near, "id", "left_semi").join(F.broadcast(here), F.lit(True))  # one row
        distance = F.abs(F.col("y") + F.col("height") / 2 - F.col("h_y") - F.col("h_height") / 2)
    else:
        ahead = F.col("y") - F.col("h_y") if direction == "DOWN" else F.col("h_y") - F.col("y")
        overlap = (F.col("x") < F.col("h_x") + F.col("h_width")) & (F.col("h_x") < F.col("x") + F.col("width"))
        pairs = placed.join(F.broadcast(here), overlap & (ahead > 0.5) & (F.col("id") != F.col("h_id")))
        distance = F.abs(ahead)
    return pairs.agg(F.min(F.struct(distance.alias("d"), F.col("id"))).alias("m")).filter("m IS NOT NULL").select("m.id")


def to_svg(placed: DataFrame, edges: DataFrame, label: str = "id") -> DataFrame:
    """(part, line) of a drawing: 0 the head, 1 the edges, 2 the nodes, 3 the end. placed (id, x, y, width, height, label)."""
    safe = F.replace(F.replace(F.replace(F.col(label).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    size = placed.agg(F.coalesce(F.max(F.col("x") + F.col("width")), F.lit(0)).alias("w"), F.coalesce(F.max(F.col("y") + F.col("height")), F.lit(0)).alias("h"))
    head = size.select(F.lit(0).alias("part"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', "w", "h").alias("line"))
    a, b = (placed.select(F.col("id").alias(side), F.col("x").alias(f"{side}_x"), (F.col("y") + F.floor(F.col("height") / 2)).alias(f"{side}_y"), F.col("width").alias(f"{side}_w")) for side in ("parent", "child"))
    drawn = edges.select("parent", "child").join(a, "parent").join(b, "child")
    lines = drawn.select(F.lit(1), F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d"/>', F.col("parent_x") + F.col("parent_w"), "parent_y", "child_x", "child_y"))
    boxes = placed.select(F.lit(2), F.format_string('<g><rect x="%d" y="%d" width="%d" height="%d"/><text x="%d" y="%d">%s</text></g>', "x", "y", "width", "height", F.col("x") + 4, F.col("y") + F.floor(F.col("height") / 2), safe))
    return head.unionAll(lines).unionAll(boxes).unionAll(size.select(F.lit(3), F.lit("</svg>")))
