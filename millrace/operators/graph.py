"""Graph operators over edges (src, dst): neighbours, undirected k hops, shortest paths, lineage, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.work import written

#: Fixed value: what an entity id looks like.
ENTITY = r"\b([A-Z]{2,6}-[0-9]{2,6}|[A-Z]{2,6}[0-9]{2,6})\b"


def entities(c: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(1))), 1, most)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20) -> DataFrame:
    """src (document), dst (entity), edge_type 'MENTIONS', ord (place of the entity in the document, from 0)."""
    rows = docs.select(F.col(id_col).alias("src"), F.posexplode(entities(F.coalesce(F.col(text_col), F.lit("")), most)).alias("ord", "dst"))
    return rows.select("src", "dst", F.lit("MENTIONS").alias("edge_type"), "ord")


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(types)) if types else edges


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """node, neighbour for nodes(node); types, if given, are the edge types (column edge_type) that count."""
    edges = of_types(edges, types)
    e = edges.select("src", "dst") if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "in" else undirected(edges)
    return e.join(nodes, e.src == nodes.node, "inner").select("node", F.col("dst").alias("neighbour")).distinct()


def k_hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """node, hops: least number of hops from seeds(node), up to k. Each level joins the frontier only, and is written, so that the next one
    does not compute it again."""
    e = undirected(edges)
    levels = [written(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "hops")]
    for level in range(1, k + 1):
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        step = e.join(levels[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        levels.append(written(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(level)), "hops"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def subgraph(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The edges whose ends both lie within k hops of the seeds, distinct."""
    nodes = k_hops(edges, seeds, k).select("node")
    return edges.join(nodes, edges.src == nodes.node, "left_semi").join(nodes, edges.dst == nodes.node, "left_semi").distinct()


def linearised(nodes: DataFrame, edges: DataFrame, most: int = 10, most_props: int = 3) -> DataFrame:
    """One row, text: the first `most` nodes (node, props map<string,string>) in order with up to most_props properties, then as many edges."""
    n = nodes.orderBy("node").limit(most)
    props = F.array_join(F.transform(F.slice(F.array_sort(F.map_entries("props")), 1, most_props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    lines = n.select(F.lit(0).alias("part"), F.col("node").alias("k"), F.concat(F.lit("- "), "node", F.when(F.size("props") > 0, F.concat(F.lit(" ("), props, F.lit(")"))).otherwise("")).alias("line"))
    e = edges.orderBy("src", "dst").limit(most).select(F.lit(1).alias("part"), F.concat_ws("\x01", "src", "dst").alias("k"), F.concat("src", F.lit(" -> "), "dst").alias("line"))
    return lines.union(e).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def upserted_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """node, props of both tables (node, props map<string,string>); a change's properties win, others stay."""
    rows = nodes.select("node", "props", F.lit(0).alias("o")).union(changes.select("node", "props", F.lit(1).alias("o")))
    pairs = rows.select("node", "o", F.explode_outer(F.map_entries("props")).alias("e"))
    last = pairs.groupBy("node", F.col("e.key").alias("key")).agg(F.max_by("e.value", "o").alias("value"))
    made = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))))
    return last.groupBy("node").agg(made.alias("props"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the nodes of gone(node) and every edge that touches one are deleted."""
    g = gone.select("node").distinct()
    kept = edges.join(g, edges.src == g.node, "left_anti").join(g, edges.dst == g.node, "left_anti")
    return nodes.join(g, "node", "left_anti"), kept


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """src, dst, hops, path (least in order of nodes among the shortest) from seeds(node). Levels are written as they are found; of each
    target only the least path goes on."""
    e = undirected(edges)
    paths = written(seeds.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops"), F.array("node").alias("path")), "paths")
    frontier = paths
    for level in range(1, max_depth + 1):
        step = frontier.select(F.col("src").alias("origin"), F.col("dst").alias("via"), "path").join(e.select(F.col("src").alias("via"), F.col("dst").alias("next")), "via")
        new = step.select(F.col("origin").alias("src"), F.col("next").alias("dst"), F.lit(level).alias("hops"), F.concat("path", F.array("next")).alias("path"))
        frontier = written(new.groupBy("src", "dst", "hops").agg(F.min("path").alias("path")).join(paths.select("src", "dst"), ["src", "dst"], "left_anti").select(paths.columns), "paths")
        paths = paths.unionByName(frontier)
    return paths


def lineage_dedupe(hits: DataFrame, parents: DataFrame, current: str | None = None) -> DataFrame:
    """Of hits(session, score, ts) the best of each lineage (parents: id, parent), without the current session's; that is the best score, then the
    oldest; the caller orders by score and ts: columns root, session, score, ts."""
    roots = lineage_roots(parents)
    rows = hits.join(roots, hits.session == roots.id, "left").withColumn("root", F.coalesce("root", "session"))
    if current is not None:
        mine = roots.where(F.col("id") == current).select(F.col("root").alias("mine"))
        rows = rows.join(mine, rows.root == mine.mine, "left_anti").where(F.col("root") != F.lit(current))
    best = rows.groupBy("root").agg(F.min(F.struct((-F.col("score")).alias("low"), "ts", "session")).alias("b"))
    return best.select("root", "b.session", (-F.col("b.low")).alias("score"), "b.ts")


def lineage_roots(rows: DataFrame) -> DataFrame:
    """id, root for rows(id, parent), at any depth; a cycle or a parent that is not there gives the id itself. Pointers double until no
    further row is settled, about log2 of the longest chain rounds; each is written to the shared folder, which cuts the lineage."""
    at = written(rows.select("id", F.coalesce("parent", "id").alias("root"), F.coalesce(F.col("parent") != F.col("id"), F.lit(False)).alias("open")))
    n_open = at.where("open").count()
    while n_open:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("open").alias("next_open"))
        at = written(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("open") & F.coalesce("next_open", F.lit(False))).alias("open")))
        before, n_open = n_open, at.where("open").count()
        # every round settles the next depths, so where none is left the open rows are those of cycles and below them
        if n_open >= before:
            break
    top = rows.where("parent is null or parent = id").select(F.col("id").alias("root"), F.lit(True).alias("is_top"))
    return at.join(top, "root", "left").select("id", F.when(F.col("is_top") & ~F.col("open"), F.col("root")).otherwise(F.col("id")).alias("root"))
