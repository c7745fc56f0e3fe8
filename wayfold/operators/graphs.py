"""Graphs as edge tables (src, dst, weight): traversals, spanning trees, shortest paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def bfs(edges: DataFrame, source) -> DataFrame:
    """(vertex, depth) of what ``source`` reaches, level by level: each round joins the frontier with the edges."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seen = frontier = spark.createDataFrame([(source, 0)], f"vertex {kind}, depth int")
    while True:
        near = frontier.join(edges, frontier["vertex"] == edges["src"]).select(F.col("dst").alias("vertex"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = near.join(seen, "vertex", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier).checkpoint()


def shortest_paths(edges: DataFrame, source, rounds: int | None = None) -> DataFrame:
    """(vertex, distance) from ``source``; weights may be negative. Relaxes all edges in each round, at most once for each
    vertex; a change after that means a negative cycle and is an error."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    vertices = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct().count()
    dist = spark.createDataFrame([(source, 0.0)], f"vertex {kind}, distance double")
    for _ in range((rounds or vertices) + 1):
        step = dist.join(edges, dist["vertex"] == edges["src"]).select(F.col("dst").alias("vertex"), (F.col("distance") + F.col("weight")).alias("distance"))
        new = dist.unionByName(step).groupBy("vertex").agg(F.min("distance").alias("distance")).checkpoint()
        if not new.exceptAll(dist).limit(1).count():
            return new
        dist = new
    raise ValueError("the graph has a negative cycle")


def depth_first(pdf: pd.DataFrame, source) -> list:
    """Vertices in the order of a depth-first walk, neighbours by name; visited ones are not entered again."""
    near = {s: sorted(set(g)) for s, g in pdf.groupby("src")["dst"]}
    out, stack, seen = [], [source], set()
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            stack += reversed([w for w in near.get(v, []) if w not in seen])
    return out


def kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    root: dict = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    keep = []
    for row in pdf.sort_values(["weight", "src", "dst"], kind="stable").itertuples(index=False):
        a, b = find(row.src), find(row.dst)
        if a != b:
            root[a] = b
            keep.append((row.src, row.dst, row.weight))
    return pd.DataFrame(keep, columns=["src", "dst", "weight"])


def prim(pdf: pd.DataFrame, source=None) -> pd.DataFrame:
    """Edges in the order in which the tree from ``source`` (the least vertex) takes them."""
    near: dict = {}
    for row in pdf.itertuples(index=False):
        near.setdefault(row.src, []).append((row.weight, row.src, row.dst))
        near.setdefault(row.dst, []).append((row.weight, row.dst, row.src))
    source = min(near) if source is None else source
    seen, queue, keep = {source}, list(near[source]), []
    heapq.heapify(queue)
    while queue:
        w, a, b = heapq.heappop(queue)
        if b not in seen:
            seen.add(b)
            keep.append((a, b, w))
            for e in near[b]:
                heapq.heappush(queue, e)
    return pd.DataFrame(keep, columns=["src", "dst", "weight"])


def dijkstra(pdf: pd.DataFrame, source) -> dict:
    near = {s: list(zip(g["dst"], g["weight"], strict=True)) for s, g in pdf.groupby("src")}
    dist, queue = {}, [(0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in dist:
            dist[v] = d
            for w, weight in near.get(v, []):
                if w not in dist:
                    heapq.heappush(queue, (d + weight, w))
    return dist


def spanning_trees(edges: DataFrame, key: str = "graph", method: str = "kruskal") -> DataFrame:
    """Minimum spanning tree of each graph ``key``; a graph is one task's work."""
    solve = kruskal if method == "kruskal" else prim
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, "src", "dst", "weight"))
    return edges.groupBy(key).applyInPandas(lambda p: solve(p).assign(**{key: p[key].iloc[0]})[[key, "src", "dst", "weight"]], schema)


def depth_first_orders(edges: DataFrame, source, key: str = "graph") -> DataFrame:
    """(key, vertex, place): the order of a depth-first walk of each graph ``key`` from ``source``; a graph is one task's work."""
    kinds = dict(edges.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        order = depth_first(pdf, source)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(order), "vertex": order, "place": range(len(order))})

    return edges.groupBy(key).applyInPandas(walk, f"{key} {kinds[key]}, vertex {kinds['src']}, place int")


def distances(edges: DataFrame, source, key: str = "graph") -> DataFrame:
    """(key, vertex, distance) of each graph ``key`` from ``source``, nearest vertex first (weights are not negative); a graph is
    one task's work. ``shortest_paths`` takes one large graph."""
    kinds = dict(edges.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = dijkstra(pdf, source)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "vertex": list(found), "distance": [float(d) for d in found.values()]})

    return edges.groupBy(key).applyInPandas(solve, f"{key} {kinds[key]}, vertex {kinds['src']}, distance double")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """Spanning forest of one large graph, distributed: in each round every component takes its lightest outgoing edge
    (ties by vertex names), then components merge. Rounds grow with the logarithm of the number of vertices."""
    ordered = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")).filter("src <> dst")
    label = ordered.select(F.col("src").alias("v")).unionByName(ordered.select(F.col("dst").alias("v"))).distinct().withColumn("c", F.col("v")).checkpoint()
    tree = ordered.limit(0)
    while True:
        placed = ordered.join(label.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs <> cd")
        edge = F.struct("weight", "src", "dst", "cs", "cd")
        best = placed.select(F.col("cs").alias("c"), edge.alias("e")).unionByName(placed.select(F.col("cd").alias("c"), edge.alias("e"))).groupBy("c").agg(F.min("e").alias("e")).checkpoint()
        if best.isEmpty():
            return tree
        tree = tree.unionByName(best.select("e.src", "e.dst", "e.weight").distinct()).checkpoint()
        links = best.select(F.col("e.cs").alias("a"), F.col("e.cd").alias("b")).distinct()
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = links.select(F.col("a").alias("v")).distinct().withColumn("c", F.col("v"))
        while True:
            new = links.join(low, links["b"] == low["v"]).select(F.col("a").alias("v"), "c").unionByName(low).groupBy("v").agg(F.min("c").alias("c")).checkpoint()
            if not new.exceptAll(low).limit(1).count():
                break
            low = new
        label = label.join(low.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c")).checkpoint()
