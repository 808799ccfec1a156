"""Connected components, reachability and strongly connected components, as loops of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.operators.storage import cut


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id that a node reaches by edges (a, b), in any direction.

    In rounds, each node goes to its least neighbour if that is less than itself, and on to where that one goes; what is
    left are the edges between the nodes that stay. Of two rounds one at least halves the nodes that have edges, so edges
    and rounds are few. An edge that was its node's only one downwards is gone at once.
    """
    left = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    steps = []
    while not left.isEmpty():
        low = cut(left.groupBy("a").agg(F.min("b").alias("to"), F.max("b").alias("most")))
        to = low.select(F.col("a").alias("id"), "to")
        while True:  # paths halve
            on = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
            if to.join(on, "to", "left_semi").isEmpty():
                break
            to = cut(to.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        steps.append(to)
        more = left.join(low.where("to < most").select("a", F.col("to").alias("least")), "a").where("b <> least").select("a", "b").distinct()
        ends = more.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        left = cut(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if not steps:
        return nodes.select("id", F.col("id").alias("component"))
    last = steps.pop()
    while steps:  # a round's ends go on to those of the rounds after it
        on = last.select(F.col("id").alias("to"), F.col("to").alias("end"))
        last = cut(steps.pop().join(on, "to", "left").select("id", F.coalesce("end", "to").alias("to")).unionByName(last))
    return nodes.select("id").join(last, "id", "left").select("id", F.coalesce("to", "id").alias("component"))


def reach(starts: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """start, id, depth: what each start reaches along edges (a, b) in at most `most` steps, with the fewest steps. A start reaches itself in none."""
    edges = cut(edges.select("a", "b").distinct())
    front = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    seen = front
    for depth in range(1, most + 1):
        stepped = front.join(edges, front["id"] == edges["a"]).select("start", F.col("b").alias("id")).distinct()
        front = cut(stepped.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def strong(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """id, component (its least id) of the nodes on cycles of edges (a, b), loops included.

    Nodes without an edge in or without one out are trimmed until none is left. Then, in rounds: each node takes the
    least id that reaches it as its colour; within a colour, what reaches the colour's node backwards is its
    component, and is removed. Rounds go on until no edge is left within a colour.
    """
    left = cut(edges.select("a", "b").distinct())
    loops = left.where("a = b").select(F.col("a").alias("id"))
    left = cut(left.where("a <> b"))
    done = None
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        ids = left.select(F.col("a").alias("id")).distinct()
        colour = cut(ids.select("id", F.col("id").alias("colour")))
        while True:  # least id that reaches a node
            got = left.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(got, "id", "left").select("id", F.least("colour", "c").alias("new"), "colour"))
            moved = new.where("new < colour").limit(1).count()
            colour = new.select("id", F.col("new").alias("colour"))
            if not moved:
                break
        a, b = colour.select(F.col("id").alias("a"), "colour"), colour.select(F.col("id").alias("b"), F.col("colour").alias("other"))
        within = cut(left.join(a, "a").join(b, "b").where("colour = other").select("a", "b", "colour"))
        part = front = cut(colour.where("id = colour").select("id", "colour"))
        while True:  # backwards from the colour's own node
            back = within.join(front.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"), "colour").distinct()
            front = cut(back.join(part, ["id", "colour"], "left_anti"))
            if front.isEmpty():
                break
            part = cut(part.unionByName(front))
        found = part.select("id", F.col("colour").alias("component"))
        done = found if done is None else cut(done.unionByName(found))
        gone = part.select("id")
        left = cut(within.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    if done is None:
        return loops.select("id", F.col("id").alias("component")).distinct()
    sizes = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    cycles = done.join(sizes.select("component"), "component", "left_semi").select("id", "component")
    alone = loops.distinct().join(cycles, "id", "left_anti").select("id", F.col("id").alias("component"))
    return cycles.unionByName(alone)


def _trimmed(edges: DataFrame) -> DataFrame:
    n = edges.count()
    while n:
        ends = edges.select(F.col("a").alias("b")).distinct()
        begins = edges.select(F.col("b").alias("a")).distinct()
        edges = cut(edges.join(ends, "b", "left_semi").join(begins, "a", "left_semi").select("a", "b"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges
