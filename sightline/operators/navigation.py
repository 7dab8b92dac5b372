"""Walkable graphs and camera topologies: lengths, locating nodes, routes and shortest paths as set-based loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import exact_sum, exact_sums
from ..functions.columns import distance, finite, segment_lengths
from ..sources.tables import discard, materialised

#: Rounds after which the tables of reached nodes are written as one.
COMPACTED = 16


def with_lengths(edges: DataFrame) -> DataFrame:
    """edges with length: the exactly rounded sum of their polyline's segments."""
    return edges.withColumn("length", exact_sum(segment_lengths(F.col("polyline"))))


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("from_node_id") == node_id).orderBy("edge_id")


def locate_nodes(positions: DataFrame, nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """request_id, node_id, failure: the one node of the same floor within tolerance; AMBIGUOUS_POSITION where there are
    more, INVALID_POSITION where a coordinate is missing or not finite.

    positions has request_id, position, floor_id. Nodes are looked for in the grid cells around a position, so the
    join is on floor and cell.
    """
    cell = max(2 * tolerance, 1e-9)
    at = lambda a, s: F.floor((F.col(f"position.{a}") + s * tolerance) / cell)
    valid = F.coalesce(finite(F.col("position.x"), F.col("position.y"), F.col("position.z")), F.lit(False))
    p = positions.where(valid).withColumns({f"g{a}": F.explode(F.array_distinct(F.array(at(a, -1), at(a, 1)))) for a in "x"})
    p = p.withColumn("gy", F.explode(F.array_distinct(F.array(at("y", -1), at("y", 1))))).withColumn("gz", F.explode(F.array_distinct(F.array(at("z", -1), at("z", 1)))))
    n = nodes.select("node_id", "floor_id", F.col("position").alias("node_position"), *(F.floor(F.col(f"position.{a}") / cell).alias(f"g{a}") for a in "xyz"))
    near = p.join(n, ["floor_id", "gx", "gy", "gz"]).where(distance(F.col("position"), F.col("node_position")) <= tolerance)
    found = near.groupBy("request_id").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    out = positions.select("request_id", valid.alias("valid")).join(found, "request_id", "left")
    failure = F.when(~F.col("valid"), "INVALID_POSITION").when(F.col("n") > 1, "AMBIGUOUS_POSITION")
    return out.select("request_id", F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), failure.alias("failure"))


def route_polylines(routes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """route_id, polyline, distance, failure of routes (route_id, start_node_id, edge_ids).

    Edges must exist and follow each other from the start; joints appear once. A route without edges is its node.
    """
    cited = routes.select("route_id", "start_node_id", F.posexplode("edge_ids").alias("pos", "edge_id")).join(with_lengths(edges).select("edge_id", "from_node_id", "to_node_id", "polyline", "length"), "edge_id", "left")
    expected = F.coalesce(F.lag("to_node_id").over(Window.partitionBy("route_id").orderBy("pos")), F.when(F.col("pos") == 0, F.col("start_node_id")))
    cited = cited.withColumn("follows", F.coalesce(F.col("from_node_id") == expected, F.lit(False)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "polyline", "length"))), lambda s: s)
    whole = cited.groupBy("route_id").agg(parts.alias("parts"), F.bool_and("follows").alias("follows"), F.bool_and(F.col("length").isNotNull()).alias("known"))
    joined = F.flatten(F.transform("parts", lambda s: F.when(s["pos"] == 0, s["polyline"]).otherwise(F.slice(s["polyline"], F.lit(2), F.size(s["polyline"])))))
    whole = whole.withColumn("joined", joined).withColumn("sum", exact_sum(F.transform("parts", lambda s: s["length"])))
    start = nodes.select(F.col("node_id").alias("start_node_id"), F.col("position").alias("start_position"))
    out = routes.join(whole, "route_id", "left").join(start, "start_node_id", "left")
    empty = F.size("edge_ids") == 0
    failure = F.when(F.col("start_position").isNull(), "UNKNOWN_NODE").when(~empty & ~F.col("known"), "UNKNOWN_EDGE").when(~empty & ~F.col("follows"), "NOT_CONTIGUOUS")
    out = out.withColumn("failure", failure)
    ok = F.col("failure").isNull()
    return out.select("route_id", F.when(ok, F.when(empty, F.array("start_position")).otherwise(F.col("joined"))).alias("polyline"), F.when(ok, F.when(empty, F.lit(0.0)).otherwise(F.col("sum"))).alias("distance"), "failure")


def _costs(starts: DataFrame, links: DataFrame, max_rounds: int) -> DataFrame:
    """start_id, node, cost: the least cost of each node that a start reaches, costs added from the start on.

    A round joins the labels that got better in the last one with the links, so that rounds are as many as links on the
    longest of the best routes. A label is three columns, and requests of the same start share it.
    """
    best = materialised(starts.select("start_id", F.col("start_id").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("changed")), "costs")
    for _ in range(max_rounds):
        there = F.col("cost") + F.col("step")
        sound = (there > F.col("cost")) & (there < float("inf"))
        moved = best.where("changed").join(links.withColumnsRenamed({"from_id": "node", "cost": "step"}), "node")
        moved = moved.select("start_id", F.col("to_id").alias("node"), F.when(sound, there).otherwise(F.raise_error(F.lit("a link's cost must add to a route's, and the sum be finite")).cast("double")).alias("new"))
        both = best.drop("changed").join(moved.groupBy("start_id", "node").agg(F.min("new").alias("new")), ["start_id", "node"], "full")
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        old, best = best, materialised(both.select("start_id", "node", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"), better.alias("changed")), "costs")
        discard(old)
        if best.where("changed").isEmpty():
            return best.drop("changed")
    raise RuntimeError(f"routes of more than {max_rounds} links")


def _next_links(pairs: DataFrame, tight: DataFrame, max_rounds: int) -> DataFrame:
    """start_id, goal_id, node, link_id, next: the least link by which a best route to the goal goes on, for every node that
    lies on one. Nodes are found from the goal back, a link a round, and each once."""
    new = materialised(pairs.select("start_id", "goal_id", F.col("goal_id").alias("node")), "reached")
    ways, seen = [], new
    for _ in range(max_rounds):
        back = materialised(tight.join(new.withColumnRenamed("node", "to_id"), ["start_id", "to_id"]), "ways")
        if back.isEmpty():
            break
        ways.append(back)
        fresh = back.select("start_id", "goal_id", F.col("from_id").alias("node")).distinct()
        new = materialised(fresh.join(seen, ["start_id", "goal_id", "node"], "left_anti"), "reached")
        seen = seen.unionByName(new)
        if len(ways) % COMPACTED == 0:
            seen = materialised(seen, "reached")
    else:
        raise RuntimeError(f"routes of more than {max_rounds} links")
    if not ways:
        return pairs.select("start_id", "goal_id", F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("link_id"), F.lit(None).cast("string").alias("next")).limit(0)
    least = reduce(DataFrame.unionByName, ways).groupBy("start_id", "goal_id", F.col("from_id").alias("node")).agg(F.min(F.struct("link_id", F.col("to_id").alias("next"))).alias("l"))
    return least.select("start_id", "goal_id", "node", "l.*")


def _steps(pairs: DataFrame, onward: DataFrame) -> DataFrame:
    """start_id, goal_id, pos, node of the nodes that links are left from. Jumps double from round to round, so that a
    route of n links takes log2(n) rounds."""
    by = ["start_id", "goal_id"]
    jump = materialised(onward.select(*by, "node", "next"), "jumps")
    found, reach = materialised(pairs.select(*by, F.lit(0).cast("long").alias("pos"), F.col("start_id").alias("node")), "steps"), 1
    while not jump.isEmpty():
        further = found.join(jump, [*by, "node"]).select(*by, (F.col("pos") + reach).alias("pos"), F.col("next").alias("node"))
        found = materialised(found.unionByName(further), "steps")
        twice = jump.join(jump.select(*by, F.col("next").alias("beyond"), F.col("node").alias("next")), [*by, "next"])
        jump, reach = materialised(twice.select(*by, "node", F.col("beyond").alias("next")), "jumps"), 2 * reach
    return found


def best_routes(requests: DataFrame, links: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """request_id, cost, link_ids of each request's best route from start to goal, by cost and then link ids; unreachable ones are missing.

    links has from_id, to_id, link_id (no two alike), cost. A link whose cost adds nothing to a route's, or makes it
    infinite, fails the job. Least costs come first, for each distinct start; a link is tight where it alone makes its
    end's cost. Of the tight links from which a goal can be reached, the least at each node makes the route of least ids,
    so no label carries the route: it is followed by jumps that double.
    """
    links = materialised(links.select("from_id", "to_id", "link_id", "cost"), "links")
    pairs = requests.select("start_id", "goal_id").distinct()
    costs = _costs(pairs.select("start_id").distinct(), links, max_rounds)
    here, there = costs.withColumnsRenamed({"node": "from_id", "cost": "before"}), costs.withColumnsRenamed({"node": "to_id", "cost": "after"})
    tight = here.join(links, "from_id").join(there, ["start_id", "to_id"]).where(F.col("before") + F.col("cost") == F.col("after"))
    tight = materialised(tight.select("start_id", "from_id", "to_id", "link_id"), "tight")
    pairs = materialised(pairs.join(costs.withColumnRenamed("node", "goal_id"), ["start_id", "goal_id"]), "pairs")
    onward = materialised(_next_links(pairs.drop("cost"), tight, max_rounds), "onward")
    left = _steps(pairs.drop("cost"), onward).join(onward.drop("next"), ["start_id", "goal_id", "node"])
    routes = left.groupBy("start_id", "goal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_id"))), lambda s: s["link_id"]).alias("link_ids"))
    found = pairs.join(routes, ["start_id", "goal_id"], "left").withColumn("link_ids", F.coalesce("link_ids", F.array().cast("array<string>")))
    return requests.select("request_id", "start_id", "goal_id").join(found, ["start_id", "goal_id"]).select("request_id", "cost", "link_ids")


def shortest_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """request_id, distance, edge_ids: shortest walk by length, ties by the edge ids; distance is the exactly rounded sum.

    With nodes, there is a column failure as well: UNKNOWN_NODE where an end of the request is none of them, NO_PATH where
    no walk leads from one to the other; without, such requests are missing.
    """
    e = materialised(with_lengths(edges.where("walkable")).select("edge_id", "from_node_id", "to_node_id", "length"), "lengths")
    known = requests if nodes is None else requests.join(unknown_nodes(requests, nodes), "request_id", "left_anti")
    found = best_routes(known, e.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id"), F.col("edge_id").alias("link_id"), F.col("length").alias("cost")))
    lengths = exact_sums(found.select("request_id", F.explode_outer("link_ids").alias("edge_id")).join(e.select("edge_id", "length"), "edge_id", "left"), ["request_id"], "length", "distance")
    out = found.join(lengths, "request_id").select("request_id", F.coalesce("distance", F.lit(0.0)).alias("distance"), F.col("link_ids").alias("edge_ids"))
    if nodes is None:
        return out
    unknown = unknown_nodes(requests, nodes).withColumn("unknown", F.lit(True))
    failure = F.when(F.col("unknown"), "UNKNOWN_NODE").when(F.col("distance").isNull(), "NO_PATH")
    return requests.select("request_id").join(unknown, "request_id", "left").join(out, "request_id", "left").select("request_id", "distance", "edge_ids", failure.alias("failure"))


def minimum_hops(requests: DataFrame, transitions: DataFrame) -> DataFrame:
    """request_id, hops, transition_ids: fewest camera transitions, ties by the transition ids."""
    links = transitions.select(F.col("from_camera_id").alias("from_id"), F.col("to_camera_id").alias("to_id"), F.col("transition_id").alias("link_id"), F.lit(1.0).alias("cost"))
    return best_routes(requests, links).select("request_id", F.col("cost").cast("int").alias("hops"), F.col("link_ids").alias("transition_ids"))


def unknown_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id of requests whose start or goal is no node."""
    ends = requests.select("request_id", F.explode(F.array("start_id", "goal_id")).alias("node_id"))
    return ends.join(nodes, "node_id", "left_anti").select("request_id").distinct()
