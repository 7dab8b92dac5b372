"""Top-K feasible routes across blind gaps.

Edge lengths are positive, so in best-first order every state comes after its parent, and the order in which a heap
would give states up is their sorted order. That order depends on the start alone: a request's speed, length and detour
bounds are bounds of distance, so it sees the beginning of its start's order. Each start's order is made once for all of
its requests, band of distance by band of distance, and no further than the largest budget of expanded states. Ranks
take the heap's place: the budget, the K-th route and a branch that is too wide are events at a rank, and the earliest
one ends a request's search.

How far a request reaches is told by how many of its start's distances it reaches. Requests of the same ends and bounds
that reach as many are one question, which is answered once and joined with them afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import float_hex, hex_list
from ..functions.columns import exceeds, finite, ulp
from ..functions.exact import LIMBS, limbs_of, merged, rounded
from ..sources.tables import discard, materialised
from ..sources.schemas import FEASIBILITY_FLAGS
from . import navigation
from .navigation import with_lengths

KEY = ("distance", "edge_ids", "transition_ids", "camera", "node")
ABSENT = 1 << 40


def endpoint_floor(observation_floor, point_floor):
    """floor, failure of an endpoint: an empty text counts as missing, two different floors do not go together."""
    o, p = F.nullif(observation_floor, F.lit("")), F.nullif(point_floor, F.lit(""))
    failure = F.when(o.isNotNull() & p.isNotNull() & (o != p), "ENDPOINT_FLOOR_MISMATCH").when(o.isNull() & p.isNull(), "ENDPOINT_FLOOR_REQUIRED")
    return F.when(failure.isNull(), F.coalesce(p, o)), failure


def request_failures(requests: DataFrame) -> DataFrame:
    """requests with failure: the first check that a request does not pass, in the order of the API."""
    c = F.col
    checks = F.coalesce(
        F.when(~F.coalesce(c("max_paths") >= 1, F.lit(False)), "INVALID_MAX_PATHS"),
        F.when(~F.coalesce(c("start_valid"), F.lit(False)) | ~F.coalesce(c("end_valid"), F.lit(False)), "INVALID_OBSERVATION"),
        F.when(~c("start_target").eqNullSafe(c("end_target")), "TARGET_MISMATCH"),
        F.when(c("start_observation_id").eqNullSafe(c("end_observation_id")), "DUPLICATE_OBSERVATION"),
        F.when(~F.coalesce(finite(c("gap_s")) & (c("gap_s") > 0), F.lit(False)), "INVALID_TIME_GAP"),
        c("start_failure"),
        F.when(c("start_node").isNull(), "ENDPOINT_OFF_NETWORK"),
        c("end_failure"),
        F.when(c("end_node").isNull(), "ENDPOINT_OFF_NETWORK"),
        F.when(~finite(c("gap_s") * c("max_speed_m_s")), "NUMERICAL_FAILURE"),
    )
    return requests.withColumn("failure", checks)


def transition_routes(transitions: DataFrame, edges: DataFrame) -> DataFrame:
    """Transitions with the lengths of the edges that they cite, in order, and the limbs of their exact sum."""
    lengths = with_lengths(edges).select("edge_id", "length")
    cited = transitions.select("transition_id", F.posexplode("navigation_edge_ids").alias("pos", "edge_id")).join(lengths, "edge_id")
    cited = cited.groupBy("transition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "length"))), lambda s: s["length"]).alias("step_lengths"))
    return transitions.join(cited, "transition_id").select("transition_id", F.col("from_camera_id").alias("camera"), F.col("navigation_from_node_id").alias("node"), F.col("to_camera_id").alias("to_camera"), F.col("navigation_to_node_id").alias("to_node"), F.col("navigation_edge_ids").alias("step_edges"), "step_lengths", limbs_of(F.col("step_lengths")).alias("step_sums"))


START, END = ("start_camera", "start_node"), ("end_camera", "end_node")


def walk_orders(starts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked, made) of starts (start_camera, start_node, budget, reach).

    ranked: a start's states by rank, up to one more than its budget, with camera, node, distance, edge_ids and
    transition_ids. made: the lengths far of all walks that grow out of states within the budget, and the least rank
    that each grows out of. Walks longer than reach are in made alone.

    Nothing grows out of a state by less than the shortest move. So of a start's pending states all that are less than
    that beyond the nearest one are ranked in one round. A state carries the limbs of its exact length, to which a move
    adds its own. A start keeps as many pending states as it has ranks left. States are few bytes and much work, so they
    are spread over all cores by a number of tasks, not by their size.
    """
    tasks = starts.sparkSession.sparkContext.defaultParallelism
    shortest = moves.agg(F.min(F.aggregate("step_lengths", F.lit(0.0), lambda s, x: s + x))).first()[0] or 1.0
    none = F.array().cast("array<string>")
    pending = starts.select(*START, "budget", "reach", F.lit(0).cast("long").alias("before"), F.col("start_camera").alias("camera"), F.col("start_node").alias("node"), F.lit(0.0).alias("distance"), none.alias("edge_ids"), none.alias("transition_ids"), F.array().cast(LIMBS).alias("sums"), F.lit(0).cast("long").alias("parent"), F.lit("").alias("via"))
    pending = materialised(pending, "pending")
    ranked, made = [], []
    first = Window.partitionBy(*START, "camera", "node", "edge_ids").orderBy("parent", "via")
    of_start = Window.partitionBy(*START)
    while not ranked or not pending.isEmpty():
        near = pending.repartition(tasks, *START).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        near = near.withColumn("rank", F.col("before") + F.row_number().over(of_start.orderBy(*KEY))).where(F.col("rank") <= F.col("budget") + 1)
        near = near.withColumn("final", F.col("distance") < F.min("distance").over(of_start) + shortest * (1 - 1e-9))
        near = materialised(near.withColumn("after", F.col("before") + F.sum(F.col("final").cast("long")).over(of_start)), "near")
        now = near.where("final")
        ranked.append(now.select(*START, "rank", "camera", "node", "distance", "edge_ids", "transition_ids"))
        grown = now.where(F.col("rank") <= F.col("budget")).repartition(tasks, *START, "rank").join(moves, ["camera", "node"]).withColumn("all_sums", merged(F.concat("sums", "step_sums")))
        grown = grown.select(*START, "budget", "reach", F.col("after").alias("before"), F.col("to_camera").alias("camera"), F.col("to_node").alias("node"), rounded(F.col("all_sums")).alias("distance"), F.concat("edge_ids", "step_edges").alias("edge_ids"), F.concat("transition_ids", F.array("transition_id")).alias("transition_ids"), F.col("all_sums").alias("sums"), F.col("rank").alias("parent"), F.col("transition_id").alias("via"))
        grown = materialised(grown, "grown")
        made.append(grown.select(*START, F.col("distance").alias("far"), "parent"))
        rest = near.where(~F.col("final")).withColumn("before", F.col("after")).drop("rank", "final", "after")
        old, pending = pending, materialised(rest.unionByName(grown.where(~exceeds(F.col("distance"), F.col("reach")))).where(F.col("before") <= F.col("budget")), "pending")
        discard(old)
    made = reduce(DataFrame.unionByName, made).groupBy(*START, "far").agg(F.min("parent").alias("parent"))
    return materialised(reduce(DataFrame.unionByName, ranked), "ranked"), materialised(made, "made")


BOUNDS = ("k", "max_search_nodes", "max_branch_factor", "max_path_length_m", "max_detour_ratio")


def asked(requests: DataFrame, ranked: DataFrame, made: DataFrame) -> DataFrame:
    """requests (request_id, START, END, BOUNDS, gap_s, max_speed_m_s, reach_m) with level, how many of the distances that
    occur from their start do not exceed reach_m, and question: a text for their ends, BOUNDS and level.

    Whether a distance exceeds a reach changes once as the reach grows, at what flips; so requests of one start and level
    compare alike with every distance of the search, and level is found by halving the distances in the order of flips.
    """
    d = F.col("distance")
    slack = F.greatest(F.lit(1e-12), 4 * ulp(d))  # that of exceeds for a limit below the distance
    known = ranked.select(*START, d).union(made.select(*START, "far")).distinct().select(*START, F.struct((d - slack).alias("flips"), d.alias("d"), slack.alias("slack")).alias("x"))
    known = materialised(known.groupBy(*START).agg(F.array_sort(F.collect_list("x")).alias("known")), "distances")
    most = known.agg(F.max(F.size("known"))).first()[0] or 0
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length())))).cast("array<int>")

    def within(x):
        return ~((x["d"] > F.col("reach_m")) & ((x["d"] - F.col("reach_m")) > x["slack"]))

    level = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("known")) & within(F.get("known", at + step - 1)), at + step).otherwise(at))
    r = requests.select("request_id", *START, *END, *BOUNDS, "gap_s", "max_speed_m_s", "reach_m").join(known, [*START], "left")
    r = r.withColumn("level", F.when(F.col("reach_m").isNotNull(), level)).drop("known")
    return r.withColumn("question", F.to_json(F.struct(*START, *END, *BOUNDS, "level"), {"ignoreNullFields": "false"}))


def search(requests: DataFrame, transitions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, routes) of requests (sources.schemas.SEARCH_REQUESTS).

    results: request_id, termination_reason, expanded_nodes, complete, n_candidates, rejections. routes: request_id,
    rank, edge_ids, transition_ids, distance, minimum_time, estimated_time, slack.
    """
    moves = materialised(transition_routes(transitions, edges), "moves")
    c = F.col
    requests = requests.withColumn("k", F.least("max_paths", "max_candidate_paths")).withColumn("reach_m", c("max_speed_m_s") * c("gap_s")).withColumn("top", F.least("max_path_length_m", "reach_m"))
    starts = requests.groupBy(*START).agg(F.max("max_search_nodes").cast("long").alias("budget"), F.max("top").alias("reach"))
    ranked, made = walk_orders(starts, moves)
    requests = materialised(asked(requests, ranked, made), "asked")
    answers, ways = answered(requests, ranked, made, moves)
    results = requests.select("request_id", "question").join(answers, "question").drop("question")
    minimum = F.least(c("distance") / c("max_speed_m_s"), c("gap_s"))
    routes = requests.select("request_id", "question", "gap_s", "max_speed_m_s").join(ways, "question")
    routes = routes.select("request_id", "rank", "edge_ids", "transition_ids", "distance", minimum.alias("minimum_time"), c("gap_s").alias("estimated_time"), F.greatest(F.lit(0.0), c("gap_s") - minimum).alias("slack"))
    return results, routes


def answered(requests: DataFrame, ranked: DataFrame, made: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, ways) of the questions of asked requests: results and routes of search, but for their times, by question."""
    c = F.col
    questions = requests.groupBy("question", *START, *END, *BOUNDS, "level").agg(F.min("reach_m").alias("reach_m"))
    # one reach for all of a start and level, so that what depends on it is worked out once for them
    questions = questions.withColumn("reach_m", F.min("reach_m").over(Window.partitionBy(*START, "level"))).drop("level").withColumn("top", F.least("max_path_length_m", "reach_m"))
    requests = materialised(questions, "questions")
    most = (requests.agg(F.max("k")).first()[0] or 0) + 1
    ends = requests.select(*START, *END).distinct()
    goals = ranked.withColumnsRenamed({"camera": "end_camera", "node": "end_node"}).join(ends, [*START, *END])
    goals = materialised(goals.withColumn("nth", F.row_number().over(Window.partitionBy(*START, *END).orderBy("rank"))).where(c("nth") <= most), "goals")
    nearest = goals.where("nth = 1").select(*START, *END, c("rank").alias("first_rank"), c("distance").alias("first_distance"))
    r = requests.join(nearest, [*START, *END], "left").withColumn("reached", F.coalesce(~exceeds(c("first_distance"), c("top")), F.lit(False)))
    detour = F.when(c("reached"), F.when(c("first_distance") == 0, c("max_path_length_m")).otherwise(c("first_distance") * c("max_detour_ratio")))
    r = r.withColumn("detour", detour).withColumn("cut", F.least("top", "detour"))

    # how many states lie within the cut: all, or as many as the last distance within it has before it
    levels = ranked.groupBy(*START, "distance").agg(F.max("rank").alias("upto"))
    whole = levels.groupBy(*START).agg(F.max("distance").alias("farthest"), F.max("upto").alias("n_all"))
    r = materialised(r.join(whole, [*START]).withColumn("within", F.when(~exceeds(c("farthest"), c("cut")), c("n_all"))), "bounded")
    counted = r.where("within is null").select(*START, "cut").distinct().join(levels, [*START]).where(~exceeds(c("distance"), c("cut"))).groupBy(*START, "cut").agg(F.max("upto").alias("n_cut"))
    r = r.join(counted, [*START, "cut"], "left").withColumn("inside", F.coalesce("within", "n_cut"))

    branches = ranked.join(moves.groupBy("camera", "node").agg(F.count("*").alias("n_branches")), ["camera", "node"]).select(*START, "rank", "n_branches")
    wide = r.select(*START, "max_branch_factor").distinct().join(branches, [*START]).where(c("n_branches") > c("max_branch_factor")).groupBy(*START, "max_branch_factor").agg(F.min("rank").alias("branch_rank"))
    last = goals.select(*START, *END, (c("nth") - 1).alias("k"), c("rank").alias("goal_rank"))
    r = r.join(wide, [*START, "max_branch_factor"], "left").join(last, [*START, *END, "k"], "left")

    # a state above the limit is still in the heap if its parent was expanded before the first goal was known
    longest = made.groupBy(*START).agg(F.max("far").alias("longest"))
    endless = F.lit(1e300)  # longer than any walk
    r = r.join(longest, [*START], "left").withColumns({f"{x}_limit": F.when(exceeds(c("longest"), c(x)), c(x)).otherwise(endless) for x in ("top", "reach_m", "max_path_length_m")})
    r = materialised(r, "placed")
    key = [*START, "first_rank", "detour", "top_limit"]
    over = r.where(c("reached") & (c("inside") <= c("max_search_nodes"))).select(*key).distinct().join(made, [*START]).where((c("parent") < c("first_rank")) & exceeds(c("far"), c("detour")) & ~beyond("top_limit")).select(*key).distinct().withColumn("over", F.lit(1))
    lost = [*START, "inside", "reach_m_limit", "max_path_length_m_limit"]
    flags = r.where(~c("reached")).select(*lost).distinct().join(made, [*START]).where(c("parent") <= c("inside"))
    flags = flags.groupBy(*lost).agg(F.bool_or(beyond("max_path_length_m_limit")).alias("too_long"), F.bool_or(~beyond("max_path_length_m_limit") & beyond("reach_m_limit")).alias("too_fast"))
    r = r.join(over, key, "left").join(flags, lost, "left").withColumn("total", c("inside") + F.coalesce("over", F.lit(0)))
    far, budget = F.lit(ABSENT), c("max_search_nodes").cast("long")
    event = F.least(
        F.struct(F.when(c("total") > budget, budget + 1).otherwise(far).cast("long").alias("rank"), F.lit(0).alias("phase")),
        F.struct(F.when(c("goal_rank") <= c("inside"), c("goal_rank")).otherwise(far).cast("long").alias("rank"), F.lit(2).alias("phase")),
        F.struct(F.when(c("branch_rank") <= c("inside"), c("branch_rank")).otherwise(far).cast("long").alias("rank"), F.lit(3).alias("phase")),
    )
    r = materialised(r.withColumn("event", event).select("question", *START, *END, "k", "inside", "total", "reached", "too_long", "too_fast", budget.alias("budget"), "event.*"), "ends")
    stopped = c("rank") < ABSENT
    routes = goals.withColumnRenamed("rank", "state_rank").join(r.drop("too_long", "too_fast"), [*START, *END]).where("reached and nth <= k and state_rank <= inside")
    routes = routes.where((c("state_rank") < c("rank")) | ((c("state_rank") == c("rank")) & (c("phase") == 3)))
    ways = materialised(routes.select("question", c("nth").cast("int").alias("rank"), "edge_ids", "transition_ids", "distance"), "ways")
    out = r.join(ways.groupBy("question").agg(F.count("*").alias("n_candidates")), "question", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    none = c("n_candidates") == 0
    reason = F.when(stopped & (c("phase") == 0), "MAX_SEARCH_NODES").when(stopped & (c("phase") == 2), "MAX_PATHS_REACHED").when(stopped, "MAX_BRANCH_FACTOR").when(none, "NO_FEASIBLE_PATH").otherwise("COMPLETE")
    rejections = F.when((reason == "NO_FEASIBLE_PATH"), F.concat_ws(",", F.lit("NO_FEASIBLE_AUTHORIZED_ROUTE"), F.when(c("too_fast"), F.lit("PHYSICALLY_IMPOSSIBLE_SPEED")), F.when(c("too_long"), F.lit("MAX_PATH_LENGTH_EXCEEDED")))).otherwise("")
    expanded = F.when(stopped & (c("phase") == 0), c("budget")).when(stopped, c("rank")).otherwise(c("total"))
    answers = out.select("question", reason.alias("termination_reason"), expanded.alias("expanded_nodes"), (~stopped).alias("complete"), "n_candidates", rejections.alias("rejections"))
    return materialised(answers, "answers"), ways


def beyond(limit: str):
    return exceeds(F.col("far"), F.col(limit))


def checked_search(requests: DataFrame, transitions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """search of the requests that pass request_failures; results has failure, and of the others nothing else."""
    judged = materialised(request_failures(requests), "judged")
    good = judged.where("failure is null")
    results, routes = search(good, transitions, edges)
    failed = judged.where("failure is not null").select("request_id", "failure")
    return results.withColumn("failure", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True), routes


IDENTITY = "candidate_v1"


def candidates(routes: DataFrame, requests: DataFrame, edges: DataFrame, nodes: DataFrame, context: dict[str, str]) -> DataFrame:
    """Routes as candidate trajectories; path_score is null as nothing scores yet.

    requests has start and end: structs of target_id, camera_id, floor_id, observation_id and point (point_id,
    observation_id, camera_id, plane_id, floor_id, timestamp, world_position). context names spatial_context_id,
    navigation_graph_id, topology_id and source_asset_sha256. candidate_id is the sha256 of all that makes up a
    candidate, as compact JSON with sorted keys and doubles in hexadecimal. A route without edges has its node twice.
    """
    c = F.col
    asked = requests.select("request_id", "start_node", "max_speed_m_s", "start", "end")
    # a line and its text for each way, whatever the number of requests that take it
    ways = routes.select("request_id", "edge_ids").join(requests.select("request_id", "start_node"), "request_id").select("start_node", "edge_ids").distinct()
    ways = materialised(ways.withColumn("route_id", F.to_json(F.struct("start_node", "edge_ids"))), "ways")
    lines = navigation.route_polylines(ways.select("route_id", c("start_node").alias("start_node_id"), "edge_ids"), edges, nodes).select("route_id", "polyline")
    lines = lines.withColumn("polyline", F.when(F.size("polyline") == 1, F.concat("polyline", "polyline")).otherwise(c("polyline")))
    lines = lines.withColumn("line_hex", hex_list(F.flatten(F.transform("polyline", lambda p: F.array(p["x"], p["y"], p["z"])))))
    points = F.transform(F.sequence(F.lit(0), F.size("polyline") - 1), lambda i: F.slice("line_hex", 3 * i + 1, 3))
    lines = materialised(ways.join(lines.withColumn("points", points).drop("line_hex"), "route_id").drop("route_id"), "lines")

    def point(e: str):
        at = c(f"{e}.point.world_position")
        return F.struct(*(c(f"{e}.point.{f}").alias(f) for f in ("camera_id", "floor_id", "observation_id", "plane_id", "point_id")), float_hex(c(f"{e}.point.timestamp")).alias("timestamp"), hex_list(F.array(at["x"], at["y"], at["z"])).alias("world_position"))

    # what is told by a request alone is written before its routes are joined
    asked = asked.select("*", *(point(e).alias(f"{e}_point") for e in ("start", "end")), float_hex(c("max_speed_m_s")).alias("speed_hex"))
    r = routes.join(asked, "request_id").join(lines, ["start_node", "edge_ids"])
    fields = {k: F.lit(v) for k, v in context.items()} | {f"{e}_{f}": c(f"{e}.{f}") for e in ("start", "end") for f in ("camera_id", "floor_id", "observation_id")} | {f"{e}_point": c(f"{e}_point") for e in ("start", "end")} | {"max_speed_m_s": c("speed_hex")}
    fields |= {k: float_hex(c(v)) for k, v in (("path_length", "distance"), ("minimum_travel_time", "minimum_time"), ("estimated_travel_time", "estimated_time"))}
    fields |= {"identity_version": F.lit(IDENTITY), "target_id": c("start.target_id"), "transition_ids": c("transition_ids"), "navigation_edge_ids": c("edge_ids"), "polyline": c("points")}
    payload = F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})
    return r.select(
        "request_id",
        "rank",
        F.concat(F.lit("candidate:"), F.sha2(payload, 256)).alias("candidate_id"),
        c("start.observation_id").alias("start_observation_id"),
        c("end.observation_id").alias("end_observation_id"),
        "polyline",
        F.array_join("edge_ids", ",").alias("corridor"),
        c("distance").alias("path_length"),
        c("minimum_time").alias("minimum_travel_time"),
        c("estimated_time").alias("estimated_travel_time"),
        c("distance").alias("spatial_cost"),
        c("slack").alias("temporal_cost"),
        F.lit(",".join(FEASIBILITY_FLAGS)).alias("feasibility_flags"),
        F.lit(None).cast("double").alias("path_score"),
        F.lit("INFERRED_GAP").alias("provenance"),
    )


def bounded_walks(transitions: DataFrame, edges: DataFrame, max_length: float, keep: int = 3) -> DataFrame:
    """start, end, rank, corridor, length: the `keep` shortest walks from every camera to every other within max_length,
    ties by the edge ids. Walks that are no longer among the keep best of their ends are dropped level by level; any
    walk's beginning is among the best of its own ends or can be swapped for one that is.
    """
    step = transition_routes(transitions, edges).select(F.col("camera").alias("end"), F.col("to_camera").alias("to"), "step_edges", F.aggregate("step_lengths", F.lit(0.0), lambda s, x: s + x).alias("step"))
    step = materialised(step, "steps")
    cameras = step.select("end").union(step.select("to")).distinct()
    walks = cameras.select(F.col("end").alias("start"), "end", F.lit(0.0).alias("length"), F.array().cast("array<string>").alias("edge_ids"))
    best = materialised(walks, "walks")
    frontier = best
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy("length", "edge_ids"))
    while not frontier.isEmpty():
        grown = frontier.join(step, "end").where(F.col("length") + F.col("step") <= max_length)
        grown = grown.select("start", F.col("to").alias("end"), (F.col("length") + F.col("step")).alias("length"), F.concat("edge_ids", "step_edges").alias("edge_ids"), F.lit(True).alias("fresh"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(grown).withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")
        both = materialised(both, "walks")
        best, frontier = both.drop("fresh"), both.where("fresh").drop("fresh")
    return best.select("start", "end", rank.alias("rank"), F.array_join("edge_ids", ">").alias("corridor"), "length")
