"""Multi-object tracking per shot: a network of detections, its min-cost flow, and triplets sampled from tracks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.match import detection_cost, flow_end_cost, match_cost
from boxloom.operators import detections

# Boxes of a shot, tracks of a shot, gap steps of a skip, least share of the best track's cost.
MOST_BOXES, MOST_TRACKS, MOST_SKIPS, LEAST_COST = 1000, 6, 5, 0.3
_BOX = ["box_id", "frame", "x", "y", "w", "h", "features"]


def _side(boxes: DataFrame, prefix: str) -> DataFrame:
    """The columns of one side of a pair, and at, the dense rank of the frame in its shot: frames without boxes don't count."""
    rank = F.dense_rank().over(Window.partitionBy("shot_id").orderBy("frame")) - 1
    return boxes.withColumn("at", rank).select("shot_id", "at", *[F.col(c).alias(prefix + c) for c in _BOX])


def match_edges(boxes: DataFrame, fps: float, width: float = 320) -> DataFrame:
    """Boxes of neighbouring frames (by dense rank) of a shot, with their cost."""
    pairs = _side(boxes, "a_").withColumn("at", F.col("at") + 1).join(_side(boxes, "b_"), ["shot_id", "at"])
    return pairs.select("shot_id", "a_box_id", "b_box_id", match_cost("a_", "b_", width, fps).alias("cost"))


def skip_edges(boxes: DataFrame, fps: float, width: float = 320) -> DataFrame:
    """Boxes some whole gaps of ceil(fps / 2) frames (by dense rank) apart, where the cost is not positive."""
    gap = math.ceil(fps / 2)
    steps = F.least(F.lit(MOST_SKIPS), F.floor(F.col("at") / gap)).cast("int")
    b = _side(boxes, "b_").where(steps >= 1).withColumn("step", F.explode(F.sequence(F.lit(1), steps)))
    b = b.withColumn("at", F.col("at") - gap * F.col("step"))
    pairs = _side(boxes, "a_").join(b, ["shot_id", "at"])
    return pairs.select("shot_id", "a_box_id", "b_box_id", match_cost("a_", "b_", width, fps).alias("cost")).where("cost <= 0")


def network(boxes: DataFrame, fps: float, width: float = 320) -> DataFrame:
    """The edges of each shot's network (shot_id, kind, a_box_id, b_box_id, cost, most); null ids are source and target.

    most, on the edges that enter, is the number of tracks that the shot may have: MOST_TRACKS, or the most boxes of a
    frame if these are fewer. Shots with more than MOST_BOXES boxes have none.
    """
    n = F.count("*").over(Window.partitionBy("shot_id"))
    boxes = boxes.withColumn("_n", n).where(F.col("_n") <= MOST_BOXES)
    most = boxes.groupBy("shot_id", "frame").count().groupBy("shot_id").agg(F.max("count").alias("_most"))
    ends = flow_end_cost(F.col("_most") / F.col("_n"))
    one = boxes.join(most, "shot_id")
    none = F.lit(None).cast("long")
    edge = lambda df, kind, a, b, cost: df.select("shot_id", F.lit(kind).alias("kind"), a.alias("a_box_id"), b.alias("b_box_id"), cost.alias("cost"))
    i, j, c = F.col("a_box_id"), F.col("b_box_id"), F.col("cost")
    enter = one.select("shot_id", F.lit("enter").alias("kind"), none.alias("a_box_id"), F.col("box_id").alias("b_box_id"), ends.alias("cost"), F.least(F.lit(MOST_TRACKS).cast("long"), "_most").alias("most"))
    out = enter.unionByName(edge(one, "exit", F.col("box_id"), none, ends), allowMissingColumns=True)
    rest = edge(one, "detect", F.col("box_id"), F.col("box_id"), detection_cost(F.col("confidence")))
    rest = rest.unionByName(edge(match_edges(boxes, fps, width), "match", i, j, c)).unionByName(edge(skip_edges(boxes, fps, width), "skip", i, j, c))
    return out.unionByName(rest, allowMissingColumns=True)


def min_cost_flow(nodes: int, edges: list[tuple[int, int, float]], source: int, target: int, amount: int | None = None) -> tuple[float, list[int]]:
    """Cost and used edges of the cheapest flow over unit edges: of any amount, or of the amount given if it fits.

    Successive shortest paths. The first distances come from relaxation rounds (costs may be negative, the network has
    no cycles); later ones from Dijkstra's method on reduced costs.
    """
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, cost, cap = [], [], []
    for a, b, w in edges:
        for x, y, v, c in ((a, b, w, 1), (b, a, -w, 0)):
            head[x].append(len(to))
            to.append(y)
            cost.append(v)
            cap.append(c)
    high = [math.inf] * nodes
    high[source] = 0.0
    queue, queued = [source], {source}
    for x in queue:  # grows while it is read
        queued.discard(x)
        for e in head[x]:
            if cap[e] and high[x] + cost[e] < high[to[e]] - 1e-12:
                high[to[e]] = high[x] + cost[e]
                if to[e] not in queued:
                    queued.add(to[e])
                    queue.append(to[e])
    total, sent = 0.0, 0
    while amount is None or sent < amount:
        dist, came = [math.inf] * nodes, [-1] * nodes
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in head[x]:
                y = to[e]
                if cap[e] and high[y] < math.inf:
                    reduced = d + max(0.0, cost[e] + high[x] - high[y])
                    if reduced < dist[y] - 1e-12:
                        dist[y], came[y] = reduced, e
                        heapq.heappush(heap, (reduced, y))
        if dist[target] == math.inf:
            break
        real = dist[target] + high[target] - high[source]
        if amount is None and real >= -1e-12:
            break
        for x in range(nodes):
            if dist[x] < math.inf:
                high[x] += dist[x]
        x = target
        while x != source:
            cap[came[x]] -= 1
            cap[came[x] ^ 1] += 1
            x = to[came[x] ^ 1]
        total, sent = total + real, sent + 1
    return total, [i for i in range(len(edges)) if cap[2 * i] == 0]


def max_flow(nodes: int, edges: list[tuple[int, int, int]], source: int, target: int) -> int:
    """The largest flow over edges (from, to, capacity): shortest augmenting paths."""
    cap: dict[tuple[int, int], int] = {}
    near: list[set[int]] = [set() for _ in range(nodes)]
    for a, b, c in edges:
        cap[a, b] = cap.get((a, b), 0) + c
        cap.setdefault((b, a), 0)
        near[a].add(b)
        near[b].add(a)
    total = 0
    while True:
        came, line = {source: source}, [source]
        for x in line:
            for y in sorted(near[x]):
                if y not in came and cap[x, y] > 0:
                    came[y] = x
                    line.append(y)
        if target not in came:
            return total
        path, x = [], target
        while x != source:
            path.append((came[x], x))
            x = came[x]
        push = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= push
            cap[b, a] += push
        total += push


def all_paths(edges: list[tuple[int, int, float]], source: int, target: int) -> Iterator[tuple[list[int], float]]:
    """Every path of a network without cycles from source to target, and its cost, in order of the nodes. For small networks."""
    following: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in sorted(edges):
        following.setdefault(a, []).append((b, cost))
    stack = [([source], 0.0)]
    while stack:
        path, cost = stack.pop()
        if path[-1] == target:
            yield path, cost
            continue
        stack.extend(([*path, b], cost + c) for b, c in reversed(following.get(path[-1], [])))


def shot_tracks(edges: pd.DataFrame, most: int | None = None) -> list[tuple[list[int], float]]:
    """The tracks of one shot's network: box ids and cost, the cheapest first; no more than the network allows, or `most`."""
    if most is None:
        allowed = edges["most"].dropna() if "most" in edges else pd.Series(dtype=float)
        most = int(allowed.max()) if len(allowed) else MOST_TRACKS
    boxes = sorted(edges.loc[edges["kind"] == "detect", "a_box_id"].astype(int))
    place = {b: i for i, b in enumerate(boxes)}
    into, out = lambda b: 1 + 2 * place[b], lambda b: 2 + 2 * place[b]
    source, target = 0, 2 * len(boxes) + 1
    rows = []
    for kind, a, b, cost in edges[["kind", "a_box_id", "b_box_id", "cost"]].itertuples(index=False):
        ends = {"enter": lambda: (source, into(int(b))), "exit": lambda: (out(int(a)), target), "detect": lambda: (into(int(a)), out(int(a)))}  # noqa: B023
        x, y = ends.get(kind, lambda: (out(int(a)), into(int(b))))()  # noqa: B023
        rows.append((x, y, float(cost)))
    _, used = min_cost_flow(target + 1, rows, source, target)
    following, starts = {}, []
    for i in used:
        x, y, cost = rows[i]
        if x == source:
            starts.append((y, cost))
        else:
            following[x] = (y, cost)
    tracks = []
    for x, cost in starts:
        path = []
        while x != target:
            if x % 2:
                path.append(boxes[(x - 1) // 2])
            x, more = following[x]
            cost += more
        tracks.append((path, cost))
    tracks.sort(key=lambda t: (t[1], t[0]))
    return tracks[:most]


def tracks(edges: DataFrame) -> DataFrame:
    """(shot_id, track_id, box_id, cost) from networks; tracks whose cost is under LEAST_COST of the best are left out."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = shot_tracks(g)
        best = max((abs(c) for _, c in found), default=0.0)
        found = [(p, c) for p, c in found if best == 0 or abs(c) / best >= LEAST_COST]
        return pd.DataFrame([(g["shot_id"].iloc[0], i, b, c) for i, (p, c) in enumerate(found) for b in p], columns=["shot_id", "track_id", "box_id", "cost"])

    return edges.groupBy("shot_id").applyInPandas(run, "shot_id long, track_id long, box_id long, cost double")


def sampling_boxes(tracked: DataFrame, fps: float, gap: float = 3.0, fade: int = 15, overlap: float = 0.4) -> DataFrame:
    """The tracked boxes (shot_id, frame, track_id, box_id, x, y, w, h) that triplets may be sampled from.

    Shots of a second or more, without `fade` frames at their ends; tracks whose largest jump times fps is at most
    `gap`; of overlapping boxes of a frame the larger; frames with two boxes or more; shots with two tracks or more.
    """
    rows = detections.without_fades(tracked, detections.long_shots(tracked, fps), fade)
    even = detections.max_jump(rows, ["shot_id", "track_id"]).where(F.col("max_jump") * fps <= gap)
    rows = rows.join(even, ["shot_id", "track_id"], "left_semi")
    rows = rows.join(detections.overlap_pruning(rows, ["shot_id", "frame"], overlap), ["shot_id", "frame", "box_id"], "left_semi")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("shot_id", "frame"))).where("_n >= 2").drop("_n")
    several = rows.groupBy("shot_id").agg(F.count_distinct("track_id").alias("n")).where("n >= 2")
    return rows.join(several, "shot_id", "left_semi")


def sample_triplets(tracked: DataFrame, n: int = 10_000, seed: int = 1234567) -> DataFrame:
    """n triplets (shot_id, anchor, positive, negative) by digests of (seed, number): shots in turn, a frame with two or
    more boxes, two of its boxes, and a box of the anchor's track. The positive may be the anchor. Reruns agree.
    """
    frames = tracked.groupBy("shot_id", "frame").agg(F.array_sort(F.collect_list(F.struct("track_id", "box_id"))).alias("boxes")).where(F.size("boxes") >= 2)
    shots = frames.groupBy("shot_id").agg(F.array_sort(F.collect_list(F.struct("frame", "boxes"))).alias("frames"))
    place = F.row_number().over(Window.orderBy("shot_id")) - 1  # of ids only
    shots = shots.join(frames.select("shot_id").distinct().withColumn("place", place), "shot_id")
    spark = tracked.sparkSession
    m = frames.select("shot_id").distinct().count()
    if not m:
        return spark.createDataFrame([], "shot_id long, anchor long, positive long, negative long")
    number = lambda name: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("i").cast("string"), F.lit(name))), 1, 8), 16, 10).cast("long")
    draw = lambda name, size: (number(name) % size).cast("int")
    t = spark.range(n).withColumnRenamed("id", "i").withColumn("place", (F.col("i") % m).cast("int")).join(shots, "place")
    t = t.withColumn("boxes", F.element_at("frames", draw("frame", F.size("frames")) + 1)["boxes"])
    t = t.withColumn("one", draw("anchor", F.size("boxes"))).withColumn("two", F.pmod(F.col("one") + 1 + draw("negative", F.size("boxes") - 1), F.size("boxes")))
    t = t.select("i", "shot_id", F.element_at("boxes", F.col("one") + 1).alias("a"), F.element_at("boxes", F.col("two") + 1)["box_id"].alias("negative"))
    paths = tracked.groupBy("shot_id", "track_id").agg(F.array_sort(F.collect_list("box_id")).alias("path"))
    t = t.withColumn("track_id", F.col("a.track_id")).join(paths, ["shot_id", "track_id"])
    return t.select("shot_id", F.col("a.box_id").alias("anchor"), F.element_at("path", draw("positive", F.size("path")) + 1).alias("positive"), "negative")
