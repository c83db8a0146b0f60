"""Iterative graph operators: each round is a join; rounds are written to the shared folder so that no lineage grows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import both_ways
from lattica.sources.shared import discard, stored


def shortest_path(pairs: DataFrame, relations: DataFrame, max_hops: int = 10) -> tuple[DataFrame, DataFrame]:
    """Undirected shortest paths of (pair_id, user_id, from, to), names in any case, of at most max_hops.

    Returns (pair_id, found, length), and (pair_id, step, node, source, target, label, weight): of the shortest paths the
    one with the smallest names from the end backwards, and for each step but 0 the relation that leads to its node, in
    its true direction; of several the heaviest, then the smallest label, then the one along the path. Equal ends
    that exist are found at length 0.

    Both ends of a pair have a frontier, and in each round the one with fewer nodes grows by a hop, so a hub near one end
    is opened only if the other end offers no smaller frontier. Pairs that have met, or one frontier of which is empty, stop. From
    the nodes where the frontiers have met the half of the end is walked again with parents, and the path is read back from
    the end. Null names lead nowhere.
    """
    edges = stored(both_ways(relations.select("user_id", "source", "target")).select("user_id", "node", "other").distinct())
    nodes = edges.select("user_id", F.col("node").alias("name"), F.lower("node").alias("low")).distinct()
    ends = F.explode(F.array(F.struct(F.lit(True).alias("forward"), F.lower("from").alias("low")), F.struct(F.lit(False).alias("forward"), F.lower("to").alias("low")))).alias("e")
    asked = pairs.select("pair_id", "user_id", ends).select("pair_id", "user_id", "e.*")
    known = ["pair_id", "forward", "user_id", "node", "parent", "hops"]
    first = stored(asked.join(nodes, ["user_id", "low"]).select("pair_id", "forward", "user_id", F.col("name").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hops")).distinct())
    rounds, meetings = [first], []
    frontier = fresh = first
    for hop in range(max_hops + 1):
        reached = reduce(DataFrame.unionByName, rounds)
        other = reached.select("pair_id", "node", (~F.col("forward")).alias("forward"), F.col("hops").alias("theirs"))
        met = fresh.join(other, ["pair_id", "node", "forward"]).select("pair_id", "user_id", "node", F.when(F.col("forward"), F.col("hops")).otherwise(F.col("theirs")).alias("before"), F.when(F.col("forward"), F.col("theirs")).otherwise(F.col("hops")).alias("after"))
        meetings.append(stored(met.distinct()))
        if hop == max_hops:
            break
        sizes = frontier.groupBy("pair_id").agg(F.count_if("forward").alias("here"), F.count_if(~F.col("forward")).alias("there")).where("here > 0 AND there > 0")
        sizes = sizes.join(meetings[-1].select("pair_id").distinct(), "pair_id", "left_anti").select("pair_id", (F.col("here") <= F.col("there")).alias("turn"))
        live = stored(frontier.join(sizes, "pair_id").select(*known, "turn"))
        step = live.where("forward = turn").join(edges, ["user_id", "node"]).groupBy("pair_id", "forward", "user_id", F.col("other").alias("node"), (F.col("hops") + 1).alias("hops")).agg(F.min("node").alias("parent"))
        fresh = stored(step.join(reached.select("pair_id", "forward", "node"), ["pair_id", "forward", "node"], "left_anti").select(known))
        if hop:
            discard(frontier)
        frontier = stored(live.where("forward != turn").select(known).unionByName(fresh))
        discard(live)
        rounds.append(fresh)
        if fresh.isEmpty():
            break
    met = reduce(DataFrame.unionByName, meetings)
    reached = reduce(DataFrame.unionByName, rounds)

    # the half of the end, from where the frontiers have met
    at = stored(met.select("pair_id", "user_id", "node", "after", (F.col("before") + F.col("after")).alias("length"), F.lit(None).cast("string").alias("parent")))
    halves = [at]
    behind = reached.where("NOT forward").select("pair_id", "node", F.col("hops").alias("after"))
    while not at.isEmpty():
        step = at.where("after > 0").join(edges, ["user_id", "node"]).groupBy("pair_id", "user_id", F.col("other").alias("next"), (F.col("after") - 1).alias("after"), "length").agg(F.min("node").alias("parent"))
        at = stored(step.withColumnRenamed("next", "node").join(behind, ["pair_id", "node", "after"], "left_semi").select(at.columns))
        halves.append(at)
    half = reduce(DataFrame.unionByName, halves)
    end = half.where("after = 0").groupBy("pair_id", "user_id").agg(F.min(F.struct("length", "node")).alias("end"))
    end = stored(end.select("pair_id", "user_id", F.col("end.length").alias("step"), F.col("end.node").alias("node")))
    led = half.where("parent IS NOT NULL").select("pair_id", (F.col("length") - F.col("after")).alias("step"), "node", "parent")
    led = stored(led.unionByName(reached.where("forward AND parent IS NOT NULL").join(end.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.col("hops").alias("step"), "node", "parent")))
    at, walked = end, []
    while not at.isEmpty():
        at = stored(at.join(led, ["pair_id", "step", "node"], "left").select("pair_id", "user_id", "step", "node", "parent"))
        walked.append(at)
        at = at.where("step > 0").select("pair_id", "user_id", (F.col("step") - 1).alias("step"), F.col("parent").alias("node"))
    none = end.select("pair_id", "user_id", "step", "node", F.col("node").alias("parent")).limit(0)
    way = reduce(DataFrame.unionByName, walked, none)

    held = both_ways(relations.select("user_id", "source", "target", "type", "weight")).select("user_id", F.col("node").alias("parent"), F.col("other").alias("node"), "is_forward", F.col("type").alias("label"), "weight")
    links = held.join(way.select("user_id", "parent", "node").distinct(), ["user_id", "parent", "node"], "left_semi")
    link = links.groupBy("user_id", "parent", "node").agg(F.min_by(F.struct("is_forward", "label", "weight"), F.struct(-F.col("weight"), F.col("label"), ~F.col("is_forward"))).alias("l"))
    steps = way.join(link, ["user_id", "parent", "node"], "left")
    source = F.when(F.col("l.is_forward"), F.col("parent")).when(~F.col("l.is_forward"), F.col("node"))
    target = F.when(F.col("l.is_forward"), F.col("node")).when(~F.col("l.is_forward"), F.col("parent"))
    steps = stored(steps.select("pair_id", "step", "node", source.alias("source"), target.alias("target"), F.col("l.label").alias("label"), F.col("l.weight").alias("weight")))
    summary = stored(pairs.select("pair_id").join(end.select("pair_id", "step"), "pair_id", "left").select("pair_id", F.col("step").isNotNull().alias("found"), F.col("step").alias("length")))
    discard(edges, *rounds, *meetings, *halves, end, led, *walked, frontier)
    return summary, steps


def pagerank(nodes: DataFrame, links: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(user_id, id, pagerank) for each tenant, the largest being 10; parallel links count, mass of sinks is spread evenly.

    A round is a join on the source and a sum on the target, and one row of each tenant for the mass of its sinks.
    """
    names = nodes.select("user_id", "id").distinct()
    out = links.groupBy("user_id", F.col("source").alias("id")).agg(F.count("*").alias("out"))
    size = names.groupBy("user_id").agg(F.count("*").alias("n"))
    last = ranks = stored(names.join(out, ["user_id", "id"], "left").join(size, "user_id").withColumn("pr", 1 / F.col("n")))
    edges = stored(links.groupBy("user_id", "source", "target").agg(F.count("*").alias("times")))
    for i in range(rounds):
        spread = ranks.select("user_id", F.col("id").alias("source"), (F.col("pr") / F.col("out")).alias("each"))
        got = edges.join(spread, ["user_id", "source"]).groupBy("user_id", F.col("target").alias("id")).agg(F.sum(F.col("each") * F.col("times")).alias("got"))
        sinks = ranks.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("pr"))), F.lit(0.0)).alias("lost"))
        new = damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) / F.col("n") + damping * F.col("lost") / F.col("n")
        ranks = ranks.drop("pr").join(got, ["user_id", "id"], "left").join(sinks, "user_id").select("user_id", "id", "out", "n", new.alias("pr"))
        if (i + 1) % every == 0:
            ranks = stored(ranks)
            discard(last)
            last = ranks
    top = ranks.groupBy("user_id").agg(F.max("pr").alias("top"))
    return ranks.join(top, "user_id").select("user_id", "id", (10 * F.col("pr") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("pagerank"))


def hierarchy_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, id, level): directed hops from the nodes without incoming links, or from the smallest name of a tenant without any; what is not reached comes one level below the last.

    A round for each level, until no node is left to go on from.
    """
    names = nodes.select("user_id", "id").distinct()
    edges = stored(links.where("source != target").select("user_id", "source", "target").distinct())
    roots = names.join(links.select("user_id", F.col("target").alias("id")), ["user_id", "id"], "left_anti")
    lone = names.join(roots, "user_id", "left_anti").groupBy("user_id").agg(F.min("id").alias("id"))
    frontier = reached = stored(roots.unionByName(lone).withColumn("level", F.lit(0)))
    level = 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.select("user_id", F.col("id").alias("source")).join(edges, ["user_id", "source"]).select("user_id", F.col("target").alias("id")).distinct()
        last, frontier = frontier, stored(step.join(names, ["user_id", "id"], "left_semi").join(reached, ["user_id", "id"], "left_anti").withColumn("level", F.lit(level)))
        before, reached = reached, stored(reached.unionByName(frontier))
        discard(last, before)
    discard(edges, frontier)
    last = reached.groupBy("user_id").agg((F.max("level") + 1).alias("below"))
    return names.join(reached, ["user_id", "id"], "left").join(last, "user_id", "left").select("user_id", "id", F.coalesce("level", "below").alias("level"))
