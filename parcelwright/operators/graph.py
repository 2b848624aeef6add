"""Graphs by rounds: connected components, clusters by distance, greedy choices, spreading and relaxation."""

from __future__ import annotations

import warnings
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwright.plans.checkpoints import materialise


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component.

    ``nodes`` (node long), ``edges`` (a long, b long). Each round a node takes the smallest label among its own, its
    neighbours' and that of its label's node, so chains shorten by jumping; it ends when no label changes. Nothing is
    collected but the number of changes; each round is written to the shared folder. Nodes without edges keep their
    own label; edges may repeat or join a node to itself; nulls have no edges.
    """
    both = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")).distinct())
    touched = both.select(F.col("a").alias("node")).distinct()
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        jumped = labels.alias("l").join(labels.alias("r"), F.col("l.label") == F.col("r.node")).select(F.col("l.node").alias("node"), F.col("r.label").alias("label"))
        spread = offered.unionByName(jumped).groupBy("node").agg(F.min("label").alias("offer"))
        following = materialise(labels.join(spread, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.coalesce("offer", "label") < F.col("label")).alias("changed")))
        changed = following.where("changed").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            break
    alone = nodes.select("node").where("node IS NOT NULL").distinct().join(touched, "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.unionByName(alone)


FINER = 8  # parts of a side from one level of linked_cells() to the next
FEW_PAIRS = 1_024  # places of two cells are compared with one another up to so many pairs; fuller cells by finer boxes, with the same result


def linked_cells(celled: DataFrame, pairs: DataFrame, gap: float, side: float) -> DataFrame:
    """a, b of those ``pairs`` of cells (u, v, pu, pv, a, b) that hold two points (u, v, x, y) at most ``gap`` apart.

    Cells are judged by the boxes around their points: boxes that lie within the gap altogether are linked, boxes farther
    apart are not. Where that doesn't tell, two cells of few places compare these; of fuller ones the boxes of smaller
    cells are compared in the same way, and so on; a cell with one place is its own box, so it ends. The work for a pair
    of cells is bounded, however many points they hold.
    """
    box = [F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    done, open_pairs, level = None, pairs.withColumns({c: F.lit(0) for c in ("fu", "fv", "gu", "gv")}), 0
    while True:
        fine = side / FINER**level
        within_cell = [(F.floor(F.col(c) / fine) if level else F.lit(0)).alias(f) for c, f in (("x", "fu"), ("y", "fv"))]
        boxes = celled.select("u", "v", "x", "y", *within_cell).groupBy("u", "v", "fu", "fv").agg(*box)
        left = boxes.select("u", "v", "fu", "fv", *[F.col(c).alias(f"a{c}") for c in ("n", "x0", "y0", "x1", "y1")])
        right = boxes.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("fu").alias("gu"), F.col("fv").alias("gv"), *[F.col(c).alias(f"b{c}") for c in ("n", "x0", "y0", "x1", "y1")])
        met = open_pairs.join(left, ["u", "v", "fu", "fv"]).join(right, ["pu", "pv", "gu", "gv"])
        apart = lambda c: F.greatest(F.lit(0.0), F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"))
        across = lambda c: F.greatest(F.col(f"b{c}1") - F.col(f"a{c}0"), F.col(f"a{c}1") - F.col(f"b{c}0"))
        judged = met.withColumns({"sure": F.hypot(across("x"), across("y")) <= gap, "few": F.col("an") * F.col("bn") <= FEW_PAIRS, "may": F.hypot(apart("x"), apart("y")) <= gap}).where("may")
        judged = materialise(judged.select("u", "v", "pu", "pv", "a", "b", "fu", "fv", "gu", "gv", "sure", "few"))
        place = celled.select("u", "v", *within_cell, F.col("x").alias("ax"), F.col("y").alias("ay"))
        other_place = place.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("fu").alias("gu"), F.col("fv").alias("gv"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        compared = judged.where("NOT sure AND few").join(place, ["u", "v", "fu", "fv"]).join(other_place, ["pu", "pv", "gu", "gv"]).where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= gap)
        linked = judged.where("sure").select("a", "b").unionByName(compared.select("a", "b")).distinct()
        done = linked if done is None else done.unionByName(linked)
        waiting = judged.where("NOT sure AND NOT few").join(linked, ["a", "b"], "left_anti")
        if not judged.where("NOT sure AND NOT few").limit(1).count() or not waiting.limit(1).count():
            return done
        level += 1
        finer = celled.select("u", "v", (F.floor(F.col("x") / (side / FINER ** (level - 1))) if level > 1 else F.lit(0)).alias("fu"), (F.floor(F.col("y") / (side / FINER ** (level - 1))) if level > 1 else F.lit(0)).alias("fv"), F.floor(F.col("x") / (side / FINER**level)).alias("su"), F.floor(F.col("y") / (side / FINER**level)).alias("sv")).distinct()
        other = finer.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("fu").alias("gu"), F.col("fv").alias("gv"), F.col("su").alias("tu"), F.col("sv").alias("tv"))
        open_pairs = waiting.drop("sure", "few").join(finer, ["u", "v", "fu", "fv"]).join(other, ["pu", "pv", "gu", "gv"]).select("u", "v", "pu", "pv", "a", "b", F.col("su").alias("fu"), F.col("sv").alias("fv"), F.col("tu").alias("gu"), F.col("tv").alias("gv"))


def distance_clusters(points: DataFrame, gap: float) -> DataFrame:
    """node, label: single-linkage clusters of ``points`` (node, x, y): chains of steps of at most ``gap``.

    Points are first gathered into cells whose diagonal is ``gap``, all of one cluster, so a dense spot is one node;
    only cells are linked, see linked_cells(). Points without coordinates are clusters of their own.
    """
    side = gap / 2**0.5
    celled = points.select("node", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumns({"u": F.floor(F.col("x") / side), "v": F.floor(F.col("y") / side)})
    cells = materialise(celled.groupBy("u", "v").agg(F.min("node").alias("head")))
    steps = [(du, dv) for du in range(-2, 3) for dv in range(-2, 3) if (du, dv) > (0, 0)]
    offset = F.explode(F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in steps]))
    near = cells.withColumn("s", offset).select(F.col("head").alias("a"), "u", "v", (F.col("u") + F.col("s.du")).alias("pu"), (F.col("v") + F.col("s.dv")).alias("pv"))
    pairs = near.join(cells.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("head").alias("b")), ["pu", "pv"])
    places = materialise(celled.select("u", "v", "x", "y").distinct())
    label = components(cells.select(F.col("head").alias("node")), linked_cells(places, pairs, gap, side))
    inside = celled.join(cells, ["u", "v"]).select("node", "head").join(label.withColumnRenamed("node", "head"), "head").select("node", "label")
    lone = points.where("x IS NULL OR y IS NULL").select("node", F.col("node").alias("label"))
    return inside.unionByName(lone)


def greedy_keep(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """node, kept: the nodes that remain when they are taken by falling rank and none joins a kept one it conflicts with.

    ``nodes``: node, rank (larger is better; ties go to the smaller node). ``conflicts``: a, b. The result is that of
    the one-by-one procedure, reached in rounds: a node is kept when no undecided neighbour is better, and its
    neighbours are dropped; rounds go on until all are decided.
    """
    rank = nodes.select("node", F.struct(F.coalesce("rank", F.lit(float("-inf"))).alias("r"), (-F.col("node")).alias("n")).alias("rank"))
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b"))
    better = both.where("rb > ra").select(F.col("a").alias("node"), "b")
    state = materialise(rank.select("node", F.lit(None).cast("boolean").alias("kept")))
    while True:
        over = better.join(state.select(F.col("node").alias("b"), F.col("kept").alias("k")), "b").groupBy("node").agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("beaten"), F.bool_or(F.col("k").isNull()).alias("waits"))
        following = state.join(over, "node", "left").select("node", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True).alias("kept"))
        state = materialise(following)
        if not state.where("kept IS NULL").limit(1).count():
            return state


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """a, b, cost: a one-to-one matching taken by rising cost; ties go to the smaller a, then b.

    ``pairs``: a, b, cost. Each round takes every pair that is the best of both its ends, which the one-by-one
    procedure would take as well, and strikes out the pairs that touch it.
    """
    left = materialise(pairs.where("cost IS NOT NULL").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    done = None
    while True:
        order = F.struct("cost", "a", "b")
        best_a = left.groupBy("a").agg(F.min(order).alias("m")).select("m.*")
        best_b = left.groupBy("b").agg(F.min(order).alias("m")).select("m.*")
        won = materialise(best_a.join(best_b, ["a", "b", "cost"]))
        if not won.limit(1).count():
            return done if done is not None else won
        done = won if done is None else done.unionByName(won)
        left = materialise(left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))


def losers(pairs: DataFrame) -> DataFrame:
    """node: of every pair (a, b, rank_a, rank_b) the lower-ranked end (of equal ranks the smaller), whatever the other pairs say."""
    return pairs.select(F.when(F.col("rank_a") == F.col("rank_b"), F.least("a", "b")).when(F.col("rank_a") < F.col("rank_b"), F.col("a")).otherwise(F.col("b")).alias("node")).distinct()


def worst_first(pairs: DataFrame) -> DataFrame:
    """node: what is dropped when the worst pair is settled first, again and again, until none is left.

    ``pairs``: a, b, cost (larger is worse), rank_a, rank_b. A pair is settled by dropping its lower-ranked end (of equal
    ranks the smaller node). Each round settles every pair that is the worst of both its ends, as the one-by-one
    procedure would.
    """
    left = materialise(pairs.where("cost IS NOT NULL AND a <> b").groupBy("a", "b").agg(F.max(F.struct("cost", "rank_a", "rank_b")).alias("m")).select("a", "b", "m.*"))
    dropped = None
    while True:
        order = F.struct(F.col("cost"), -F.col("a"), -F.col("b"))
        ends = left.select(F.explode(F.array("a", "b")).alias("node"), order.alias("o")).groupBy("node").agg(F.max("o").alias("o"))
        worst = left.withColumn("o", order).join(ends.select(F.col("node").alias("a"), F.col("o").alias("oa")), "a").join(ends.select(F.col("node").alias("b"), F.col("o").alias("ob")), "b").where("o = oa AND o = ob")
        gone = materialise(losers(worst))
        if not gone.limit(1).count():
            return dropped if dropped is not None else gone
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = materialise(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"))


def propagated(seeds: DataFrame, links: DataFrame, rounds: int | None = 4) -> DataFrame:
    """node, parent, round: what ``seeds`` (node) reach over ``links`` (a, b, cost) in up to ``rounds`` rounds, with None in as many as it takes.

    A node is seated by the cheapest link (then the smallest neighbour) to a node seated before the round began; what is
    seated within a round only seats others in the next.
    """
    both = materialise(links.select("a", "b", "cost").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")))
    seated = materialise(seeds.select("node").distinct().select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("round")))
    for number in count(1) if rounds is None else range(1, rounds + 1):
        offers = both.join(seated.select(F.col("node").alias("b")), "b").join(seated.select(F.col("node").alias("a")), "a", "left_anti")
        fresh = materialise(offers.groupBy("a").agg(F.min(F.struct("cost", "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").cast("long").alias("parent"), F.lit(number).alias("round")))
        if not fresh.limit(1).count():
            break
        seated = seated.unionByName(fresh)
    return seated


def relaxed_offsets(nodes: DataFrame, gaps: DataFrame, rounds: int = 1_000, step: float = 0.5, settled: float = 0.05, cap: float = float("inf")) -> DataFrame:
    """node, dx, dy: moves that close ``gaps`` (a, b, gx, gy: how far a must move for b to fit) between ``nodes`` (node, fixed).

    All moves of a round are computed from the state before it and then made together: each free node goes ``step`` of
    the mean of what its gaps ask for. It ends when no node moves by ``settled``; if that takes more than ``rounds`` the state
    reached comes with a warning. No node leaves its place by more than ``cap``.
    """
    ask = materialise(gaps.select("a", "b", "gx", "gy").unionByName(gaps.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("gx")).alias("gx"), (-F.col("gy")).alias("gy"))))
    state = materialise(nodes.select("node", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))
    for _ in range(rounds):
        of = lambda s: state.select(F.col("node").alias(s), F.col("dx").alias(f"{s}x"), F.col("dy").alias(f"{s}y"))  # noqa: B023, E731
        wish = ask.join(of("a"), "a").join(of("b"), "b").groupBy("a").agg(F.avg(F.col("gx") + F.col("bx") - F.col("ax")).alias("wx"), F.avg(F.col("gy") + F.col("by") - F.col("ay")).alias("wy"))
        far = F.hypot(F.col("nx"), F.col("ny"))
        moved = state.join(wish.withColumnRenamed("a", "node"), "node", "left").withColumns({"nx": F.col("dx") + step * F.coalesce("wx", F.lit(0.0)), "ny": F.col("dy") + step * F.coalesce("wy", F.lit(0.0))})
        shrink = F.when(far > cap, cap / far).otherwise(1.0)
        goal = moved.select("node", "fixed", "dx", "dy", F.when(F.col("fixed"), 0.0).otherwise(F.col("nx") * shrink).alias("tx"), F.when(F.col("fixed"), 0.0).otherwise(F.col("ny") * shrink).alias("ty"))
        following = materialise(goal.select("node", "fixed", F.col("tx").alias("dx"), F.col("ty").alias("dy"), F.hypot(F.col("tx") - F.col("dx"), F.col("ty") - F.col("dy")).alias("s")))
        most = following.agg(F.max("s").alias("s")).collect()[0].s
        state = following.drop("s")
        if most is None or most < settled:
            return state.select("node", "dx", "dy")
    warnings.warn(f"nodes still move by {most} after {rounds} rounds", stacklevel=2)
    return state.select("node", "dx", "dy")
