"""One surviving record for each set of parcel records, by iterative truth discovery."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwright.llm.cadastre import has_text, name_key, perimeter, resolve_villages, survey_key, with_shape
from parcelwright.operators.graph import components
from parcelwright.plans.checkpoints import materialise

SAME_PLACE = 0.25  # centroids of one parcel lie within this share of the square root of its area
SAME_SIZE = 1.25  # and its areas within this ratio
RING_PLACE, RING_SIZE = 0.05, 1.05  # the same for rings that claim one polygon, whose perimeters are within that ratio too
ROUNDS, CONVERGED = 1_000, 1e-4  # rounds at most: an error follows
MOST_SOURCES = 10_000  # an error follows beyond it
COMPARED = ["survey_number", "village", "lgd_village_code", "polygon", "source_crs", "area_ha", "land_use", "source", "captured_at"]


def discover(claims: DataFrame, reliability: DataFrame, rounds: int = ROUNDS, most_patterns: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Truth discovery: (object, field, value, support, share of the votes) of the best value, and (source, weight).

    ``claims``: object, field, value, source; a source's claim of a value counts once, however often it is repeated.
    ``reliability``: source, weight (the start; sources that lack there begin at 0.5). In turn each value's votes are
    weighed by its sources' reliability, and each source's reliability is the mean share of votes that its values
    won, until no weight moves by CONVERGED. Ties go to the value with more sources, then the smallest. Null objects,
    values and sources make no claims. Objects whose values have the same sets of sources vote alike, so the rounds work
    on the different patterns of sets with their numbers of objects. Up to ``most_patterns`` of them the driver goes through
    the rounds itself; more stay in their table and each round is a job, with the same result. Weights are one number for
    each of at most MOST_SOURCES sources (more are an error).
    """
    known = claims.where("object IS NOT NULL AND value IS NOT NULL AND source IS NOT NULL")
    votes = materialise(known.groupBy("object", "field", "value").agg(F.array_sort(F.collect_set("source")).alias("sources")))
    sets = votes.groupBy("object", "field", "sources").agg(F.count("*").alias("values"))
    patterns = materialise(sets.groupBy("object", "field").agg(F.array_sort(F.collect_list(F.struct("sources", "values"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("times")))
    sources = patterns.select(F.explode("pattern.sources").alias("s")).select(F.explode("s").alias("source")).distinct()
    start = sources.join(reliability.groupBy("source").agg(F.max("weight").alias("weight")), "source", "left").select("source", F.coalesce("weight", F.lit(0.5)).alias("weight")).limit(MOST_SOURCES + 1).collect()
    if len(start) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = {r.source: r.weight for r in start}
    spark = claims.sparkSession

    def support(named: Column) -> Column:
        table = F.create_map(*[F.lit(v) for pair in sorted(weights.items()) for v in pair]) if weights else F.create_map().cast("map<string,double>")
        return F.aggregate(named, F.lit(0.0), lambda total, s: total + table[s])

    def by_job() -> dict[str, float]:
        weighed = patterns.select("times", F.transform("pattern", lambda v: F.struct(v["sources"].alias("sources"), v["values"].alias("values"), support(v["sources"]).alias("support"))).alias("pattern"))
        votes_in_all = F.aggregate("pattern", F.lit(0.0), lambda total, v: total + v["values"] * v["support"])
        each = weighed.select("times", votes_in_all.alias("all"), F.explode("pattern").alias("v")).select((F.col("times") * F.col("v.values")).alias("n"), (F.col("v.support") / F.col("all")).alias("share"), F.explode("v.sources").alias("source"))
        return {r.source: (r.won + 1.0) / (r.n + 2.0) for r in each.groupBy("source").agg(F.sum(F.col("n") * F.col("share")).alias("won"), F.sum("n").alias("n")).collect()}

    def here() -> dict[str, float]:
        won, votes_of = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0)
        for times, pattern in few:
            supported = [sum(weights[s] for s in named) for named, _ in pattern]
            total = sum(n * v for (_, n), v in zip(pattern, supported))
            for (named, n), v in zip(pattern, supported):
                for s in named:
                    won[s] += times * n * v / total
                    votes_of[s] += times * n
        return {s: (won[s] + 1.0) / (votes_of[s] + 2.0) for s in weights}

    taken = patterns.limit(most_patterns + 1).collect() if most_patterns else []
    few = [(r.times, [(v.sources, v["values"]) for v in r.pattern]) for r in taken] if 0 < len(taken) <= most_patterns else None
    moved = 0.0
    for _ in range(rounds if weights else 0):
        now = by_job() if few is None else here()
        moved = max(abs(now[s] - weights[s]) for s in now)
        weights = now
        if moved < CONVERGED:
            break
    else:
        if weights:
            raise RuntimeError(f"weights still move by {moved} after {rounds} rounds")
    value = votes.select("object", "field", "value", support(F.col("sources")).alias("support"), F.size("sources").alias("sources"))
    # the largest support first, then more sources, then the smallest value
    best = value.groupBy("object", "field").agg(F.min_by(F.struct("value", "support"), F.struct(-F.col("support"), -F.col("sources"), F.col("value"))).alias("v"), F.sum("support").alias("all"))
    return best.select("object", "field", "v.value", "v.support", (F.col("v.support") / F.col("all")).alias("share")), spark.createDataFrame(sorted(weights.items()), "source string, weight double")


def clean(parcels: DataFrame, villages: DataFrame) -> DataFrame:
    """parcel_id, survey (key), code (the village, where it is certain), codes (candidates), place, size, and the fields of ``parcels`` that are compared.

    Of rows with one parcel_id that with the latest captured_at counts, then that with the largest hash of all these
    columns (row_key); null ids are left out.
    """
    shaped = with_shape(parcels.where("parcel_id IS NOT NULL").select("parcel_id", *COMPARED, F.xxhash64(*COMPARED).alias("row_key")))
    fields = {
        "survey": survey_key(F.col("survey_number")), "name": name_key(F.col("village")), "lgd": F.col("lgd_village_code").cast("long"),
        "crs": F.upper(F.regexp_replace("source_crs", r"\s", "")), "cx": F.col("cx"), "cy": F.col("cy"), "shape_area": F.col("shape_area"), "length": perimeter(F.col("polygon")), "corners": F.col("corners"), "source": F.col("source"), "captured_at": F.col("captured_at"), "area_ha": F.col("area_ha"), "row_key": F.col("row_key"),
        "present": F.coalesce(has_text(F.col("survey_number")).cast("int") + has_text(F.col("village")).cast("int") + (F.col("corners") >= 3).cast("int") + F.col("area_ha").isNotNull().cast("int") + has_text(F.col("land_use")).cast("int") + F.col("lgd_village_code").isNotNull().cast("int"), F.lit(0)),
    }
    keyed = shaped.select("parcel_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("row")).groupBy("parcel_id").agg(F.max_by("row", F.struct("row.captured_at", "row.row_key")).alias("row")).select("parcel_id", "row.*")
    named = resolve_villages(parcels.select(name_key(F.col("village")).alias("name")), villages)
    return keyed.join(named, "name", "left").withColumn("codes", F.when(F.col("lgd").isNotNull(), F.array("lgd")).otherwise(F.col("codes"))).withColumn("code", F.when(F.size("codes") == 1, F.get("codes", F.lit(0)))).drop("lgd", "name")


def place_groups(records: DataFrame) -> DataFrame:
    """parcel_id, object: the records (parcel_id, cx, cy, shape_area, crs) that lie at one place with one size.

    Records are first gathered into small cells of place and size, so that any number of copies or near copies of a
    parcel is one node; only cells are compared, with those in neighbouring blocks of the scale of their size. A record
    without a coordinate system has that of the records around it if they agree on one, so it never joins two zones.
    """
    level = F.ceil(F.log2(F.sqrt(F.col("shape_area") * SAME_SIZE) * SAME_PLACE)).cast("int")
    fine = F.pow(F.lit(2.0), F.col("level") - 3)
    celled = records.where("shape_area IS NOT NULL").withColumn("level", level).withColumns({"u": F.floor(F.col("cx") / fine), "v": F.floor(F.col("cy") / fine), "band": F.floor(F.log("shape_area") / math.log(1.05))})
    cell = ["level", "u", "v", "band", "crs"]
    nodes = materialise(celled.groupBy(*cell).agg(F.min("parcel_id").alias("node"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.avg("shape_area").alias("area")))
    block = F.pow(F.lit(2.0), F.col("at"))
    home = nodes.select(F.col("node").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("area").alias("aa"), F.col("crs").alias("ac"), F.col("level").alias("at")).withColumns({"bu": F.floor(F.col("ax") / block), "bv": F.floor(F.col("ay") / block)})
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    probe = nodes.select(F.col("node").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("area").alias("ba"), F.col("crs").alias("bc"), F.explode(F.array("level", F.col("level") + 1)).alias("at"))
    probe = probe.withColumns({"bu": F.floor(F.col("bx") / block), "bv": F.floor(F.col("by") / block)}).withColumn("d", F.explode(near)).withColumn("bu", F.col("bu") + F.col("d")).withColumn("d", F.explode(near)).withColumn("bv", F.col("bv") + F.col("d")).drop("d")
    larger = F.greatest("aa", "ba")
    met = home.join(probe, ["at", "bu", "bv"]).where(F.col("a") != F.col("b"))
    met = met.where((F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= SAME_PLACE * F.sqrt(larger)) & (larger / F.least("aa", "ba") <= SAME_SIZE))
    met = materialise(met.select("a", "b", "ac", "bc"))
    told = met.where("ac IS NULL AND bc IS NOT NULL").groupBy("a").agg(F.min("bc").alias("low"), F.max("bc").alias("high")).where("low = high")
    zone = lambda s: told.select(F.col("a").alias(s), F.col("low").alias(f"{s}_zone"))
    agreed = met.where("ac = bc").select("a", "b").unionByName(
        met.where("ac IS NULL OR bc IS NULL").join(zone("a"), "a", "left").join(zone("b"), "b", "left").where(F.coalesce("ac", "a_zone").eqNullSafe(F.coalesce("bc", "b_zone"))).select("a", "b")
    )
    label = components(nodes.select("node"), agreed)
    of = nodes.select(*cell, "node").join(label, "node").select(*cell, F.col("label").alias("object"))
    same = [celled[c].eqNullSafe(of[c]) for c in cell]
    return celled.join(of, same).select("parcel_id", "object")


def village_of_neighbours(places: DataFrame, side: float = 256.0, share: float = 0.9) -> DataFrame:
    """object, code for the rows of ``places`` (object, cx, cy, code) without a code whose surroundings agree on one.

    The surroundings are the square of ``side`` metres around the place and the eight next to it; at least ``share`` of
    their places with a code must have the same. Counts are gathered by square before they meet, so full squares stay one row.
    """
    squared = places.withColumns({"u": F.floor(F.col("cx") / side), "v": F.floor(F.col("cy") / side)})
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    counts = squared.where("code IS NOT NULL").groupBy("u", "v", "code").agg(F.count("*").alias("n"))
    spread = counts.withColumn("d", F.explode(near)).withColumn("u", F.col("u") + F.col("d")).withColumn("d", F.explode(near)).withColumn("v", F.col("v") + F.col("d")).groupBy("u", "v", "code").agg(F.sum("n").alias("n"))
    ruling = spread.groupBy("u", "v").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("near_code"), F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("most") >= share * F.col("all"))
    return squared.where("code IS NULL").join(ruling, ["u", "v"]).select("object", F.col("near_code").alias("code"))


def group_records(parcels: DataFrame, villages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with their object, truth of each object, weights of the sources).

    Records with a ring are one parcel if they lie at one place with one size, whatever number is written on them.
    Truth discovery then finds each such parcel's number and village from its records, and a record without a ring
    joins the parcel that has its number in its village (of several, the best supported; a parcel whose records name no village is in that of its surroundings); those that find none are
    one parcel by number and village. A record with neither stays alone.
    """
    records = materialise(clean(parcels, villages))
    placed = materialise(records.join(place_groups(records), "parcel_id", "left"))
    claims = placed.where("object IS NOT NULL")
    start = sources.select("source", (F.col("trust") / (F.lit(1.0) + F.col("trust"))).alias("weight"))
    told = claims.select("object", F.lit("survey").alias("field"), F.col("survey").alias("value"), "source").unionByName(claims.select("object", F.lit("code").alias("field"), F.col("code").cast("string").alias("value"), "source"))
    truth, weights = discover(told, start)
    truth = materialise(truth)
    told_code = truth.where("field = 'code'").select("object", F.col("value").cast("long").alias("code"))
    places = claims.groupBy("object").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy")).join(told_code, "object", "left")
    codes = told_code.unionByName(village_of_neighbours(places))
    known = truth.where("field = 'survey'").select("object", F.col("value").alias("survey"), "support").join(codes, "object")
    best = known.groupBy("survey", "code").agg(F.max_by("object", F.struct("support", -F.col("object"))).alias("found"), F.max("support").alias("support"))
    loose = placed.where("object IS NULL")
    asked = loose.select("parcel_id", "survey", F.explode("codes").alias("code")).join(best, ["survey", "code"]).groupBy("parcel_id").agg(F.count("*").alias("n"), F.first("found").alias("found")).where("n = 1").select("parcel_id", "found")
    by_number = loose.where("survey IS NOT NULL AND code IS NOT NULL").groupBy("survey", "code").agg(F.min("parcel_id").alias("together"))
    settled = loose.drop("object").join(asked, "parcel_id", "left").join(by_number, ["survey", "code"], "left").withColumn("object", F.coalesce("found", "together", "parcel_id")).drop("found", "together")
    grouped = placed.where("object IS NOT NULL").unionByName(settled)
    return materialise(grouped), truth, weights


def keepers(grouped: DataFrame, sources: DataFrame) -> DataFrame:
    """object, keeper_id: the record with the most values, then the most trusted source, the latest capture, the smallest id."""
    trusted = grouped.join(sources.select("source", "trust").groupBy("source").agg(F.max("trust").alias("trust")), "source", "left")
    rank = F.struct(F.col("present"), F.coalesce("trust", F.lit(-1)).alias("trust"), F.col("captured_at").alias("at"), (-F.col("parcel_id")).alias("id"))
    return trusted.groupBy("object").agg(F.max_by("parcel_id", rank).alias("keeper_id"))


def same_parcel_pairs(parcels: DataFrame, villages: DataFrame, sources: DataFrame) -> DataFrame:
    """parcel_id_a < parcel_id_b of the same parcel, with the keeper of their set.

    ``parcels``: parcel_id, survey_number, village, lgd_village_code, polygon, source_crs, area_ha, land_use, source,
    captured_at. Each pair has one row, whatever the order of rows; a parcel_id that is delivered again counts once
    (its latest row, see clean()); rows with a null id are left out. Nulls in other columns are values that are not
    present; a null coordinate system is that of the surroundings. Ties of a keeper are broken by its rule. Other columns are ignored; empty tables give no rows.
    """
    grouped, _, _ = group_records(parcels, villages, sources)
    member = grouped.select("object", "parcel_id")
    pairs = member.withColumnRenamed("parcel_id", "parcel_id_a").join(member.withColumnRenamed("parcel_id", "parcel_id_b"), "object").where("parcel_id_a < parcel_id_b")
    return pairs.join(keepers(grouped, sources), "object").select("parcel_id_a", "parcel_id_b", "keeper_id")


def ring_claims(grouped: DataFrame) -> DataFrame:
    """object, parcel_id, ring_class: the records with a ring, those of one object in classes that agree in place, size and shape.

    Nearly equal rings of an object are one node before any are compared; classes are the components of the nodes that agree.
    """
    fine = F.sqrt("shape_area") * RING_PLACE / 8
    shaped = grouped.where("shape_area IS NOT NULL").select("object", "parcel_id", "cx", "cy", "shape_area", F.col("length").alias("perimeter"))
    step = F.pow(F.lit(2.0), F.floor(F.log2(fine)))
    cell = {"_s": step, "_u": F.floor(F.col("cx") / step), "_v": F.floor(F.col("cy") / step), "_a": F.floor(F.log("shape_area") * 100), "_p": F.floor(F.log("perimeter") * 100)}
    celled = shaped.withColumns(cell)
    nodes = celled.groupBy("object", *cell).agg(F.min("parcel_id").alias("node"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.avg("shape_area").alias("area"), F.avg("perimeter").alias("perimeter"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for found in frame["found"]:
                left = sorted((r["node"], r["cx"], r["cy"], r["area"], r["perimeter"]) for r in found)
                while left:
                    first, *left = left
                    open_nodes = [first]
                    while open_nodes:
                        node, x, y, area, length = open_nodes.pop()
                        out.append((node, str(first[0])))
                        near = [r for r in left if math.hypot(r[1] - x, r[2] - y) <= RING_PLACE * math.sqrt(max(area, r[3])) and max(area, r[3]) <= RING_SIZE * min(area, r[3]) and max(length, r[4]) <= RING_SIZE * min(length, r[4])]
                        taken = {r[0] for r in near}
                        left = [r for r in left if r[0] not in taken]
                        open_nodes += near
            yield pd.DataFrame(out, columns=["node", "ring_class"])

    classes = nodes.groupBy("object").agg(F.collect_list(F.struct("node", "cx", "cy", "area", "perimeter")).alias("found")).select("found").mapInPandas(run, "node long, ring_class string")
    return celled.join(nodes.select("object", *cell, "node"), ["object", *cell]).join(classes, "node").select("object", "parcel_id", "ring_class")


def survivors(parcels: DataFrame, villages: DataFrame, sources: DataFrame) -> DataFrame:
    """The surviving record of each set: its keeper, and for each field the value that truth discovery supports most.

    Result: keeper_id, records, survey (key) and survey_support, lgd_village_code and village_support (share of the
    weighted votes), village (its name in the reference list), polygon (as delivered), polygon_support and ring_from
    (the record whose ring is kept: of the records that claim the best supported ring, that of the most reliable source,
    then the latest, then the smallest id). Inputs as in same_parcel_pairs(); a set's fields are null where no record has them.
    """
    grouped, _, weights = group_records(parcels, villages, sources)
    told = grouped.select("object", F.lit("survey").alias("field"), F.col("survey").alias("value"), "source").unionByName(grouped.select("object", F.lit("code").alias("field"), F.col("code").cast("string").alias("value"), "source"))
    claimed = materialise(ring_claims(grouped))
    rung = grouped.join(claimed.select("parcel_id", "ring_class"), "parcel_id")
    told = told.unionByName(rung.select("object", F.lit("ring").alias("field"), F.col("ring_class").alias("value"), "source"))
    truth, weights = discover(told, weights)
    fields = truth.groupBy("object").pivot("field", ["survey", "code", "ring"]).agg(F.first("value").alias("value"), F.first("share").alias("share"))
    rank = F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), F.col("captured_at").alias("at"), (-F.col("parcel_id")).alias("id"))
    best = truth.where("field = 'ring'").select("object", F.col("value").alias("ring_class"))
    rings = rung.join(best, ["object", "ring_class"]).join(weights, "source", "left").groupBy("object").agg(F.max_by(F.struct(F.col("parcel_id").alias("ring_from"), "row_key"), rank).alias("r")).select("object", "r.*")
    drawn = parcels.select(F.col("parcel_id").alias("ring_from"), F.xxhash64(*COMPARED).alias("row_key"), "polygon").groupBy("ring_from", "row_key").agg(F.any_value("polygon").alias("polygon"))  # equal rows
    rings = rings.join(drawn, ["ring_from", "row_key"]).drop("row_key")
    size = grouped.groupBy("object").agg(F.count("*").alias("records"))
    out = keepers(grouped, sources).join(size, "object").join(fields, "object", "left").join(rings, "object", "left")
    names = villages.select(F.col("lgd_village_code").cast("string").alias("code_value"), "village").groupBy("code_value").agg(F.min("village").alias("village"))
    return out.join(names, "code_value", "left").select("keeper_id", "records", F.col("survey_value").alias("survey"), F.round("survey_share", 6).alias("survey_support"), F.col("code_value").cast("long").alias("lgd_village_code"), F.round("code_share", 6).alias("village_support"), "village", "ring_from", F.round("ring_share", 6).alias("polygon_support"), "polygon")
