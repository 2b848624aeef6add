"""Field sketches and the parcel records of the same plot, by a cascade of rules.

Each rule is an exact join on keys: village and number, place and number, place and size, and so on, from strong to
weak. A sketch that a rule resolves leaves the cascade.

A rule's confidence is its labelled precision. Sketches whose village, number, area, perimeter and place all single out
one plot are labelled with it. Each rule is tried on labelled sketches that were made like those it is for: what the
rule doesn't ask for is hidden, and what it forgives is done to them (a lost part of the number, a misread digit). For
the share of sketches that the cascade can't resolve, the plot itself is withheld, so that any match is wrong.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwright.llm.cadastre import name_key, resolve_villages, survey_key
from parcelwright.llm.survivors import group_records, village_of_neighbours
from parcelwright.plans.checkpoints import materialise

REACH = 48.0  # metres within which a rough centre lies from the centroid
AREA_ERROR, PERIMETER_ERROR = 0.06, 0.026  # as differences of logarithms
TILE = 64.0  # side of the squares that places are joined on; more than REACH
LABELLED = 4_000  # labelled sketches that rules are tried on, at most, by the smallest hashes
TIE = 1.0  # the second best candidate must be this much worse where only size decides

_FILE = r"(?i)^(?:.*[/\\])?([^_/\\-]+)[_-]([^_-]+)[_-]([^_-]+)[_-](.*?)(?:_rev\d+)?\.dxf$"


def main_number(survey: Column) -> Column:
    return F.substring_index(survey, "/", 1)


def wildcards(survey: Column) -> Column:
    """The spellings of a number with one digit of its main part left open."""
    main = main_number(survey)
    rest = F.substring(survey, F.length(main) + 1, F.length(survey))
    return F.transform(F.sequence(F.lit(1), F.length(main)), lambda i: F.concat(F.substring(main, F.lit(1), i - 1), F.lit("?"), F.substring(main, i + 1, F.length(main)), rest))


def prepare_sketches(sketches: DataFrame, villages: DataFrame) -> DataFrame:
    """fmb_id, codes, numbers, mains, x, y, area, perimeter, corners of each sketch, read from its header and its file name."""
    part = lambda n: F.when(F.regexp_extract("m1_file", _FILE, n) != "", F.regexp_extract("m1_file", _FILE, n))
    number = lambda c: F.when(~F.isnan(c), c)
    read = sketches.select(
        "fmb_id", survey_key(F.col("survey")).alias("s1"), name_key(F.col("header_village")).alias("h"), part(1).alias("district"), part(2).alias("taluk"), part(3).alias("v"), survey_key(F.regexp_replace(part(4), "[_-]", "/")).alias("s2"),
        number(F.col("placed_x")).alias("x"), number(F.col("placed_y")).alias("y"), number(F.col("stated_area_ha")).alias("area"), number(F.col("perimeter_m")).alias("perimeter"), F.col("n_corners").alias("corners"),
    )
    read = read.withColumns({"district": name_key(F.col("district")), "taluk": name_key(F.col("taluk")), "f1": name_key(F.col("v")), "f2": F.when(F.col("v").rlike(r"^T\p{Lu}"), name_key(F.expr("substring(v, 2)")))})
    spelled = read.select(F.explode(F.array("h", "f1", "f2")).alias("name"))
    found = materialise(resolve_villages(spelled, villages))
    for column in ("h", "f1", "f2"):
        read = read.join(found.select(F.col("name").alias(column), F.col("codes").alias(f"codes_{column}")), column, "left")
    none = F.array().cast("array<bigint>")
    header = F.coalesce("codes_h", none)
    filed = F.when(F.size(F.coalesce("codes_f1", none)) > 0, F.col("codes_f1")).otherwise(F.coalesce("codes_f2", none))
    both = F.array_intersect(header, filed)
    read = read.withColumn("codes", F.when(F.size(both) > 0, both).otherwise(F.array_union(header, filed)))
    read = materialise(read)
    # a district and taluk tell villages of one name apart
    where = villages.select(F.col("lgd_village_code").alias("code"), name_key(F.col("taluk")).alias("taluk"), name_key(F.col("district")).alias("district"))
    many = read.where(F.size("codes") > 1).select("fmb_id", "taluk", "district", F.explode("codes").alias("code"))
    told = many.join(where, ["code", "taluk", "district"]).groupBy("fmb_id").agg(F.collect_set("code").alias("told"))
    read = read.join(told, "fmb_id", "left").withColumn("codes", F.coalesce("told", "codes"))
    numbers = F.array_distinct(F.filter(F.array("s1", "s2"), lambda s: s.isNotNull()))
    return read.select("fmb_id", "codes", numbers.alias("numbers"), "x", "y", F.when(F.col("area") > 0, F.col("area")).alias("area"), F.when(F.col("perimeter") > 0, F.col("perimeter")).alias("perimeter"), "corners").withColumn("mains", F.array_distinct(F.transform("numbers", main_number)))


def prepare_plots(parcels: DataFrame, villages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object, number, code, cx, cy, plot_area, plot_perimeter, plot_corners of each parcel; its parcel_ids)."""
    grouped, truth, _ = group_records(parcels, villages, sources)
    with_length = grouped.withColumn("vertices", F.col("corners"))
    plots = with_length.groupBy("object").agg(
        F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.coalesce(F.avg("shape_area") / 10_000, F.avg(F.when(~F.isnan("area_ha"), F.col("area_ha")))).alias("plot_area"),
        F.avg(F.when(F.col("shape_area").isNotNull(), F.col("length"))).alias("plot_perimeter"), F.min(F.when(F.col("shape_area").isNotNull(), F.col("vertices"))).alias("plot_corners"),
        F.min_by("survey", F.struct(F.col("survey").isNull(), F.col("parcel_id"))).alias("any_number"), F.min_by("code", F.struct(F.col("code").isNull(), F.col("parcel_id"))).alias("any_code"),
    )
    best = truth.groupBy("object").pivot("field", ["survey", "code"]).agg(F.first("value"))
    plots = plots.join(best, "object", "left").withColumns({"number": F.coalesce("survey", "any_number"), "code": F.coalesce(F.col("code").cast("long"), "any_code")}).drop("survey", "any_number", "any_code")
    plots = materialise(plots)
    near = village_of_neighbours(plots.where("cx IS NOT NULL").select("object", "cx", "cy", "code")).withColumnRenamed("code", "near_code")
    return materialise(plots.join(near, "object", "left").withColumn("code", F.coalesce("code", "near_code")).drop("near_code")), grouped.select("object", "parcel_id")


def _far() -> Column:
    return F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))


def _misfit() -> Column:
    """How badly size and place fit, in units of their usual errors; what isn't known counts nothing."""
    area = F.abs(F.log(F.col("area") / F.col("plot_area"))) / 0.02
    round_it = F.abs(F.log(F.col("perimeter") / F.col("plot_perimeter"))) / 0.009
    corners = F.least(F.abs(F.col("corners") - F.col("plot_corners")), F.lit(3)) * 0.3
    zero = F.lit(0.0)
    return F.coalesce(area, zero) + F.coalesce(round_it, zero) + F.coalesce(_far() / 15, zero) + F.coalesce(corners, zero)


def _fits(value: str, other: str, error: float) -> Column:
    """Whether two measures agree; null if one isn't known."""
    return F.abs(F.log(F.col(value) / F.col(other))) <= error


@dataclass(frozen=True)
class Rule:
    """name; condition beside its keys; what a sketch that it is for lacks (LACKS), so that its precision can be tried; whether a near tie is refused."""

    name: str
    condition: Callable[[], Column]
    lacks: tuple[str, ...] = ()
    strict: bool = False


@dataclass(frozen=True)
class Pass:
    """Rules on the same keys, strong to weak: keys of a sketch and of a plot (arrays), and the rules."""

    sketch_keys: Callable[[], Column]
    plot_keys: Callable[[], Column]
    rules: tuple[Rule, ...]


def _misread(number: Column) -> Column:
    """A number with another digit in one place of its main part, both by the sketch's hash."""
    main, hashed = main_number(number), F.pmod(F.xxhash64("fmb_id", number), F.lit(9_000_000))
    at = F.pmod(hashed, F.length(main)).cast("int") + 1
    digit = F.pmod(F.substring(main, at, F.lit(1)).try_cast("int") + 1 + F.pmod(F.floor(hashed / 1000), F.lit(9)), F.lit(10)).cast("string")
    return F.concat(F.substring(main, F.lit(1), at - 1), F.coalesce(digit, F.lit("0")), F.substring(number, at + 1, F.length(number)))


# how a labelled sketch is made to lack something: column and its new value
LACKS: dict[str, dict[str, Callable[[], Column]]] = {
    "place": {"x": lambda: F.lit(None).cast("double"), "y": lambda: F.lit(None).cast("double")},
    "size": {"area": lambda: F.lit(None).cast("double"), "perimeter": lambda: F.lit(None).cast("double"), "corners": lambda: F.lit(None).cast("int")},
    "village": {"codes": lambda: F.array().cast("array<bigint>")},
    "part": {"numbers": lambda: F.col("mains")},
    "digit": {"numbers": lambda: F.transform("numbers", _misread), "mains": lambda: F.transform("numbers", lambda n: main_number(_misread(n)))},
    "number": {"numbers": lambda: F.array().cast("array<string>"), "mains": lambda: F.array().cast("array<string>")},
}


def _pairs(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws("|", a.cast("string"), b))))


def _tiles(x: str, y: str, around: bool) -> Column:
    u, v = F.floor(F.col(x) / TILE), F.floor(F.col(y) / TILE)
    steps = F.array(*[F.lit(i) for i in ((-1, 0, 1) if around else (0,))])
    made = F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.concat_ws("|", (u + a).cast("string"), (v + b).cast("string")))))
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), made)


def passes() -> list[Pass]:
    yes, no = F.lit(True), F.lit(False)
    area, length = lambda: _fits("area", "plot_area", AREA_ERROR), lambda: _fits("perimeter", "plot_perimeter", PERIMETER_ERROR)
    near = lambda: _far() <= REACH
    maybe = lambda c: F.coalesce(c, yes)
    surely = lambda c: F.coalesce(c, no)
    same = lambda: F.array_contains("numbers", F.col("number"))
    same_main = lambda: F.array_contains("mains", main_number(F.col("number")))
    one_off = lambda: F.exists("numbers", lambda n: (F.levenshtein(main_number(n), main_number(F.col("number"))) <= 1) & (F.length(main_number(n)) == F.length(main_number(F.col("number")))))
    numbered = lambda: _pairs(F.col("codes"), F.col("numbers"))
    plot_numbered = lambda: F.array(F.concat_ws("|", F.col("code").cast("string"), F.col("number")))
    sized = lambda: maybe(area()) & maybe(length())
    village_main = lambda: F.array(F.concat_ws("|", F.col("code").cast("string"), main_number(F.col("number"))))
    open_digit = lambda: F.transform(wildcards(F.col("number")), lambda w: F.concat_ws("|", F.col("code").cast("string"), w))
    whole = lambda: F.exists("numbers", lambda n: ~n.contains("/"))
    unknown = lambda: F.col("number").isNull() | (F.size("numbers") == 0)
    return [
        Pass(
            numbered,
            plot_numbered,
            (
                Rule("village, number, size", lambda: surely(area()) & maybe(length()) & maybe(near()), ("place",)),
                Rule("village, number", lambda: sized() & maybe(near()), ("place", "size")),
            ),
        ),
        Pass(
            lambda: _tiles("x", "y", True),
            lambda: _tiles("cx", "cy", False),
            (
                Rule("place, number", lambda: surely(near()) & sized() & same(), ("village", "size")),
                Rule("place, main number, size", lambda: surely(near()) & sized() & same_main(), ("village", "part")),
                Rule("place, misread number", lambda: surely(near()) & sized() & (surely(area()) | surely(length())) & (one_off() | unknown()), ("village", "digit")),
            ),
        ),
        Pass(lambda: _pairs(F.col("codes"), F.col("mains")), village_main, (Rule("village, main number, size", lambda: sized() & (surely(area()) | surely(length())) & maybe(near()) & whole(), ("place", "part"), True),)),
        Pass(lambda: _pairs(F.col("codes"), F.flatten(F.transform("numbers", wildcards))), open_digit, (Rule("village, misread number, size", lambda: surely(area()) & surely(length()) & maybe(near()), ("place", "digit"), True),)),
    ]


def _met(step: Pass, sketches: DataFrame, plots: DataFrame, rule: Column) -> DataFrame:
    """fmb_id, probe, object, c: the best candidate of each sketch that ``step`` finds, where no near tie is refused; c has its rule and how it fits."""
    fits = sketches.withColumn("k", F.explode(step.sketch_keys())).join(plots.withColumn("k", F.explode(step.plot_keys())), "k")
    exact = F.coalesce(F.array_contains("numbers", F.col("number")).cast("int"), F.lit(0))
    sure = (_far() <= REACH) & _fits("area", "plot_area", AREA_ERROR) & _fits("perimeter", "plot_perimeter", PERIMETER_ERROR) & (exact == 1)
    fits = fits.withColumns({"rule": rule, "exact": exact, "misfit": _misfit(), "sure": F.coalesce(sure, F.lit(False))}).where("rule IS NOT NULL")
    # one plot may be met by several keys: it is one candidate
    once = fits.groupBy("fmb_id", "probe", "object").agg(F.min(F.struct("rule", -F.col("exact"), "misfit", "sure")).alias("c"))
    ranked = once.groupBy("fmb_id", "probe").agg(F.min(F.struct("c", "object")).alias("first"), F.min("c.misfit").alias("least"), F.count("*").alias("plots"), F.count_if(F.col("c.sure")).alias("sure_plots"), F.sort_array(F.collect_list("c.misfit")).alias("misfits"))
    second = F.get("misfits", F.lit(1))
    clear = ~F.lit(all(r.strict for r in step.rules)) | second.isNull() | (second - F.col("least") >= TIE)
    return ranked.where(clear).select("fmb_id", "probe", "first.object", F.col("first.c.rule").alias("rule"), ((F.col("plots") == 1) & (F.col("sure_plots") == 1)).alias("sure"))


def _first_rule(step: Pass, asked: Column | None = None) -> Column:
    """The number of the strongest rule of ``step`` that a candidate meets; with ``asked`` only that rule is tried."""
    rule = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(step.rules))):
        met = F.coalesce(r.condition(), F.lit(False))
        rule = F.when(met if asked is None else met & (asked == i), i).otherwise(rule)
    return rule


def precision(cascade: list[Pass], labelled: DataFrame, plots: DataFrame, unheld: float) -> DataFrame:
    """rule, confidence: (right + 1) / (matches + 2) of each rule on ``labelled`` sketches (those of the cascade, and label) that lack what the rule says.

    For a share ``unheld`` of the sketches, by their hashes, the label's plot is withheld.
    """
    out = None
    for step in cascade:
        probes = None
        for i, r in enumerate(step.rules):
            probe = labelled.withColumn("probe", F.lit(i))
            for lack in r.lacks:
                probe = probe.withColumns({c: value() for c, value in LACKS[lack].items()})
            probes = probe if probes is None else probes.unionByName(probe)
        withheld = F.pmod(F.xxhash64(F.lit(7), "fmb_id"), F.lit(10_000)) < unheld * 10_000
        rule = F.when(~withheld | (F.col("object") != F.col("label")), _first_rule(step, F.col("probe")))
        found = _met(step, probes, plots, rule).join(labelled.select("fmb_id", "label"), "fmb_id")
        names = F.array(*[F.lit(r.name) for r in step.rules])
        judged = found.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("object") == F.col("label")).alias("k")).select(F.get(names, F.col("rule")).alias("rule"), ((F.col("k") + 1.0) / (F.col("n") + 2.0)).alias("confidence"))
        out = judged if out is None else out.unionByName(judged)
    return out


def _resolve(sketches: DataFrame, parcels: DataFrame, villages: DataFrame, sources: DataFrame, cascade: list[Pass]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(the match of each resolved sketch: fmb_id, object, rule, sure; the records of each object; the sketches; the plots)."""
    columns = ["survey", "header_village", "m1_file", "n_corners", "stated_area_ha", "perimeter_m", "placed_x", "placed_y"]
    late = F.col("run_at") if "run_at" in sketches.columns else F.lit(None).cast("timestamp")
    single = sketches.where("fmb_id IS NOT NULL").select("fmb_id", F.struct(*columns).alias("s"), F.struct(late.alias("at"), F.xxhash64(*columns).alias("h")).alias("o")).groupBy("fmb_id").agg(F.max_by("s", "o").alias("s")).select("fmb_id", "s.*")
    waiting = materialise(prepare_sketches(single, villages)).withColumn("probe", F.lit(0))
    plots, members = prepare_plots(parcels, villages, sources)
    resolved = None
    for step in cascade:
        left = waiting if resolved is None else waiting.join(resolved, "fmb_id", "left_anti")
        names = F.array(*[F.lit(r.name) for r in step.rules])
        done = materialise(_met(step, left, plots, _first_rule(step)).select("fmb_id", "object", F.get(names, F.col("rule")).alias("rule"), "sure"))
        resolved = done if resolved is None else resolved.unionByName(done)
    return resolved, members, waiting, plots


def matches(sketches: DataFrame, parcels: DataFrame, villages: DataFrame, sources: DataFrame) -> DataFrame:
    """fmb_id, parcel_id of link(), without trying the rules for their confidence."""
    resolved, members, _, _ = _resolve(sketches, parcels, villages, sources, passes())
    return resolved.join(members, "object").select("fmb_id", "parcel_id")


def link(sketches: DataFrame, parcels: DataFrame, villages: DataFrame, sources: DataFrame, cascade: list[Pass] | None = None) -> DataFrame:
    """The parcel records of the plot that each sketch shows: fmb_id, parcel_id, rule, confidence.

    ``sketches``: fmb_id, survey, header_village, m1_file, n_corners, stated_area_ha, perimeter_m, placed_x, placed_y.
    A sketch has the rows of all records of one parcel, or none if no rule finds one; of rows with one fmb_id that with
    the latest run_at counts, if there is such a column, then that with the largest hash; a parcel_id that is delivered
    again counts once (see survivors.clean()); null ids are left out. A null, blank or NaN
    attribute neither speaks for a match nor against it; a known place, area or perimeter that disagrees rules one
    out. Of several candidates the one whose measures fit best wins, then the smallest parcel; where only size tells
    them apart, a near tie is no match. A rule's confidence is that of precision(); where there are no labelled
    sketches it is 1/2. Other columns are ignored; empty tables give no rows.
    """
    cascade = cascade or passes()
    resolved, members, waiting, plots = _resolve(sketches, parcels, villages, sources, cascade)
    sketched, found = waiting.count(), resolved.count()
    labelled = materialise(waiting.drop("probe").join(resolved.where("sure").select("fmb_id", F.col("object").alias("label")), "fmb_id").orderBy(F.xxhash64("fmb_id"), "fmb_id").limit(LABELLED))
    trust = precision(cascade, labelled, plots, 1 - found / sketched if sketched else 0.0)
    return resolved.join(members, "object").join(trust, "rule", "left").select("fmb_id", "parcel_id", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
