"""Cleaning of cadastral records: survey numbers, village names, rings. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits and sub-division letters in other scripts, and the letters that are read for digits.
OTHER_DIGITS, PLAIN_DIGITS = "０１２３４５６７８９௦௧௨௩௪௫௬௭௮௯०१२३४५६७८९", "0123456789" * 3
OTHER_LETTERS, PLAIN_LETTERS = "அஆஇஈஉஊ", "ABCDEF"
MISREAD, MEANT = "OISBLZ", "015812"

_PREFIX = r"^\s*(?:SURVEY\s*NO|S\.?\s*F\.?(?:\s*NO)?|R\.?\s*S\.?|NO)[.\s:]*"
_NAME_NOISE = r"(?:^|\s)(?:VILLAGE|VLG|VILL|REV|GRAMAM|NO)(?=\s|$)|\(V\)|\d+"


def has_text(c: Column) -> Column:
    """Whether a string has a letter or digit."""
    return c.isNotNull() & c.rlike(r"[\p{L}\p{N}]")


def survey_key(c: Column) -> Column:
    """One spelling of a survey number, like 118/2A1; null if it has no number.

    Digits and letters of other scripts are written plainly, prefixes and leading zeros go, and letters before the
    first separator count as the digits they are misread for. Separators go, but one between two digits stays as a dot.
    """
    plain = F.upper(F.translate(c, OTHER_DIGITS + OTHER_LETTERS, PLAIN_DIGITS + PLAIN_LETTERS))
    bare = F.regexp_replace(plain, _PREFIX, "")
    head = F.regexp_extract(bare, rf"^\s*([0-9{MISREAD}]+)", 1)
    main = F.regexp_replace(F.translate(head, MISREAD, MEANT), "^0+", "")
    rest = F.regexp_replace(bare, rf"^\s*[0-9{MISREAD}]+", "")
    rest = F.regexp_replace(rest, r"^[^0-9A-Z]+|[^0-9A-Z]+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?<=[0-9])[^0-9A-Z]+(?=[0-9])", "."), r"[^0-9A-Z.]+", "")
    return F.when(has_text(c) & (main != ""), F.when(rest != "", F.concat_ws("/", main, rest)).otherwise(main))


def name_key(c: Column) -> Column:
    """One spelling of a place name: upper case letters and marks without words and numbers around the name; null if none is left."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(c), r"[.,:_\-]", " "), _NAME_NOISE, " ")
    kept = F.regexp_replace(plain, r"[^\p{L}\p{M}]+", "")
    return F.when(kept != "", kept)


def ring_points(ring: Column) -> Column:
    """The vertices of a ring that are there and finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(ring, lambda p: p.isNotNull() & finite(p["x"]) & finite(p["y"]))


def with_shape(df: DataFrame, ring: str = "polygon") -> DataFrame:
    """Adds cx, cy (centroid), shape_area (m2) and corners (distinct vertices) of a ring; nulls where it has no area.

    Swapped axes are put right: in these zones northings exceed eastings.
    """
    pts = df.withColumn("_p", ring_points(F.col(ring)))
    swapped = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["x"] - p["y"]) > 0
    pts = pts.withColumn("_p", F.when(swapped, F.transform("_p", lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))).otherwise(F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    pts = pts.withColumn("corners", F.size(F.array_distinct("_p"))).withColumn("_o", F.get("_p", F.lit(0)))
    pts = pts.withColumn("_n", F.concat(F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))), F.slice("_p", 1, 1)))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        cross = x1 * y2 - x2 * y1
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (x1 + x2) * cross).alias("x"), (s["y"] + (y1 + y2) * cross).alias("y"))

    edges = F.zip_with("_p", "_n", lambda p, n: F.struct((p["x"] - F.col("_o.x")).alias("x1"), (p["y"] - F.col("_o.y")).alias("y1"), (n["x"] - F.col("_o.x")).alias("x2"), (n["y"] - F.col("_o.y")).alias("y2")))
    pts = pts.withColumn("_s", F.when(F.col("corners") >= 3, F.aggregate(edges, start, step)))
    real = F.abs(F.col("_s.a")) > 2.0
    return pts.withColumns(
        {
            "cx": F.when(real, F.col("_o.x") + F.col("_s.x") / (3 * F.col("_s.a"))),
            "cy": F.when(real, F.col("_o.y") + F.col("_s.y") / (3 * F.col("_s.a"))),
            "shape_area": F.when(real, F.abs(F.col("_s.a")) / 2),
        }
    ).drop("_p", "_n", "_o", "_s")


def perimeter(ring: Column) -> Column:
    """Length of a ring, closed by its first vertex, in whatever axis order."""
    pts = ring_points(ring)
    following = F.concat(F.slice(pts, 2, F.greatest(F.size(pts), F.lit(1))), F.slice(pts, 1, 1))
    return F.aggregate(F.zip_with(pts, following, lambda p, n: F.hypot(p["x"] - n["x"], p["y"] - n["y"])), F.lit(0.0), lambda s, d: s + d)


EDITS = 2  # letters by which a misspelled name may differ


def _piece(name: Column, length: Column, i: Column, shift: Column) -> Column:
    """The ``i``-th of EDITS + 1 even pieces of names of ``length``, cut out of ``name`` at its place moved by ``shift``; null where that isn't within it."""
    begin, end = F.floor(i * length / (EDITS + 1)), F.floor((i + 1) * length / (EDITS + 1))
    cut = F.substring(name, (begin + 1 + shift).cast("int"), (end - begin).cast("int"))
    return F.when((begin + shift >= 0) & (end + shift <= F.length(name)), F.xxhash64(length, i, cut))


def pieces(name: Column) -> Column:
    """Hashes of a name's even pieces. Of two names within EDITS, one piece of the first stands untouched in the second, moved by EDITS at most."""
    return F.transform(F.sequence(F.lit(0), F.lit(EDITS)), lambda i: _piece(name, F.length(name), i, F.lit(0)))


def possible_pieces(name: Column) -> Column:
    """Hashes of all pieces() that a name within EDITS of this one may have in common with it."""
    moves = F.sequence(F.lit(-EDITS), F.lit(EDITS))
    of = lambda length: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(EDITS)), lambda i: F.transform(moves, lambda m: _piece(name, length, i, m))))
    return F.array_compact(F.array_distinct(F.flatten(F.transform(moves, lambda d: of(F.length(name) + d)))))


def resolve_villages(spellings: DataFrame, villages: DataFrame, shortest: int = 5) -> DataFrame:
    """Candidate villages of place names.

    ``spellings``: name (a name_key()); ``villages``: lgd_village_code, village, local_name. Result: name, codes (sorted
    array). A name's candidates are the villages it equals in either script; else those whose name it abbreviates (at
    least ``shortest`` characters); else the closest within two edits, found by the pieces they must share.
    Names without a candidate have no row; each name has one row; nulls are left out.
    """
    known = villages.select("lgd_village_code", F.explode(F.array(name_key(F.col("village")), name_key(F.col("local_name")))).alias("known")).where("known IS NOT NULL AND lgd_village_code IS NOT NULL").distinct()
    # a fixed number of partitions: names are few bytes, but comparing them is work
    names = spellings.select("name").where("name IS NOT NULL").distinct().repartition(spellings.sparkSession.sparkContext.defaultParallelism, "name")
    equal = names.join(known, F.col("name") == F.col("known")).select("name", "lgd_village_code", F.lit(0).alias("far"))
    heads = known.select("lgd_village_code", "known", F.explode(F.transform(F.sequence(F.lit(shortest), F.greatest(F.length("known"), F.lit(shortest))), lambda n: F.substring(F.col("known"), F.lit(1), n))).alias("head"))
    begun = names.where(F.length("name") >= shortest).join(heads, F.col("name") == F.col("head")).where(F.length("name") < F.length("known")).select("name", "lgd_village_code", F.lit(1).alias("far"))
    told = equal.unionByName(begun)
    # only names that are neither listed nor short for a listed one are compared letter by letter
    left = names.where(F.length("name") >= shortest).join(told.select("name").distinct(), "name", "left_anti").select("name", F.explode(possible_pieces(F.col("name"))).alias("k"))
    right = known.where(F.length("known") >= shortest).select("lgd_village_code", "known", F.explode(pieces(F.col("known"))).alias("k"))
    close = left.join(right, "k").withColumn("edits", F.levenshtein("name", "known", EDITS)).where("edits > 0").select("name", "lgd_village_code", (F.col("edits") + 1).alias("far"))
    every = told.unionByName(close).groupBy("name", "far").agg(F.sort_array(F.collect_set("lgd_village_code")).alias("codes"))
    return every.groupBy("name").agg(F.min_by("codes", "far").alias("codes"))
