"""Texts that lost their end, and how often each source cuts.

Two kinds of evidence meet in one posterior. The ending: does the text stop where sentences stop, by counts of what
follows the same last words anywhere in the corpus? The length: for each source and field a log-normal distribution of
whole lengths is fitted by maximum likelihood, cut texts counting as right-censored at their length; a length that far
more texts have than it allows is a candidate limit, and gives its texts a censoring prior.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwright.llm.tokens import slices
from parcelwright.plans.checkpoints import materialise

ORDERS = 6  # words of context, at most
BITMAP_BITS = 1 << 26  # of the filter for contexts that occur as endings; its size is fixed
TERSE_WORDS = 4  # up to so many words a text may be a note without a full stop
LENGTH_MARGIN = 6.0  # standard deviations by which a candidate limit exceeds its expected number of texts
UNFINISHED_SHARE = 0.35  # of the texts at a candidate limit, those whose ending speaks for a cut, at least
PRIOR_TEXTS, PRIOR_DEVIATION = 2.0, 0.5  # a prior of the length fit, in texts, so that few texts give a wide distribution
EM_ROUNDS = 12
HIGHEST_PRIOR = 0.97  # no length makes a cut surer than that

# Likelihoods of an ending's form: of a cut text, and of a whole one.
NO_STOP = math.log(0.97 / 0.10)
FULL_STOP = math.log(0.015 / 0.85)
MARKED, BROKEN_JSON, WHOLE_JSON, TRAILING_BLANK, TERSE, REPEATED = 8.0, 12.0, -12.0, 3.0, -3.0, -8.0
REPEATED_SHARE = 0.02  # a note that is repeated must be this share of the sentences that begin like it, or they may be cut

_STOPS, _CLOSERS = ".!?।…", "\"'»”’)]"
_DECORATION = re.compile(r"(?:\s*(?:[:;]-?[)(DP]|[☀-➿\U0001F300-\U0001FAFF️‍])+)+$")
_MARK = re.compile(r"\s*(?:[\[(]\s*(?:\.{3}|…|more|cut|truncated|continued|clipped)\s*[\])])$", re.IGNORECASE)
_ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…)$")
_SIGNED = re.compile(r"\n--\s*\n[^\n]{1,60}$")
_LISTED = re.compile(r"\n[-*•]\s+[^\s]+$")
_DIGITS = re.compile(r"\d\w*(?:[/.,:-]\d\w*)*")
_EDGE = "\"'«»“”‘’()[]{}<>,;:*_-–—.!?।…"

_START, _MIX = np.uint64(0x51ED270B9F1C64A7), np.uint64(0x9E3779B97F4A7C15)


def core(token: str) -> str:
    """A token without the punctuation around it, numbers as 0; upper and lower case differ, as beginnings of sentences do."""
    return _DIGITS.sub("0", token.strip(_EDGE))


def stops(token: str) -> bool:
    """Whether a token ends with a full stop or the like, perhaps within quotes or brackets."""
    return token.rstrip(_CLOSERS)[-1:] in _STOPS if token.rstrip(_CLOSERS) else False


def beginning_hashes(text: str) -> list[int]:
    """The 64-bit hash of each beginning of a text and last of itself; the same in every process."""
    value, out = 0xCBF29CE484222325, []
    for sign in text:
        for byte in sign.encode("utf-8", "replace"):
            value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        out.append(value)
    return out or [value]


@lru_cache(maxsize=1 << 18)
def token_hash(text: str) -> int:
    return beginning_hashes(text)[-1]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _mix_one(a: int, b: int) -> int:
    """_mix() of two numbers."""
    x = ((a ^ (b + int(_MIX) + (a << 6) + (a >> 2))) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)


def _contexts(hashes: list[int], kind: int) -> list[int]:
    """Hashes of the last one, two, ... of these (up to ORDERS), the first of them standing after a sentence start."""
    value = _mix_one(hashes[-1], kind)
    out = [value]
    for k in range(1, min(ORDERS, len(hashes) + 1)):
        value = _mix_one(value, hashes[-1 - k] if k < len(hashes) else int(_START))
        out.append(value)
    return [v - (1 << 64) if v >> 63 else v for v in out]


def last_sentence(text: str) -> list[str]:
    """The tokens after the last one that ends a sentence or line."""
    tokens = text.rstrip().rsplit("\n", 1)[-1].split()
    for i in range(len(tokens) - 2, -1, -1):
        if stops(tokens[i]) and core(tokens[i]):
            return tokens[i + 1 :]
    return tokens


def json_form(bare: str) -> float | None:
    """Evidence of a text that is JSON, whole or broken off; None for other texts, also for those that begin with a bracket."""
    if bare[:1] not in ("{", "[") or bare[:2] in ("[.", "[…"):
        return None
    try:
        json.loads(bare)
        return WHOLE_JSON
    except (ValueError, RecursionError):
        return BROKEN_JSON if bare[:1] == "{" or bare[:2] in ('["', "[{", "[[") else None


def ending(text: str) -> tuple[float, bool, list[int], list[int], int | None]:
    """(evidence of the form, whether the text is prose, contexts of the last words, contexts of the last word as a beginning, note).

    The evidence is a log-likelihood ratio of cut to whole. The contexts are empty where the form alone decides. The
    note is a hash of a terse text with numbers as 0, and None for others.
    """
    bare = text.rstrip()
    form = json_form(bare)
    if form is not None:
        return form, False, [], [], None
    words = bare.count(" ") + bare.count("\n") + 1
    prose = words > TERSE_WORDS
    evidence = 0.0
    if bare[-1:] in ("]", ")") and _MARK.search(bare):
        return MARKED, prose, [], [], None
    # patterns are only asked where the last character allows them
    plain = _DECORATION.sub("", bare) if bare[-1:] in tuple(")(DP]") or bare[-1:] >= "\u200d" else bare
    decorated = len(plain) < len(bare) and bool(plain)
    if plain.endswith(("...", "…")):
        plain = _ELLIPSIS.sub("", plain).rstrip()
    stop = stops(plain)
    numeric = plain[-1:] in (".", ",") and plain[-2:-1].isdigit()
    if (stop and not numeric) or decorated or ("\n" in plain and (_SIGNED.search(plain) or _LISTED.search(plain))):
        return FULL_STOP, prose, [], [], None
    if numeric and stop:
        evidence += FULL_STOP / 2
    else:
        evidence += NO_STOP
    if text[-1:].isspace() and not text.endswith("\n"):
        evidence += TRAILING_BLANK
    if plain[-1:] in tuple(",;:(-[«“\"") and not stop:
        evidence += 2.0
    if not prose:
        evidence += TERSE
    tokens = [core(t) for t in last_sentence(plain)]
    hashes = [token_hash(t) for t in tokens]
    if not tokens:
        return evidence, prose, [], [], None
    note = None if prose else _contexts(hashes[::-1], 3)[-1]
    return evidence, prose, _contexts(hashes, 1), _contexts(hashes, 2)[:2], note


FEATURES = "turn_id long, source string, field_name string, length int, text_hash long, form double, prose boolean, contexts array<long>, beginnings array<long>, note long"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        rows = [ending(t) for t in texts]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["turn_id"], batch["source"], batch["field_name"], pa.array([len(t) for t in texts], pa.int32()), batch["text_hash"], pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], longs), pa.array([r[3] for r in rows], longs), pa.array([r[4] for r in rows], pa.int64())],
            names=["turn_id", "source", "field_name", "length", "text_hash", "form", "prose", "contexts", "beginnings", "note"],
        )


def corpus_counts(texts: list[str], wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """What follows each context: (context, times a sentence ended there, times it went on), sentences, characters.

    Beginnings count under the contexts of ``_contexts(..., 2)``: how often a longer word begins like that.
    ``wanted`` keeps the contexts that may occur as an ending.
    """
    chars = sum(map(len, texts))
    texts = [t for t in texts if t[:1] not in ("{", "[") or json_form(t.rstrip()) is None]
    lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    words = pc.utf8_split_whitespace(pc.list_flatten(lines))
    line = pc.list_parent_indices(words).to_numpy()
    coded = pc.list_flatten(words).dictionary_encode()
    spelled, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    there = np.array([w != "" for w in spelled], bool)[kind] if len(kind) else np.zeros(0, bool)
    line, kind = line[there], kind[there]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, chars
    text_of = pc.list_parent_indices(lines).to_numpy()[line]
    final = np.r_[line[1:] != line[:-1], True]
    last_line = np.zeros(len(texts), np.int64)
    last_line[text_of] = line  # in order, so the last stays
    ids: dict[str, int] = {}
    cores = [core(w) for w in spelled]
    core_id = np.array([ids.setdefault(c, len(ids)) if c else -1 for c in cores])
    stop_of = np.array([c != "" and stops(w) for w, c in zip(spelled, cores)])
    ends_text = final & (line == last_line[text_of])
    kept = core_id[kind] >= 0
    kind, line, final, ends_text = kind[kept], line[kept], final[kept], ends_text[kept]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, chars
    which, stop = core_id[kind], stop_of[kind]
    end, use = (stop | (final & ~ends_text)).astype(np.int64), stop | ~ends_text
    begins = np.r_[True, (line[1:] != line[:-1]) | stop[:-1]]
    place = np.arange(len(kind))
    pos = place - np.maximum.accumulate(np.where(begins, place, 0))
    names = list(ids)
    heads = [beginning_hashes(c) for c in names]
    hashes = np.array([v[-1] for v in heads], np.uint64)
    h = hashes[which]
    keys, stopped, goes = [], [], []

    def add(key: np.ndarray, stop: np.ndarray, go: np.ndarray) -> None:
        key = key.astype(np.int64)
        if wanted is not None:
            keep = wanted(key)
            key, stop, go = key[keep], stop[keep], go[keep]
        keys.append(key)
        stopped.append(stop)
        goes.append(go)

    value = _mix(h, np.full(len(h), 1, np.uint64))
    add(value[use], end[use], 1 - end[use])
    for k in range(1, ORDERS):
        back = np.r_[np.zeros(k, np.uint64), h[:-k]] if k <= len(h) else np.zeros(len(h), np.uint64)
        before = np.where(pos >= k, back, _START)
        value = _mix(value, before)
        fits = use & (pos >= k - 1)
        add(value[fits], end[fits], 1 - end[fits])
    # words as beginnings of longer ones, alone and after the word before
    previous = np.where(pos >= 1, np.r_[np.zeros(1, np.uint64), h[:-1]], _START)
    _, first, number = np.unique(_mix(h[use], previous[use]), return_index=True, return_counts=True)
    owned, before = which[use][first], previous[use][first]
    size = np.array([len(v) - 1 for v in heads])
    head = np.array([v for many in heads for v in many[:-1]], np.uint64)
    if len(head):
        alone = _mix(head, np.full(len(head), 2, np.uint64))
        # an ending's last word is asked for alone and with the word before it, so a beginning nobody asks for alone isn't asked for at all
        asked = np.ones(len(head), bool) if wanted is None else wanted(alone.astype(np.int64))
        owner = np.repeat(np.arange(len(names)), size)[asked]
        alone = alone[asked]
        low, high = np.searchsorted(owner, owned, "left"), np.searchsorted(owner, owned, "right")
        row = np.repeat(np.arange(len(owned)), high - low)
        picked = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)
        zero = np.zeros(len(row), np.int64)
        add(alone[picked], zero, number[row])
        add(_mix(alone[picked], before[row]), zero, number[row])
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(stopped), len(key)).astype(np.int64), np.bincount(where, np.concatenate(goes), len(key)).astype(np.int64), int(end.sum()), chars


def evidence_of(contexts: list[tuple[int, int]], beginnings: list[tuple[int, int]], per_char: float) -> float:
    """Log-likelihood ratio of cut to whole from the counts (ended, went on) of an ending's contexts, shortest first.

    A cut falls behind every character alike; a whole text stops where sentences stop. ``per_char``: sentences for each character.
    """
    known = [c for c in contexts if c[0] + c[1] > 0]
    second = contexts[1] if len(contexts) > 1 else contexts[0]
    beginning = beginnings[-1][1] if beginnings else 0
    if second[0] + second[1] == 0 and (beginning or (not known and beginnings and beginnings[0][1])):
        return 5.0 if beginning else 3.5  # the last word only occurs as the beginning of a longer one
    if not known:
        return 0.0  # a word that nothing is known of
    p = 0.08
    for stopped, went in contexts:
        if stopped + went:
            p = (stopped + p) / (stopped + went + 1.0)
    more = beginning / (beginning + second[0] + second[1]) if second[0] + second[1] else 0.0
    return -math.log(max(p * (1 - more), 1e-6)) + math.log(per_char)


def _censored_fit(length: np.ndarray, whole: np.ndarray, cut: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of log-length by maximum likelihood, the ``cut`` counts being right-censored at their length (EM)."""
    z = np.log(length)
    total = float((whole + cut).sum())
    mu = float((z * (whole + cut)).sum() / total)
    spread = lambda squares: math.sqrt(max(0.01, (squares + PRIOR_TEXTS * PRIOR_DEVIATION**2) / (total + PRIOR_TEXTS)))
    sd = spread(float(((z - mu) ** 2 * (whole + cut)).sum()))
    for _ in range(20):
        a = (z - mu) / sd
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in a])
        hazard = np.where(tail > 1e-12, np.exp(-a * a / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12), a)
        first, second = mu + sd * hazard, mu * mu + sd * sd + sd * (mu + z) * hazard
        mu = float((whole * z + cut * first).sum() / total)
        sd = spread(float((whole * z * z + cut * second).sum()) - total * mu * mu)
    return mu, sd


def fit_limits(cells: pd.DataFrame) -> pd.DataFrame:
    """The censoring prior by length of one source and field, from cells (length, prose, llr, n).

    Rows: length and prior for each candidate limit, and the prior of any other length at length -1.
    """
    length, llr, n = cells["length"].to_numpy(np.float64), cells["llr"].to_numpy(np.float64), cells["n"].to_numpy(np.float64)
    prose = cells["prose"].to_numpy(bool) & (length > 0)
    lengths, at = np.unique(length, return_inverse=True)
    base, prior = 0.05, np.full(len(lengths), 0.05)
    limit = np.zeros(len(lengths), bool)
    seen = np.bincount(at, n * prose, len(lengths))
    for _ in range(EM_ROUNDS):
        odds = np.log(prior[at] / (1 - prior[at])) + llr
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        cut, whole = np.bincount(at, n * post * prose, len(lengths)), np.bincount(at, n * (1 - post) * prose, len(lengths))
        outside = ~limit[at]
        base = float(np.clip((n * post)[outside].sum() / max(1.0, n[outside].sum()), 0.002, 0.5))
        prior = np.full(len(lengths), base)
        if prose.any():
            usable = lengths > 0
            mu, sd = _censored_fit(np.where(usable, lengths, 1.0), whole * usable, cut * usable)
            z = (np.log(np.maximum(lengths, 1.0)) - mu) / sd
            expected = (whole.sum() + cut.sum()) * np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * np.maximum(lengths, 1.0))
            unfinished = np.bincount(at, n * (llr > 0) * prose, len(lengths))
            limit = (seen > expected + LENGTH_MARGIN * np.sqrt(expected + 1)) & (unfinished > UNFINISHED_SHARE * seen)
            prior[limit] = np.clip(1 - expected[limit] / seen[limit], base, HIGHEST_PRIOR)
    rows = [(-1, base), *zip(lengths[limit].astype(int).tolist(), prior[limit].tolist())]
    return pd.DataFrame(rows, columns=["limit_length", "prior"])


def _fit_group(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    fitted = fit_limits(cells)
    fitted.insert(0, "field_name", key[1])
    fitted.insert(0, "source", key[0])
    return fitted


def values_of(turns: DataFrame, fields: tuple[str, ...] = ("message", "reply")) -> DataFrame:
    """turn_id, source ('' for null), field_name, text: one row for each value that isn't null or blank."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields]))
    read = turns.select(F.col("turn_id").cast("long").alias("turn_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), each.alias("v"))
    return read.select("turn_id", "source", "v.field_name", "v.text").where(F.length(F.trim("text")) > 0)


def judge(turns: DataFrame, fields: tuple[str, ...] = ("message", "reply")) -> DataFrame:
    """The posterior of each value of ``fields`` in ``turns`` (turn_id, source, the fields) that it lost its end.

    Result: turn_id, source, field_name, length (characters), llr (evidence of the ending), prior (of its length, source
    and field), posterior. Null, empty and blank values have no rows. A turn delivered again has its rows again, with
    the same figures; equal texts count once in the length distributions, so that copies make no limit. A null source
    is a source of its own named ''. Texts are read whole, of any length. Columns with other names are ignored; an
    empty table gives no rows.
    """
    values = values_of(turns, fields)
    spark = turns.sparkSession
    feats = materialise(values.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_features, FEATURES))
    endings = feats.where(F.size("contexts") > 0).select("contexts", "beginnings").distinct()
    keys = endings.select(F.explode(F.concat("contexts", "beginnings")).alias("k"))
    slot = F.pmod(F.col("k"), F.lit(BITMAP_BITS))
    pieces = keys.select(F.floor(slot / 32768).cast("int").alias("bucket"), F.pmod(slot, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for piece in pieces:  # at most BITMAP_BITS / 32768 pieces of 4 KB
        bits[piece.bucket * 4096 : (piece.bucket + 1) * 4096] = np.frombuffer(bytes(piece.bits), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value

        def wanted(key: np.ndarray) -> np.ndarray:
            spot = key & (BITMAP_BITS - 1)
            return (held[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            texts = batch["text"].to_pylist()
            for begin, end in slices(texts):
                key, stop, go, sentences, chars = corpus_counts(texts[begin:end], wanted)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[key, 0]), pa.array(np.r_[stop, sentences]), pa.array(np.r_[go, chars])], names=["k", "stopped", "went"])

    counts = materialise(values.select("text").mapInArrow(count, "k long, stopped long, went long").groupBy("k").agg(F.sum("stopped").alias("stopped"), F.sum("went").alias("went")))
    total = counts.where("k = 0").select("stopped", "went").collect()
    per_char = max(1, total[0].stopped) / max(1, total[0].went) if total else 0.01

    numbered = endings.withColumn("ending", F.xxhash64("contexts", "beginnings"))
    spread = numbered.select("ending", F.posexplode(F.concat(F.transform("contexts", lambda k: F.struct(F.lit(1).alias("kind"), k.alias("k"))), F.transform("beginnings", lambda k: F.struct(F.lit(2).alias("kind"), k.alias("k"))))).alias("at", "c")).select("ending", "at", "c.kind", "c.k")
    met = spread.join(counts.where("k <> 0"), "k", "left").groupBy("ending").agg(F.array_sort(F.collect_list(F.struct("at", "kind", F.coalesce("stopped", F.lit(0)).alias("stopped"), F.coalesce("went", F.lit(0)).alias("went")))).alias("met"))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [evidence_of([(m["stopped"], m["went"]) for m in row if m["kind"] == 1], [(m["stopped"], m["went"]) for m in row if m["kind"] == 2], per_char) for row in frame["met"]]
            begun = [max(((m["at"], m["went"]) for m in row if m["kind"] == 1), default=(0, 0))[1] for row in frame["met"]]
            yield pd.DataFrame({"ending": frame["ending"], "weight": out, "begun": begun})

    weights = met.mapInPandas(weigh, "ending long, weight double, begun long")
    notes = feats.where("note IS NOT NULL").groupBy("note").agg(F.countDistinct("turn_id").alias("turns"))
    joined = feats.withColumn("ending", F.when(F.size("contexts") > 0, F.xxhash64("contexts", "beginnings"))).join(weights, "ending", "left").join(notes, "note", "left")
    repeated = (F.col("turns") >= 2) & (F.col("turns") >= REPEATED_SHARE * F.coalesce("begun", F.lit(0)))
    llr = F.when(repeated, REPEATED).otherwise(F.col("form") + F.coalesce("weight", F.lit(0.0)))
    scored = materialise(joined.select("turn_id", "source", "field_name", "length", "text_hash", "prose", llr.alias("llr")))
    cells = scored.groupBy("source", "field_name", "length", "prose", (F.round(F.col("llr") * 4) / 4).alias("llr"), "text_hash").agg(F.lit(1).alias("one")).groupBy("source", "field_name", "length", "prose", "llr").agg(F.count("*").alias("n"))
    limits = cells.groupBy("source", "field_name").applyInPandas(_fit_group, "source string, field_name string, limit_length int, prior double")
    limits = materialise(limits)
    at_limit = limits.where("limit_length >= 0").withColumnRenamed("prior", "limit_prior")
    elsewhere = limits.where("limit_length < 0").select("source", "field_name", F.col("prior").alias("base"))
    found = scored.join(elsewhere, ["source", "field_name"]).join(at_limit.withColumnRenamed("limit_length", "length"), ["source", "field_name", "length"], "left")
    prior = F.coalesce("limit_prior", "base")
    odds = F.log(prior / (1 - prior)) + F.col("llr")
    return found.select("turn_id", "source", "field_name", "length", "llr", prior.alias("prior"), (1 / (1 + F.exp(-odds))).alias("posterior"))
