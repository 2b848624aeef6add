"""Languages of documents and of their segments, by multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded table of labelled sentences. Its matrix of log-probabilities (buckets x languages)
is broadcast; a batch of documents is cut into sentences and headings, each distinct word is scored once, and the
words of all segments are summed in numpy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows the model is fitted on, at most
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.05
CACHED_WORDS = 400_000

WORD_LIMIT = 8.0  # nats that one word can speak against a language, so that a name can't decide a sentence
SENTENCE_WORDS = 5  # words from which a segment is more than a heading
SENTENCE_MARGIN = 5.0  # by which the best language of a sentence must lead to bring it into a document, in nats
HEADING_MARGIN = 14.0  # the same for a shorter segment of at least two words

LABELLED = "lang string, confidence double, languages array<string>, segments array<struct<start: int, end: int, lang: string, confidence: double>>"

_BOUNDARY = re.compile(r"[.!?।…]+[\"'»”’)\]]*\s+|[\r\n]+\s*")
_EDGE = re.compile(r"^[^\wऀ-෿]+|[^\wऀ-෿]+$")
_BROKEN = re.compile(r"[\d_/\\@|<>=#]")
_LONE_NAME = re.compile(r"\s*[\[(<{].*[\])>}]\s*")


def normal_word(raw: str) -> str:
    """The letters of a token, folded; empty if it is no word (numbers, codes, paths, punctuation)."""
    text = unicodedata.normalize("NFKC", raw).casefold()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = _EDGE.sub("", text)
    if not text or _BROKEN.search(text) or not any(c.isalpha() for c in text):
        return ""
    return text


def hashed_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, each word between two blanks, and the word each belongs to."""
    padded = [f" {w} " for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    value = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # value[i] covers the n characters from i on; it only counts where they are of one word
        value = value[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(n) if n <= len(code) else value[:0]
        if n in ORDERS and len(value):
            whole = owner[: len(value)] == owner[n - 1 :]
            mixed = value[whole] * np.uint64(0x9E3779B97F4A7C15)
            rows.append((mixed >> np.uint64(64 - 17)).astype(np.int64) & (BUCKETS - 1))
            owners.append(owner[: len(value)][whole])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


@dataclass
class Model:
    """languages, and the log-probability of each bucket in each language (0 in all where no language has it)."""

    languages: list[str]
    matrix: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> Model:
        names = sorted(set(languages))
        at = {name: i for i, name in enumerate(names)}
        words, which = [], []
        for text, language in zip(texts, languages):
            found = [w for w in map(normal_word, text.split()) if w]
            words += found
            which += [at[language]] * len(found)
        bucket, owner = hashed_ngrams(words)
        counts = np.zeros((BUCKETS, len(names)))
        np.add.at(counts, (bucket, np.array(which, np.int64)[owner]), 1.0)
        total = counts.sum(axis=0)
        seen = counts.sum(axis=1) > 0
        matrix = np.zeros_like(counts)
        matrix[seen] = np.log((counts[seen] + SMOOTHING) / (total + SMOOTHING * seen.sum()))
        matrix[seen] -= matrix[seen].mean(axis=1, keepdims=True)  # only differences between languages matter
        return cls(names, matrix.astype(np.float32))


def fit(samples: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """The model of ``samples`` (lang, text): the first ``limit`` of its rows in the order of their hash."""
    rows = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").orderBy(F.xxhash64("lang", "text")).limit(limit).collect()
    return Model.fit([r.text for r in rows], [r.lang for r in rows])


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, headings and other lines of a text."""
    out, begin = [], 0
    for cut in _BOUNDARY.finditer(text):
        if cut.start() > begin or cut.end() > begin:
            out.append((begin, cut.end()))
        begin = cut.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


class Scorer:
    """Scores words with a model and remembers them, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.real = np.zeros(0, bool)

    def words(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        fresh: list[str] = []
        at = np.empty(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            k = index.get(t)
            if k is None:
                k = index[t] = len(index)
                fresh.append(t)
            at[i] = k
        if fresh:
            normal = [normal_word(t) for t in fresh]
            scores = np.zeros((len(fresh), self.scores.shape[1]), np.float64)
            for begin in range(0, len(normal), 20_000):
                part = normal[begin : begin + 20_000]
                bucket, owner = hashed_ngrams(part)
                keep = np.fromiter(map(bool, part), bool, len(part))[owner]
                bucket, owner = bucket[keep], owner[keep]
                for j in range(scores.shape[1]):
                    scores[begin : begin + len(part), j] = np.bincount(owner, self.model.matrix[bucket, j], len(part))
            # no word may set a language further behind its best one than the limit
            scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_LIMIT) if len(scores) else scores
            self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
            self.real = np.concatenate([self.real, np.fromiter(map(bool, normal), bool, len(normal))])
        return at

    def label(self, texts: list[str | None]) -> list[tuple[str | None, float | None, list[str], list[tuple[int, int, str, float]]]]:
        """For each text its main language, the confidence in it, all its languages, and its segments."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        names, L = self.model.languages, len(self.model.languages)
        spans: list[tuple[int, int]] = []
        doc_of, tokens, sizes, lone = [], [], [], []
        for d, text in enumerate(texts):
            for begin, end in segments(text) if text else ():
                piece = text[begin:end]
                found = piece.split()
                if found:
                    spans.append((begin, end))
                    doc_of.append(d)
                    tokens += found
                    sizes.append(len(found))
                    lone.append(_LONE_NAME.fullmatch(piece) is not None)
        nothing = [(None, None, [], []) for _ in texts]
        if not spans:
            return nothing
        at = self.words(tokens)
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        score = np.add.reduceat(self.scores[at].astype(np.float64), begin, axis=0)
        count = np.add.reduceat(self.real[at].astype(np.int64), begin)
        doc = np.array(doc_of)
        real = (count > 0) & ~(np.array(lone) & (count < SENTENCE_WORDS))
        doc, score, count = doc[real], score[real], count[real]
        places = np.flatnonzero(real)
        if not len(doc):
            return nothing
        two = np.sort(score, axis=1)[:, -2:] if L > 1 else np.c_[score * 0, score]
        lead = two[:, 1] - two[:, 0]
        strong = ((count >= SENTENCE_WORDS) & (lead >= SENTENCE_MARGIN)) | ((count >= 2) & (lead >= HEADING_MARGIN))
        has = np.zeros((len(texts), L), bool)
        best = score.argmax(axis=1)
        has[doc[strong], best[strong]] = True
        # a document without a strong segment has the one language its segments favour together
        whole = np.zeros((len(texts), L))
        np.add.at(whole, doc, score)
        weak = np.zeros(len(texts), bool)
        weak[doc] = True
        weak &= ~has.any(axis=1)
        has[weak, whole[weak].argmax(axis=1)] = True
        # any other segment gets the likeliest language of its document
        chosen = np.where(has[doc], score, -np.inf).argmax(axis=1)
        odds = np.exp(score - score.max(axis=1, keepdims=True))
        sure = odds[np.arange(len(doc)), chosen] / odds.sum(axis=1)
        weight = np.zeros((len(texts), L))
        np.add.at(weight, (doc, chosen), count)
        trust = np.zeros((len(texts), L))
        np.add.at(trust, (doc, chosen), count * sure)
        out = nothing
        edges = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(doc[a])
            main = int(weight[d].argmax())
            parts = [(*spans[places[i]], names[chosen[i]], float(sure[i])) for i in range(a, b)]
            out[d] = (names[main], float(trust[d, main] / weight[d].sum()), sorted({p[2] for p in parts}), parts)
        return out


def detect(documents: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """Language of each row of ``documents`` (doc_id, text), and of each of its segments, with confidences.

    Result: doc_id, lang (the language of most words), confidence (the share of the text's words in it, each weighted
    by its segment's posterior), languages (all, in order), segments (start, end, lang, confidence). A segment is a
    sentence, a heading or another line that has words; numbers, codes, log lines and rules have none, so a text made
    of them, a blank, empty or null text has null, null and empty lists. A language enters a document by a sentence
    that leads by SENTENCE_MARGIN nats or a shorter line of two words or more that leads by HEADING_MARGIN; single
    foreign words and names bring none. Where no segment is
    that clear, the segments decide together. Ties go to the first code. Texts are read whole; rows that repeat are
    labelled each; a null doc_id is kept; of the other columns only the string column ``keep`` is passed on; an empty
    table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *([keep] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            texts = batch["text"].to_pylist()
            begin = held = 0
            for i, text in enumerate([*texts, None]):
                held += len(text) if text else 0
                if i == len(texts) or held > 1_000_000:
                    upto = min(i + 1, len(texts))
                    if upto > begin:
                        rows = scorer.label(texts[begin:upto])
                        parts = [[dict(zip(("start", "end", "lang", "confidence"), p)) for p in r[3]] for r in rows]
                        yield pa.RecordBatch.from_arrays(
                            [*(batch[c].slice(begin, upto - begin) for c in kept), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(parts, span)],
                            names=[*kept, "lang", "confidence", "languages", "segments"],
                        )
                    begin, held = upto, 0

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(keep).cast("string").alias(keep)] if keep else []))
    return read.mapInArrow(run, f"doc_id long, {f'{keep} string, ' if keep else ''}{LABELLED}")


def label_code(label: Column) -> Column:
    """The code of a delivered label: what stands before the first '-' or '_', in lower case without outer blanks."""
    return F.trim(F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"(?s)^([^-_]*)", 1)))
