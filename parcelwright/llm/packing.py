"""Documents in containers of fixed capacity, by vector bin packing with the dot-product heuristic.

An item has a vector: tokens, segments (one) and loss-bearing tokens. A container is filled item by item: of all items
that still fit, the one whose vector has the largest weighted dot product with what is left in the container comes
next. Items of equal vectors are one type, so a step is one product over the types. Items are spread evenly over packs
of bounded size that are filled independently; only the last containers of a pack can stay emptier than usual.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwright.llm.bpe import TOKENIZERS
from parcelwright.llm.tokens import counter, slices
from parcelwright.plans.checkpoints import materialise

PACK_ROWS = 40_000  # documents that are packed together
MOST_CONTEXTS = 1_000  # rows of the table of contexts, which goes to every task
SEGMENT_TOKENS = 16  # a container may hold a segment for so many tokens of its capacity

PLACED = "context_id int, container_id long, doc_id long, piece int, piece_start int, tokens int, loss int"


@dataclass(frozen=True)
class Limits:
    """What a container of a context holds at most beside its tokens.

    ``segment_tokens``: one segment for so many tokens of its capacity (at least one); ``most_segments``: no more than
    these in any case; ``loss_share``: of its capacity, what may be loss-bearing tokens. ``prompt_lines``: so many first
    lines of a document are its prompt and bear no loss; without them only a document's first token doesn't, as nothing
    predicts it.
    """

    segment_tokens: int = SEGMENT_TOKENS
    most_segments: int = 1 << 30
    loss_share: float = 1.0
    prompt_lines: int = 0

    def segments(self, capacity: int) -> int:
        return max(1, min(self.most_segments, capacity // self.segment_tokens))

    def loss(self, capacity: int) -> int:
        return max(1, int(capacity * self.loss_share))


@dataclass(frozen=True)
class Context:
    context_id: int
    tokenizer: str
    capacity: int
    segments: int
    loss: int


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """The container (0, 1, ...) of each item, within the three limits; every item must fit an empty container.

    Weights are the demand of each limit relative to its capacity. Ties go to the item with more tokens, then more
    loss-bearing tokens, and among equal items to the first.
    """
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    kinds, which = np.unique(np.column_stack([tokens, loss]), axis=0, return_inverse=True)
    which = which.ravel()
    kinds, which = kinds[::-1], len(kinds) - 1 - which  # larger items first, so that argmax takes them on ties
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    first = np.cumsum(left) - left
    taken = np.zeros(len(kinds), np.int64)
    t, b = kinds[:, 0].astype(np.float64), kinds[:, 1].astype(np.float64)
    limits = np.array([capacity, segments, loss_limit], np.float64)
    share = np.array([tokens.sum(), n, loss.sum()], np.float64) / limits
    weight = share / share.sum() / limits**2  # both factors of the product are taken relative to the limit
    # where segments are scarcest, large items would waste them: the product is then divided by the length of the item's vector
    norm = np.sqrt((share / share.sum()) @ np.stack([(t / limits[0]) ** 2, np.full(len(t), limits[1] ** -2.0), (b / limits[2]) ** 2])) if share.argmax() == 1 else np.ones(len(t))
    live = np.arange(len(kinds))
    container, room = 0, limits.copy()
    for _ in range(n):
        if len(live) > 64 and (left[live] == 0).mean() > 0.25:
            live = live[left[live] > 0]
        fits = (t[live] <= room[0]) & (b[live] <= room[2]) & (left[live] > 0) if room[1] >= 1 else np.zeros(len(live), bool)
        if not fits.any():
            container += 1
            room = limits.copy()
            fits = left[live] > 0
        score = np.where(fits, t[live] * (weight[0] * room[0]) + weight[1] * room[1] + b[live] * (weight[2] * room[2]), -1.0) / norm[live]
        k = int(live[int(score.argmax())])
        out[order[first[k] + taken[k]]] = container
        taken[k] += 1
        left[k] -= 1
        room -= (t[k], 1.0, b[k])
    return out


def pieces(tokens: np.ndarray, free: np.ndarray, capacity: int, loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, tokens, loss-bearing tokens): one piece of a document that a container can hold, else the largest ones it can and a rest.

    ``free``: tokens at a document's start that bear no loss.
    """
    tokens, free = tokens.astype(np.int64), free.astype(np.int64)
    waiting, start, number, parts = np.arange(len(tokens)), np.zeros(len(tokens), np.int64), 0, []
    while len(waiting):
        unpaid = np.maximum(0, free[waiting] - start)
        size = np.minimum(np.minimum(capacity, unpaid + loss), tokens[waiting] - start)
        parts.append(np.stack([waiting, np.full(len(waiting), number), start, size, np.maximum(0, size - unpaid)]))
        more = start + size < tokens[waiting]
        waiting, start, number = waiting[more], (start + size)[more], number + 1
    made = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    made = made[:, np.lexsort((made[1], made[0]))]
    return made[0], made[1], made[2], made[3], made[4]


def place(doc_id: list, tokens: np.ndarray, loss_free: np.ndarray, context: Context, base: int) -> pd.DataFrame:
    """The rows of one pack in one context; containers are numbered from ``base``.

    Pieces that fill a container by themselves get one each. A piece without tokens takes no room and no segment: it is put
    into the pack's first container. ``loss_free``: tokens at a document's start that bear no loss.
    """
    doc, piece, start, size, loss = pieces(tokens, loss_free, context.capacity, context.loss)
    container = np.zeros(len(doc), np.int64)
    whole = size == context.capacity
    part = (size > 0) & ~whole
    container[whole] = np.arange(int(whole.sum()))
    container[part] = int(whole.sum()) + fill(size[part], loss[part], context.capacity, context.segments, context.loss)
    ids = pd.array([None if d is None else int(d) for d in doc_id], dtype="Int64")
    return pd.DataFrame({"context_id": np.int32(context.context_id), "container_id": base + container, "doc_id": ids[doc], "piece": piece.astype(np.int32), "piece_start": start.astype(np.int32), "tokens": size.astype(np.int32), "loss": loss.astype(np.int32)})


def prompt(text: str | None, lines: int) -> str | None:
    """The first ``lines`` lines of a text with their ends; None where it has no more than these, as a text that is all prompt would teach nothing."""
    at = -1
    for _ in range(lines):
        at = text.find("\n", at + 1) if text else -1
        if at < 0:
            return None
    return text[: at + 1] if text and text[at + 1 :].strip() else None


def sizes(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS, prompt_lines: int = 0) -> DataFrame:
    """doc_id and sizes (tokens of text under each tokenizer, in their order, then those of its prompt, at least 1) of each row; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(name, folder) for name in tokenizers]
        for batch in batches:
            texts = batch["text"].to_pylist()
            for begin, end in slices(texts):
                heads = [prompt(t, prompt_lines) for t in texts[begin:end]] if prompt_lines else None
                free = [np.maximum(1, c(heads)) if heads else np.ones(end - begin) for c in counters]
                counts = np.column_stack([c(texts[begin:end]) for c in counters] + free).astype(np.int32)
                offsets = np.arange(0, counts.size + 1, 2 * len(tokenizers), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))], names=["doc_id", "sizes"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, sizes array<int>")


def contexts_of(contexts: DataFrame, limits: Limits) -> list[Context]:
    """The rows of a table of contexts, at most MOST_CONTEXTS, with their limits; rows without an id, tokenizer or capacity are left out."""
    table = contexts.where("context_id IS NOT NULL AND tokenizer IS NOT NULL AND capacity > 0").select("context_id", "tokenizer", "capacity").distinct().orderBy("context_id", "tokenizer", "capacity").limit(MOST_CONTEXTS + 1).collect()
    if len(table) > MOST_CONTEXTS:
        raise ValueError(f"more than {MOST_CONTEXTS} contexts")
    return [Context(r.context_id, r.tokenizer, int(r.capacity), limits.segments(int(r.capacity)), limits.loss(int(r.capacity))) for r in table]


def pack(documents: DataFrame, contexts: DataFrame, pack_rows: int = PACK_ROWS, folder: str = TOKENIZERS, limits: Limits = Limits()) -> DataFrame:
    """A container for each document of ``documents`` (doc_id, text) in each of ``contexts`` (context_id, tokenizer, capacity).

    Result: context_id, container_id, doc_id, piece, piece_start, tokens, loss (its loss-bearing tokens). Sizes are
    tokens of text under the context's tokenizer. A document is never split unless it alone exceeds what a container
    holds; then its pieces (numbered from 0, piece_start being the first token) are as large as one holds but for the
    last. A container keeps the three limits: its capacity of tokens, and those of ``limits`` on segments and loss-bearing
    tokens. A null or empty text has a row with 0 tokens. Rows that repeat are placed each; a null doc_id is kept; other
    columns are ignored; no documents or no contexts give no rows. Containers are numbered apart for each pack and context.
    """
    wanted = contexts_of(contexts, limits)
    if not wanted:
        return documents.sparkSession.createDataFrame([], PLACED)
    names = sorted({c.tokenizer for c in wanted})
    sized = materialise(sizes(documents, names, folder, limits.prompt_lines))
    packs = max(1, -(-sized.count() // pack_rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts = [], []
        for frame in frames:
            ids += [None if d is None or d != d else int(d) for d in frame["doc_id"]]
            counts.append(np.stack(frame["sizes"].to_numpy()))
        if not ids:
            return
        every = np.concatenate(counts).astype(np.int64)
        base = TaskContext.get().partitionId() << 32
        for context in wanted:
            at = names.index(context.tokenizer)
            yield place(ids, every[:, at], every[:, len(names) + at], context, base)

    return sized.repartition(packs).mapInPandas(run, PLACED)


def containers(placed: DataFrame, contexts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """context_id, container_id, and what each container holds of each limit: tokens, segments, loss, capacity, most_segments, most_loss."""
    table = contexts_of(contexts, limits)
    held = placed.groupBy("context_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("segments"), F.sum("loss").alias("loss"))
    bounds = placed.sparkSession.createDataFrame([(c.context_id, c.capacity, c.segments, c.loss) for c in table], "context_id int, capacity long, most_segments long, most_loss long")
    return held.join(F.broadcast(bounds), "context_id")  # at most MOST_CONTEXTS rows


def usage(placed: DataFrame, contexts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Containers of each context against the fewest that each limit alone would need, their unused space, and how many containers each limit fills.

    A limit fills a container that has at most 1 % of it left (of segments: none).
    """
    total = containers(placed, contexts, limits).groupBy("context_id", "capacity", "most_segments", "most_loss").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("segments").alias("segments"), F.sum("loss").alias("loss"),
        F.count_if(F.col("tokens") >= 0.99 * F.col("capacity")).alias("full_of_tokens"), F.count_if(F.col("segments") >= F.col("most_segments")).alias("full_of_segments"), F.count_if(F.col("loss") >= 0.99 * F.col("most_loss")).alias("full_of_loss"),
    )
    least = lambda amount, limit: F.ceil(F.col(amount) / F.col(limit))
    return total.select("context_id", "capacity", "containers", F.greatest(least("tokens", "capacity"), least("segments", "most_segments"), least("loss", "most_loss")).alias("least_containers"), "tokens", "segments", "loss", "full_of_tokens", "full_of_segments", "full_of_loss", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"))


def soundness(placed: DataFrame, contexts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What is wrong with a packing of documents with distinct ids, by context: documents placed, containers over a limit, documents whose pieces don't follow on one another, documents split although a container holds them."""
    over = containers(placed, contexts, limits).groupBy("context_id", "capacity", "most_loss").agg(F.count_if((F.col("tokens") > F.col("capacity")) | (F.col("segments") > F.col("most_segments")) | (F.col("loss") > F.col("most_loss"))).alias("over_a_limit"))
    one = placed.groupBy("context_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max(F.col("piece_start") + F.col("tokens")).alias("end"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("loss").alias("loss"))
    judged = one.join(over, "context_id")
    return judged.groupBy("context_id", "over_a_limit").agg(F.count("*").alias("documents"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("pieces") != F.col("last") + 1)).alias("broken"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")) & (F.col("loss") <= F.col("most_loss"))).alias("split_in_vain"))
