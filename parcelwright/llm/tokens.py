"""Encoding a corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwright.llm.bpe import TOKENIZERS, load_bpe, vocabulary_file

SLICE_CHARS = 2_000_000  # characters that are encoded at once


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array<int>) of each row of ``documents`` (doc_id, text), without special tokens.

    One pass without a shuffle: words are guessed by longest match, verified pair by pair, and merged exactly where a
    pair fails (bpe.py), so the ids equal those of the tokenizer's own library. An empty or null text has an empty
    list; text that looks like a special token is ordinary text; a lone surrogate is read as a question mark; white
    space is encoded like any text. Rows that repeat are encoded each; a null doc_id is kept; texts of any length are
    encoded whole; other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for begin, end in slices(texts):
                ids, counts = bpe.encode(texts[begin:end])
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def counter(tokenizer: str, folder: str = TOKENIZERS):
    """A function from a list of texts to an array of their numbers of tokens, for any of the vocabulary files."""
    import os

    if tokenizer == "byte_bpe_50k":
        return lambda texts: load_bpe(vocabulary_file(tokenizer, folder)).encode(texts)[1]
    if os.path.exists(os.path.join(folder, f"{tokenizer}.json")):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(os.path.join(folder, f"{tokenizer}.json"))
        made.encode_special_tokens = True
        return lambda texts: np.array([len(e.ids) for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)], np.int64)
    if os.path.exists(os.path.join(folder, f"{tokenizer}.tiktoken")):
        import base64

        import tiktoken

        from parcelwright.llm.bpe import WORD_PATTERN

        with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding(tokenizer, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: np.array([len(coder.encode_ordinary(t or "")) for t in texts], np.int64)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{tokenizer}.model"))
    return lambda texts: np.array([len(i) for i in pieces.encode([t or "" for t in texts], num_threads=1)], np.int64)
