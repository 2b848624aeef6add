import random

import numpy as np
import pytest

from parcelwright.llm.bpe import load_bpe, vocabulary_file
from parcelwright.llm.tokens import counter, encode, slices

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(vocabulary_file("byte_bpe_50k"))
    made.encode_special_tokens = True
    return lambda texts: [e.ids for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts():
    rng = random.Random(4)
    letters = "aaab  \n\t12é<|endoftext|>ÿ🙂ம்हन्'s't,."
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    return [*made, None, "", " ", "<|endoftext|>", "a" * 3000, " " * 2000, "!" * 2000, "ab" * 1500, "It's 12 o'clock\r\n\r\nnow", "​­﻿"]


def test_ids_equal_the_library(library):
    ids, counts = load_bpe(vocabulary_file("byte_bpe_50k")).encode(texts())
    edges = np.r_[0, np.cumsum(counts)]
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == library(texts())


def test_compatible_pairs_against_exact_merging():
    bpe = load_bpe(vocabulary_file("byte_bpe_50k"))
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    want = [bpe.merge(bpe.tokens[x] + bpe.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == want and 0 < sum(want) < 4000


def test_operator(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "null key", None), (1, "again", None), (1, "again", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((r.doc_id, r.ids) for r in encode(frame).collect()), key=str)
    assert got == sorted(zip([r[0] for r in rows], library([r[1] for r in rows])), key=str)
    assert encode(frame.limit(0)).collect() == []


def test_slices_cover_all_texts():
    sample = ["a" * 5, None, "b" * 50, "", "c" * 4, "d" * 7]
    assert list(slices(sample, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(slices([], 10)) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_counters(name):
    assert counter(name)([None, "", "one two"])[:2].tolist() == [0, 0]
    assert counter(name)(["one two"])[0] >= 2
