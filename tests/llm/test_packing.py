import numpy as np
import pytest

from parcelwright.llm.bpe import load_bpe, vocabulary_file
from parcelwright.llm.packing import Context, Limits, fill, pack, pieces, place, prompt, soundness, usage


@pytest.mark.parametrize("capacity,segments,loss", [(100, 100, 100), (100, 3, 100), (100, 100, 60), (64, 2, 64)])
def test_limits_hold_and_little_is_unused(capacity, segments, loss):
    rng = np.random.default_rng(capacity + segments)
    tokens = np.minimum(rng.geometric(0.05, 4000), min(capacity, loss))
    bearing = np.minimum((tokens * rng.uniform(0.5, 1, 4000)).astype(int), loss)
    box = fill(tokens, bearing, capacity, segments, loss)
    n = box.max() + 1
    for amount, limit in ((tokens, capacity), (np.ones(4000), segments), (bearing, loss)):
        assert np.bincount(box, amount).max() <= limit
    least = max(tokens.sum() / capacity, 4000 / segments, bearing.sum() / loss)
    assert sorted(set(box.tolist())) == list(range(n)) and n <= 1.05 * least + 2


def test_pieces_of_long_documents():
    doc, piece, start, size, _ = pieces(np.array([0, 5, 10, 25]), np.ones(4), 10, 10)
    assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), size.tolist())) == [(0, 0, 0, 0), (1, 0, 0, 5), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 5)]
    cut = pieces(np.array([9, 25, 9]), np.array([4, 12, 1]), 10, 6)
    assert list(zip(*[c.tolist() for c in cut])) == [(0, 0, 0, 9, 5), (1, 0, 0, 10, 0), (1, 1, 10, 8, 6), (1, 2, 18, 6, 6), (1, 3, 24, 1, 1), (2, 0, 0, 7, 6), (2, 1, 7, 2, 2)]


def test_prompts():
    assert [prompt(t, 1) for t in ("Do it.\nDone.", "One line", "Ends.\n", None, "", "\nx")] == ["Do it.\n", None, None, None, None, "\n"]
    assert prompt("a\nb\nc", 2) == "a\nb\n" and prompt("a\nb", 2) is None


def test_place_one_pack():
    rows = place([1, 2, 3, None, 4], np.array([25, 0, 5, 7, 3]), np.ones(5, np.int64), Context(1, "t", 10, 9, 10), 1 << 32)
    per = rows.groupby("container_id").tokens.sum()
    assert per.max() <= 10 and rows.tokens.sum() == 40 and len(rows) == 7 and per.index.min() == 1 << 32
    assert rows[rows.doc_id == 1].container_id.is_unique


def test_only_empty_documents():
    rows = place([1, 2], np.array([0, 0]), np.ones(2, np.int64), Context(1, "t", 10, 1, 10), 0)
    assert rows.container_id.tolist() == [0, 0] and rows.tokens.tolist() == [0, 0]


def test_operator(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["word"] * int(k)) for k in rng.integers(1, 300, 400)] + [None, "", "word " * 3000, "same", "same"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no key", 1, "x"), (3, texts[3], 1, "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, tokens int, container_id string")
    contexts = spark.createDataFrame([(1, "short", "byte_bpe_50k", 512, 0), (2, "long", "byte_bpe_50k", 2048, 0), (3, "other", "piece_bpe_32k", 600, 0), (None, "none", "byte_bpe_50k", 5, 0)], "context_id int, context_name string, tokenizer string, capacity int, piece int")
    placed = pack(documents, contexts, pack_rows=150).toPandas()
    assert set(placed.context_id) == {1, 2, 3}
    sizes = load_bpe(vocabulary_file("byte_bpe_50k")).encode([r[1] for r in rows])[1]
    for context, capacity in ((1, 512), (2, 2048), (3, 600)):
        own = placed[placed.context_id == context]
        per = own.groupby("container_id")
        assert per.tokens.sum().max() <= capacity and (own.tokens > 0).groupby(own.container_id).sum().max() <= capacity // 16
        if context < 3:
            assert own.tokens.sum() == sizes.sum()
        whole = own.groupby(own.doc_id.fillna(-1)).size()
        assert whole[3] == 2 and whole[-1] == 1 and set(range(len(texts))) <= set(whole.index.astype(int))
        split = own[own.piece > 0].doc_id.unique().tolist()
        assert split == [402]
    report = {r.context_id: r for r in usage(pack(documents, contexts), contexts).collect()}
    assert report[1].unused_share < 0.02 and report[1].tokens == sizes.sum()


def test_empty_tables(spark):
    documents, contexts = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "context_id int, tokenizer string, capacity int")
    assert pack(documents, contexts).collect() == []
    assert pack(documents, spark.createDataFrame([(1, "byte_bpe_50k", 512)], contexts.schema)).collect() == []


def test_each_limit_acts(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(["word"] * int(k)) + "\n" + " ".join(["reply"] * int(m)) for k, m in zip(rng.integers(1, 20, 600), rng.integers(1, 120, 600))] + ["", None, "x\n" + "word " * 900]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contexts = spark.createDataFrame([(1, "byte_bpe_50k", 256), (2, "byte_bpe_50k", 2048)], "context_id int, tokenizer string, capacity int")
    for limits, full in ((Limits(loss_share=0.7, prompt_lines=1), "full_of_loss"), (Limits(most_segments=4), "full_of_segments"), (Limits(), "full_of_tokens")):
        placed = pack(documents, contexts, limits=limits).cache()
        sound = soundness(placed, contexts, limits).collect()
        assert len(sound) == 2 and all((r.documents, r.over_a_limit, r.broken, r.split_in_vain) == (len(texts), 0, 0, 0) for r in sound)
        used = {r.context_id: r for r in usage(placed, contexts, limits).collect()}
        assert used[2][full] > 0.5 * used[2].containers and all(r.containers <= 1.1 * r.least_containers + 3 for r in used.values())
