import random

import numpy as np
import pandas as pd

from parcelwright.llm import truncation as T

SCHEMA = "turn_id long, source string, message string, reply string, length string, posterior string"


def test_forms_of_endings():
    whole = ["All is well.", "Is it?", 'He said "no."', "Good. 👍", "Good. :)", '{"a": [1]}', "It fits.\n--\nVillage", "See:\n- 12/1A"]
    cut = ["All stones of the [...]", "All stones of (more)", '{"a": [1, "b', "All stones of the "]
    assert all(T.ending(t)[0] < 0 for t in whole)
    assert all(T.ending(t)[0] > 2 for t in cut)
    assert T.ending("/recall 12/1A Place")[4] == T.ending("/recall 9/2B Place")[4] is not None


def test_counts_against_brute_force():
    texts = ["The old wall fell. The old well dried up.\nIt was old", "The old wall", '{"skip": 1}', "Wall 12 of 13. The older"]
    key, stopped, went, sentences, chars = T.corpus_counts(texts)
    counts = {int(k): (int(a), int(b)) for k, a, b in zip(key, stopped, went)}
    assert sentences == 3 and chars == sum(map(len, texts))
    h = T.token_hash
    of = lambda words, kind=1: counts.get(T._contexts([h(w) for w in words], kind)[-1], (0, 0))
    assert counts[T._contexts([h("old")], 1)[0]] == (0, 3)  # the last word of a text isn't counted, as it may be cut
    assert of(["The", "old", "wall"]) == (0, 1) and of(["The", "old", "wall", "fell"]) == (1, 0)
    assert counts[T._contexts([h("0")], 1)[0]] == (1, 1)
    begun = T._contexts([h("The"), h("wal")], 2)
    assert counts[begun[0]] == (0, 1) and begun[1] not in counts
    assert counts[T._contexts([h("old"), h("wal")], 2)[1]] == (0, 1)


def test_contexts_match_between_endings_and_corpus():
    sentence = "Children had used the marker as a wicket"
    key = set(T.corpus_counts([sentence + ". Next one."])[0].tolist())
    assert set(T.ending(sentence)[2]) <= key


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(3)
    length = np.maximum(1, np.exp(rng.normal(5.0, 0.5, 20_000)))
    seen = np.minimum(length, 200.0)
    values, n = np.unique(np.round(seen), return_counts=True)
    mu, sd = T._censored_fit(values, np.where(values < 200, n, 0).astype(float), np.where(values == 200, n, 0).astype(float))
    assert abs(mu - 5.0) < 0.03 and abs(sd - 0.5) < 0.03


def corpus(n, seed):
    rng = random.Random(seed)
    who, what, where = ["The crew", "A trainee", "The owner", "One of us", "The office"], ["measured the wall", "found the stone", "lost the sketch", "drew the line twice", "checked the number"], ["near the road", "behind the school", "on the slope", "below the old tank", "at the edge of the grove"]
    rows, truth = [], set()
    for i in range(n):
        text = " ".join(f"{rng.choice(who)} {rng.choice(what)} {rng.choice(where)}." for _ in range(rng.randint(1, 6)))
        source = rng.choice(["limited", "limited", "free", "lossy"])
        if rng.random() < 0.1:
            text = text[:-1]
        stored = text
        if source == "limited" and len(text) > 120:
            stored = text[:120]
        elif source == "lossy" and rng.random() < 0.3:
            stored = text[: rng.randint(20, len(text) - 1)]
        if stored.rstrip(" .") != text.rstrip(" ."):
            truth.add((i, "message"))
        rows.append((i, source, stored, rng.choice(["ok", "no stone there", None, "", '{"tool": "status"}', '{"tool": "sta']), None, "x"))
        if rows[-1][3] == '{"tool": "sta':
            truth.add((i, "reply"))
    return rows, truth


def test_operator_finds_planted_cuts(spark):
    rows, truth = corpus(3000, 1)
    rows += rows[:200] + [(9000, None, "The crew found the stone near the road.", "ok", None, None), (9001, "free", "   ", None, None, None), (9002, "free", "The crew lost the sketch on the slope. " * 4000, None, None, None)]
    judged = T.judge(spark.createDataFrame(rows, SCHEMA)).select("turn_id", "field_name", "posterior", "source").distinct().toPandas()
    assert not judged.duplicated(["turn_id", "field_name"]).any()
    found = set(judged[judged.posterior >= 0.5][["turn_id", "field_name"]].itertuples(index=False, name=None))
    right = len(found & truth)
    assert right / len(found) > 0.95 and right / len(truth) > 0.95
    assert (9001, "message") not in set(judged[["turn_id", "field_name"]].itertuples(index=False, name=None))
    assert "" in set(judged.source) and (9002, "message") not in found


def test_copies_make_no_limit():
    cells = pd.DataFrame({"length": [50, 60, 70, 80, 90, 77], "prose": True, "llr": -4.0, "n": [30, 40, 40, 30, 20, 1]})
    assert T.fit_limits(cells).limit_length.tolist() == [-1]


def test_empty_table(spark):
    assert T.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_limits_behave_alike_at_every_size():
    def prior(whole):
        cells = pd.DataFrame({"length": [100, *range(40, 40 + whole)], "prose": True, "llr": [3.0] + [-4.0] * whole, "n": [40] + [1] * whole})
        return dict(zip(*T.fit_limits(cells)[["limit_length", "prior"]].to_numpy().T)).get(100, 0.0)

    assert all(prior(n) > 0.9 for n in (1, 5, 19, 20, 21, 60))


def test_long_words_and_bracketed_prose_are_read_whole():
    long = "x" * 5_000
    assert T.last_sentence(f"All of it.\n{long} end") == [long, "end"]
    key, stopped, went, sentences, _ = T.corpus_counts([f"[note] It ends here. Then {long}y came. So"])
    counts = dict(zip(key.tolist(), zip(stopped.tolist(), went.tolist())))
    assert sentences == 2
    assert counts[T._contexts([T.token_hash("Then"), T.token_hash(long)], 2)[1]] == (0, 1)
    assert T.corpus_counts(['[{"a": "It ends. Here."}]'])[3] == 0 and T.corpus_counts(["[... it goes on. Here. "])[3] == 2


def test_lines_blanks_and_signs_in_the_counts():
    texts = ["  One two.\n\n - three\tfour \n", "", " \n", "- -", "five\n-"]
    key, stopped, went, sentences, _ = T.corpus_counts(texts)
    counts = dict(zip(key.tolist(), zip(stopped.tolist(), went.tolist())))
    word = lambda w: counts.get(T._contexts([T.token_hash(w)], 1)[0])
    assert (word("One"), word("two"), word("three"), word("four"), word("five"), sentences) == ((0, 1), (1, 0), (0, 1), None, (1, 0), 2)
