"""Byte-level BPE by speculation and verification.

A word's tokens are first guessed: at each position the longest token that matches. A token sequence is what the
merges give if and only if every two neighbours are what the merges make of the two tokens' own bytes, so the guess
is verified pair by pair, vectorised over all words of a batch. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import regex

TOKENIZERS = "/opt/tokenizers"
CACHED_WORDS = 300_000  # distinct words a worker remembers between batches

# Fixed value: the published pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class _Numbers(dict):
    """Numbers words as they are first asked for, and keeps those in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number


class ByteBpe:
    """The vocabulary and merges of one vocabulary file, with a bounded memory of words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
        size = max(self.tokens) + 1
        self.size = size
        self.byte_id = np.full(256, -1, np.int64)
        for i, b in self.tokens.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        #: rank of the merge that makes a token (-1 for single bytes), and its two parts
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            self.merges[ia * size + ib] = (r, ic)
            self.rank[ic], self.left[ic], self.right[ic] = r, ia, ib
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank = np.fromiter((r for r, _ in self.merges.values()), np.int64, len(keys))[order]
        self._build_trie()
        self.stable = np.zeros(size, np.int8)  # whether a token's own bytes give it: 0 not yet known, 1 yes, -1 no
        self._split = regex.compile(WORD_PATTERN).findall
        self._forget()

    def _build_trie(self) -> None:
        """Transitions (state * 256 + byte -> state) as sorted arrays, and the token that ends at each state."""
        state, ends = {b"": 0}, [-1]
        keys, targets = [], []
        for i, token in sorted(self.tokens.items(), key=lambda x: len(x[1])):
            at = 0
            for k in range(1, len(token) + 1):
                head = token[:k]
                following = state.get(head)
                if following is None:
                    following = state[head] = len(ends)
                    ends.append(-1)
                    keys.append(at * 256 + token[k - 1])
                    targets.append(following)
                at = following
            ends[at] = i
        order = np.argsort(np.array(keys))
        self.trie_key, self.trie_to = np.array(keys)[order], np.array(targets)[order]
        self.trie_token = np.array(ends)

    def _forget(self) -> None:
        self._index = _Numbers()
        self._ids = [np.zeros(0, np.int32)]
        self._counts = [np.zeros(0, np.int64)]

    # -- speculation ----------------------------------------------------------------------------------------------

    def longest(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of ``data`` the longest token that matches within ``room`` bytes: its length and id."""
        n = len(data)
        length, token = np.ones(n, np.int64), self.byte_id[data]
        at, state, k = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = state * 256 + data[at + k]
            place = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            known = self.trie_key[place] == key
            at, state = at[known], self.trie_to[place[known]]
            k += 1
            ended = self.trie_token[state] >= 0
            length[at[ended]], token[at[ended]] = k, self.trie_token[state[ended]]
            more = room[at] > k
            at, state = at[more], state[more]
        return length, token

    # -- verification ---------------------------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges keep tokens ``a`` and ``b`` apart when they stand side by side.

        The merges build both tokens at once, lowest rank first. Only the piece of ``a`` that touches ``b`` and the
        piece of ``b`` that touches ``a`` can join across. Going back from the finished tokens, the piece that was
        made last is taken apart first; the pieces that touch at each moment must not have a merge that would have
        come before the merge that next changes one of them (the left-most of equal ranks coming first).
        """
        n = len(a)
        ok = np.ones(n, bool)
        x, y = a.copy(), b.copy()
        # rank of the merge that ends the present moment, and whether a merge across of that same rank would come before it
        until, tie_first = np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
        live = np.arange(n)
        while len(live):
            key = x[live] * self.size + y[live]
            place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            joined = self.pair_key[place] == key
            r = self.pair_rank[place]
            bad = joined & ((r < until[live]) | ((r == until[live]) & tie_first[live]))
            ok[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live_on = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[live_on], rx[live_on], ry[live_on]
            undo_right = ry >= rx  # of equal ranks the left merge came first, so the right one is undone first
            until[live] = np.where(undo_right, ry, rx)
            # a merge across of the same rank stands left of y's inner merge but right of x's
            tie_first[live] = undo_right
            go = live[undo_right]
            y[go] = self.left[y[go]]
            go = live[~undo_right]
            x[go] = self.right[x[go]]
        return ok

    # -- exact merging --------------------------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """The tokens of ``word`` by its merges, lowest rank and then left-most first; a heap keeps long words cheap."""
        ids = [int(self.byte_id[c]) for c in word]
        n = len(ids)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        size, merges = self.size, self.merges
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] * size + ids[i + 1])
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a * size + b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                m = merges.get(ids[i] * size + ids[after[i]])
                if m:
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0:
                p = before[i]
                m = merges.get(ids[p] * size + ids[i])
                if m:
                    heapq.heappush(heap, (m[0], p, ids[p], ids[i]))
        return [t for t in ids if t >= 0]

    # -- words and texts ------------------------------------------------------------------------------------------

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all ``words`` one after the other, and how many each word has."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        end = np.cumsum(sizes)
        length, token = self.longest(data, np.repeat(end, sizes) - np.arange(len(data)))
        # follow the guesses: all words step to their next token at once
        first = np.zeros(len(data), bool)
        at, stop = end - sizes, end
        going = at < stop
        at, stop = at[going], stop[going]
        while len(at):
            first[at] = True
            at = at + length[at]
            going = at < stop
            at, stop = at[going], stop[going]
        begin = np.flatnonzero(first)
        word = np.repeat(np.arange(len(raw)), sizes)[begin]
        guess = token[begin]
        same = word[1:] == word[:-1]
        a, b = guess[:-1][same], guess[1:][same]
        pair, which = np.unique(a * self.size + b, return_inverse=True)
        fine = self.compatible(pair // self.size, pair % self.size)[which]
        for t in np.unique(guess[self.stable[guess] == 0]):
            self.stable[t] = 1 if self.merge(self.tokens[int(t)]) == [t] else -1
        failed = np.zeros(len(raw), bool)
        failed[word[1:][same][~fine]] = True
        failed[word[self.stable[guess] < 0]] = True
        counts = np.bincount(word, minlength=len(raw))
        exact = {int(w): self.merge(raw[w]) for w in np.flatnonzero(failed)}
        if not exact:
            return guess.astype(np.int32), counts
        starts = np.cumsum(counts) - counts
        ids = [exact[w] if w in exact else guess[starts[w] : starts[w] + counts[w]] for w in range(len(raw))]
        return np.concatenate([np.asarray(i, np.int32) for i in ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all ``texts`` one after the other, and how many each text has; none for null and empty texts."""
        if len(self._index) > CACHED_WORDS:
            self._forget()
        number = self._index.__getitem__
        rows, sizes = [], []
        for text in texts:
            words = self._split(text) if text else ()
            rows.append(np.fromiter(map(number, words), np.int64, len(words)))
            sizes.append(len(words))
        fresh, self._index.fresh = self._index.fresh, []
        if fresh:
            ids, counts = self.encode_words(fresh)
            self._ids.append(ids)
            self._counts.append(counts)
            if len(self._ids) > 8:
                self._ids, self._counts = [np.concatenate(self._ids)], [np.concatenate(self._counts)]
        ids, counts = np.concatenate(self._ids), np.concatenate(self._counts)
        self._ids, self._counts = [ids], [counts]
        word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        starts = np.cumsum(counts) - counts
        per_word = counts[word]
        total = np.r_[0, np.cumsum(per_word)]
        edge = np.r_[0, np.cumsum(np.array(sizes, np.int64))]
        return ids[_ragged(starts[word], per_word)], total[edge[1:]] - total[edge[:-1]]


@lru_cache(maxsize=4)
def load_bpe(path: str) -> ByteBpe:
    """One instance for each worker process and file."""
    return ByteBpe(path)


def vocabulary_file(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.json")
