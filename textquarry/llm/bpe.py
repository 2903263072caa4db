"""Byte-pair encoding and decoding over a prefix-sharing trie.

A byte string has one BPE encoding; all that has to be kept of a prefix is the last token of
its encoding. The distinct words of a batch are put in order, which walks their trie depth
first: the stack holds the last token of each prefix of the present path, so a prefix that
several words share is encoded once. A node's last token is the vocabulary token that ends
there and is compatible with the last token of the node where it starts; the tokens that end
at a node come from an automaton over the vocabulary, which moves down the trie as well.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterable
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textquarry.llm.common import Generations, map_slices, worker_state

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merges, as the rank files of the GPT-2 family expect.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a generation of a worker's cache, and of what it remembers of pairs and steps. They bear on time alone.
CACHE, PAIRS = 150_000, 400_000
#: Tokens that are decoded at once.
RUN = 200_000
#: Longer strings between two spaces aren't cached.
LONGEST_CACHED = 64


class Vocabulary:
    """The ranks of a byte-level BPE vocabulary with what the trie needs. Picklable and small enough to broadcast (its size is the vocabulary's)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.token = {i: b for b, i in ranks.items()}

    @classmethod
    def load(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return cls({base64.b64decode(b): int(i) for b, i in lines}, pattern)


def merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain BPE: joins the pair of lowest rank until none is left. below: ranks from there on don't count."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (below is None or rank < below) and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Built once in a worker from a Vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.cut = vocabulary.ranks, regex.compile(vocabulary.pattern).findall
        size = max(self.ranks.values(), default=-1) + 1
        #: The two tokens that a token is merged from; a token that no merge gives is its own halves.
        self.first, self.second = list(range(size)), list(range(size))
        #: The token that merges two: left << 20 | right.
        self.joined: dict[int, int] = {}
        #: Tokens that merges reach; others never occur.
        reached = []
        for word, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) == 1:
                reached.append((word, rank))
            elif len(parts := merge(word, self.ranks, rank)) == 2:
                a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                self.first[rank], self.second[rank], self.joined[a << 20 | b] = a, b, rank
                reached.append((word, rank))
        self.lengths, self.packed = [0] * size, [b""] * size
        for word, rank in self.ranks.items():
            self.lengths[rank], self.packed[rank] = len(word), rank.to_bytes(4, "little")
        self._automaton(reached)
        self.fits: dict[int, bool] = {}
        #: Encodings of strings with a single space before them, the space included, and of strings that start a text.
        self.known, self.starts = Generations(CACHE, LONGEST_CACHED), Generations(CACHE // 8, LONGEST_CACHED)
        # bytes of the tokens one after another, for decoding
        parts = [b""] * size
        for word, rank in self.ranks.items():
            parts[rank] = word
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array(self.lengths, np.int64)
        self.at = np.cumsum(self.size) - self.size

    def _automaton(self, reached: list[tuple[bytes, int]]) -> None:
        """step: the state after a state and a byte (state << 8 | byte), by the trie of the tokens at first; found: the tokens that end in a state with their lengths, longest first."""
        step: dict[int, int] = {}
        ends, edges = [-1], [[]]
        for word, rank in reached:
            at = 0
            for byte in word:
                after = step.get(at << 8 | byte)
                if after is None:
                    after = step[at << 8 | byte] = len(ends)
                    edges[at].append((byte, after))
                    ends.append(-1)
                    edges.append([])
                at = after
            ends[at] = rank
        fail, pair = [0] * len(ends), [(t, self.lengths[t]) for t in range(len(self.lengths))]
        found: list[tuple] = [()] * len(ends)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for byte, after in edges[at]:
                back = fail[at]
                while back and back << 8 | byte not in step:
                    back = fail[back]
                fail[after] = step.get(back << 8 | byte, 0) if at else 0
                found[after] = (pair[ends[after]], *found[fail[after]]) if ends[after] >= 0 else found[fail[after]]
                queue.append(after)
        self.step, self.fail, self.found, self.trie = step, fail, found, len(step)

    def _step(self, state: int, byte: int) -> int:
        """By failure links; remembered in step."""
        step, at = self.step, state
        while at and at << 8 | byte not in step:
            at = self.fail[at]
        after = step[state << 8 | byte] = step.get(at << 8 | byte, 0)
        return after

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart. At any moment of the merging the border lies between a last part of `left` and a first part of `right`, each until the merge that takes it in; the two stay apart unless such a pair has a merge that comes before both of these (of equal ranks the merge further left comes first)."""
        joined, first, second = self.joined, self.first, self.second
        x, x_ends = left, 1 << 40
        while True:
            y, y_ends = right, 1 << 40
            while True:
                rank = joined.get(x << 20 | y)
                if rank is not None and (when := max(rank, x, y)) < x_ends and when <= y_ends:
                    return False
                if first[y] == y:
                    break
                y, y_ends = first[y], y
            if second[x] == x:
                return True
            x, x_ends = second[x], x

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each distinct word's token ids as the bytes of an int32 array."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        if len(self.step) > self.trie + PAIRS:
            for key in list(self.step)[self.trie :]:
                del self.step[key]
        found, packed, lengths, fit, step_on = self.found, self.packed, self.lengths, self._fit, self._step
        fits, step = self.fits, self.step
        known, after = fits.get, step.get
        out: dict[str, bytes] = {}
        last, states, before = [-1], [0], b""
        for raw, word in sorted([(w.encode(), w) for w in words]):
            same, most = 0, min(len(before), len(raw))
            while same < most and raw[same] == before[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :]
            state, i = states[same], same
            for byte in raw[same:]:
                i += 1
                now = after(state << 8 | byte)
                state = step_on(state, byte) if now is None else now
                states.append(state)
                for t, n in found[state]:
                    if n == i:
                        break
                    key = last[i - n] << 20 | t
                    ok = known(key)
                    if ok is None:
                        ok = fits[key] = fit(last[i - n], t)
                    if ok:
                        break
                last.append(t)
            before = raw
            t = last[i]
            ids = [packed[t]]
            while i := i - lengths[t]:
                t = last[i]
                ids.append(packed[t])
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def spaced(self, strings: list[str]) -> list[bytes]:
        """The ids of each of some distinct strings with a space before them."""
        return self._cut([" " + s for s in strings])

    def _cut(self, strings: list[str]) -> list[bytes]:
        """The ids of each of some strings, through their words; of those that start with a space the cache is asked."""
        parts = list(map(self.cut, strings))
        get, new, have = self.known.get, set(), {}
        for string, words in zip(strings, parts):
            for w in words:
                if w not in new and w not in have:
                    # a word that is its whole string was looked for before
                    old = get(w[1:]) if len(w) < len(string) and w[0] == " " else None
                    if old is None:
                        new.add(w)
                    else:
                        have[w] = old
        have.update(self.encode_words(new))
        return [have[words[0]] if len(words) == 1 else b"".join([have[w] for w in words]) for words in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as int32 bytes."""
        cut = [chunks_of(t) for t in texts]
        begin = self.starts.find([c[0] for c in cut], self._cut)
        rest = self.known.find([x for c in cut for x in islice(c, 1, None)], self.spaced)
        out, at = [], 0
        for c, head in zip(cut, begin):
            n = len(c) - 1
            out.append(b"".join([head, *rest[at : at + n]]))
            at += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered in runs so that the indexes stay small."""
        out = []
        for a in range(0, len(ids), RUN):
            own = ids[a : a + RUN]
            size = self.size[own]
            ends = np.cumsum(size)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.at[own] - ends + size, size)].tobytes())
        return b"".join(out)


_runs = re.compile(r"\s\s").search
_single = re.compile(r"(?<!\s) (?=\S)").split


def chunks_of(text: str) -> list[str]:
    """The text cut at single spaces, at which the pattern always starts a new word; all but the first of the strings have lost such a space."""
    return text.split(" ") if _runs(text) is None and text[:1] != " " and text[-1:] != " " else _single(text)


def encoder(broadcast) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    return worker_state("bpe", (broadcast.value,), lambda: Encoder(broadcast.value))


def lists(parts: list[bytes | None], missing: list[bool]) -> pa.Array:
    """An array<int> column from int32 bytes."""
    sizes = np.array([0, *(len(p) // 4 for p in parts)], np.int32)
    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
    offsets = pa.array(np.cumsum(sizes, dtype=np.int32), mask=np.array([*missing, False]) if any(missing) else None)
    return pa.ListArray.from_arrays(offsets, values)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns in keep, with tokens array<int>, n_tokens int and round_trip: whether decoding gives the text's bytes again. A column in keep that has one of these names is replaced.

    One output row per input row, repeated rows and null ids included; other columns, whatever
    their names, are ignored. A null text has null tokens, n_tokens and round_trip; an empty
    text has an empty list, 0 and true. Texts of any length are encoded whole. Of merges of equal
    rank the leftmost comes first. An empty table gives an empty one. No shuffle: words are
    encoded in the worker that reads them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = dict(docs.dtypes)
    keep = tuple(c for c in keep if c not in ("tokens", "n_tokens", "round_trip"))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["tokens array<int>", "n_tokens int", "round_trip boolean"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(shared)
        texts = batch.column("text").to_pylist()
        missing = [t is None for t in texts]
        parts = e.encode([t or "" for t in texts])
        tokens = lists(parts, missing)
        counts = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), np.int32)
        raw = [(t or "").encode() for t in texts]
        back, sizes = e.decode(ids), np.concatenate([[0], np.cumsum(e.size[ids])])
        ends = np.cumsum(counts)
        size = sizes[ends] - sizes[ends - counts]
        if np.array_equal(size, [len(r) for r in raw]) and back == b"".join(raw):
            same = [True] * len(raw)
        else:
            at = np.cumsum(size) - size
            same = [back[a : a + n] == r for a, n, r in zip(at.tolist(), size.tolist(), raw)]
        mask = np.array(missing, bool)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), tokens, pa.array(counts.astype(np.int32), mask=mask), pa.array(np.array(same, bool), mask=mask)], names=[*keep, "tokens", "n_tokens", "round_trip"])

    return map_slices(docs.select(*keep, *(() if "text" in keep else ("text",))), run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary, column: str = "tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and text, from lists of token ids; bytes that are no UTF-8 become U+FFFD. Null lists give null, empty ones the empty text; an id outside the vocabulary is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = dict(tokens.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string"

    def run(batches):
        for batch in batches:
            token = shared.value.token
            texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, column).mapInArrow(run, schema)
