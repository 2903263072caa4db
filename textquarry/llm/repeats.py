"""Long repeated passages by recompression.

Rounds shorten every document at once: runs of one symbol get the name of the run, then each
pair of a left and a right symbol gets the name of the pair; which symbols are left ones
changes from round to round. Names are 64-bit fingerprints of what they stand for, so all
workers name alike with nothing exchanged, and equal substrings get equal symbols in their
interior. Each high-level symbol knows its context, the words that alone determine it.

A window of LENGTH words can only be repeated if every symbol whose context it holds occurs
again. So Spark counts the high-level symbols, each document is cut again with what is known to
recur, and only windows that no symbol rules out are fingerprinted, counted and joined to
passages. Nothing is missed: a window without such a symbol is never ruled out. Windows count as
equal if two independent fingerprints of their bytes, 128 bits together, are: among 10^13 windows the
chance that any two unequal ones agree is about 10^-13. Whole documents are compared by SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_slices, stored

#: Words of a passage at least, rounds, words that a symbol must stand for to be counted.
LENGTH, ROUNDS, LEAST_WORDS = 50, 5, 3
#: Bytes that are hashed together; ids that are broadcast at most.
RUN, BROADCAST_IDS = 4_000_000, 1_000_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: The two families of fingerprints; that of the words' bytes and that of the words of a window have one base.
_BASE, _OTHER = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
#: Which symbols are right ones, round by round.
_sides = [np.uint64((r + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)) for r in range(64)]
_powers: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII, by the first byte of its UTF-8.
_wide = {0xC2: (b"\xc2\x85", b"\xc2\xa0"), 0xE1: (b"\xe1\x9a\x80",), 0xE2: tuple(chr(c).encode() for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)), 0xE3: (b"\xe3\x80\x80",)}
_lead = np.zeros(256, bool)
_lead[list(_wide)] = True


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, at least n of them."""
    if len(own := _powers.get(base, ())) < n:
        own = np.full(2 * n, np.uint64(base), np.uint64)
        own[0] = 1
        _powers[base] = own = np.multiply.accumulate(own)
    return own


class Words:
    """The words of some texts, one after another: where each text's start (and the end), where each word lies in the texts' bytes, its hash. Words are what str.split() gives."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
        self.text = at - at[0]
        n = len(self.raw)
        white = _white[self.raw]
        for i in np.flatnonzero(_lead[self.raw]).tolist() if n and _lead[self.raw].any() else ():
            for w in _wide[self.raw[i]]:
                if self.raw[i : i + len(w)].tobytes() == w:
                    white[i : i + len(w)] = True
        edge = np.zeros(n + 1, bool)
        edge[self.text] = True
        begin, end = ~white, ~white
        begin[1:] &= white[:-1] | edge[1:-1]
        end[:-1] &= white[1:] | edge[1:-1]
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.starts = np.searchsorted(self.first, self.text)

    def hashes(self, base: int = _BASE) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length. Long texts are hashed in runs."""
        out, size = np.empty(len(self.first), np.uint64), self.last - self.first
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.last, self.first[i] + RUN, side="right")))
            lo, hi = self.first[i], self.last[j - 1]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(base, hi - lo)[: hi - lo], out=sums[1:])
            a, b = self.first[i:j] - lo, self.last[i:j] - lo
            out[i:j] = _mixed((sums[b] - sums[a]) * _power(pow(base, -1, 1 << 64), hi - lo)[a] + size[i:j].astype(np.uint64) * _C3)
            i = j
        return out

    def chars(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places in bytes as places in characters of their texts."""
        if not hasattr(self, "_chars"):
            self._chars = np.concatenate([[0], np.cumsum(self.raw & 0xC0 != 0x80)])
        return self._chars[at] - self._chars[self.text[text]]


def recompress(symbols: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents after some rounds: name, document, context from and to (to is past the end), words.

    symbols: the documents' words one after another; starts: where each document starts, and the
    end. A context that depends on a document's border reaches one word beyond it.
    """
    n = len(symbols)
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    s, lo, hi = symbols, np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    size = np.ones(n, np.int64)
    for r in range(rounds):
        if not len(s):
            break
        edge = np.concatenate([[True], doc[1:] != doc[:-1]])  # the first symbol of a document
        # runs
        new = edge | np.concatenate([[True], s[1:] != s[:-1]])
        if not new.all():
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(s)))
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            size = np.add.reduceat(size, at)
            s = np.where(count > 1, _mixed(s[at] * _C1 + count.astype(np.uint64) * _C2 + _C3), s[at])
            doc, edge = doc[at], edge[at]
        last = np.append(edge[1:], True)
        # that a run ends where it does depends on both neighbours
        before = np.where(edge, starts[doc] - 1, np.append(np.int64(0), lo[:-1]))
        after = np.where(last, starts[doc + 1] + 1, np.append(hi[1:], np.int64(0)))
        lo, hi = np.minimum(lo, before), np.maximum(hi, after)
        # pairs
        right = (_mixed(s + _sides[r]) & np.uint64(1)).astype(bool)
        first = ~right & ~last & np.append(right[1:], False)
        second = np.append(False, first[:-1])
        # an unpaired left symbol depends on the next, an unpaired right one on the one before
        alone = ~first & ~second
        before = np.where(edge, starts[doc] - 1, np.append(np.int64(0), lo[:-1]))
        after = np.where(last, starts[doc + 1] + 1, np.append(hi[1:], np.int64(0)))
        new_lo = np.where(alone & right, np.minimum(lo, before), lo)
        new_hi = np.where(alone & ~right, np.maximum(hi, after), hi)
        at = np.flatnonzero(first)
        name = s.copy()
        name[at] = _mixed(s[at] * _C1 + _mixed(s[at + 1] + _C3))
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        total = size.copy()
        total[at] += size[at + 1]
        keep = ~second
        s, doc, lo, hi, size = name[keep], doc[keep], new_lo[keep], new_hi[keep], total[keep]
    return s, doc, lo, hi, size


def open_windows(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """The first words of the windows of `length` words that lie in one document and hold none of the contexts [lo, hi)."""
    n = int(starts[-1])
    bad = np.zeros(n + 2, np.int64)
    a, b = np.maximum(hi - length, 0), lo + 1
    fits = (hi - lo <= length) & (b > a) & (lo >= 0) & (hi <= n)
    np.add.at(bad, a[fits], 1)
    np.add.at(bad, b[fits], -1)
    free = np.cumsum(bad)[:n] == 0
    for_doc = np.repeat(starts[1:], np.diff(starts))
    return np.flatnonzero(free & (np.arange(n) + length <= for_doc))


def window_names(symbols: np.ndarray, at: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Fingerprints of the windows of `length` words from each place on."""
    n = len(symbols)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _power(base, n)[:n], dtype=np.uint64)])
    return _mixed((sums[at + length] - sums[at]) * _power(pow(base, -1, 1 << 64), n)[at])


def _symbols(length: int, rounds: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each symbol of the slice: its first place, and its others if any; symbol null: a document with windows that hold no symbol."""
        ids = batch.column("doc_id").to_numpy()
        words = Words(batch.column("text"))
        size = np.diff(words.starts)
        long = size >= length
        flat = words.hashes()[np.repeat(long, size)]
        starts = np.cumsum(np.append(0, np.where(long, size, 0)))
        s, doc, lo, hi, size = recompress(flat, starts, rounds)
        number = np.arange(len(s)) - np.searchsorted(doc, doc)  # of the symbol in its document
        use = (size >= LEAST_WORDS) & (hi - lo <= length) & (lo >= starts[doc]) & (hi <= starts[doc + 1])
        bare = np.unique(np.searchsorted(starts, open_windows(starts, lo[use], hi[use], length), side="right") - 1)
        s, doc, number = s[use], doc[use], number[use]
        order = np.argsort(s, kind="stable")
        s, doc, number = s[order], doc[order], number[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.empty(0, bool)
        at = np.flatnonzero(new)
        more = np.diff(np.append(at, len(s))) - 1
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(more)])
        null = np.zeros(len(bare), np.int64)
        symbol = pa.concat_arrays([pa.array(s[at].view(np.int64)), pa.nulls(len(bare), pa.int64())])
        others = pa.StructArray.from_arrays([pa.array(ids[doc[~new]].astype(np.int64)), pa.array(number[~new].astype(np.int32))], names=["doc_id", "number"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, null + offsets[-1]).astype(np.int32)), others)
        first = np.concatenate([doc[at], bare]).astype(np.int64)
        return pa.RecordBatch.from_arrays([symbol, pa.array(ids[first].astype(np.int64)), pa.array(np.concatenate([number[at], null - 1]).astype(np.int32)), lists], names=["symbol", "doc_id", "number", "more"])

    return run


def _windows(length: int, rounds: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each window that nothing rules out, with its place in words and in characters."""
        ids = batch.column("doc_id").to_numpy()
        words = Words(batch.column("text"))
        starts, flat = words.starts, words.hashes()
        s, doc, lo, hi, size = recompress(flat, starts, rounds)
        lists = batch.column("numbers")
        numbers, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        recurs = np.zeros(len(s) + 1, bool)
        recurs[(np.searchsorted(doc, np.arange(len(ids)))[owner] + numbers)[numbers >= 0]] = True
        use = ~recurs[: len(s)] & (size >= LEAST_WORDS) & (hi - lo <= length) & (lo >= starts[doc]) & (hi <= starts[doc + 1])
        at = open_windows(starts, lo[use], hi[use], length)
        own = np.searchsorted(starts, at, side="right") - 1
        name = window_names(flat, at, length)
        check = window_names(words.hashes(_OTHER), at, length, _OTHER) if len(at) else name
        a, b = words.chars(words.first[at], own), words.chars(words.last[at + length - 1], own)
        columns = [pa.array(name.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids[own].astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at - starts[own], a, b))]
        return pa.RecordBatch.from_arrays(columns, names=["name", "check", "doc_id", "word", "a", "b"])

    return run


_NAMES = ["doc_id", "first_word", "last_word", "start", "end", "first_doc_id"]


def _passages(doc: np.ndarray, first_word: np.ndarray, last_word: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip((doc, first_word, last_word, a, b, first), (np.int64, *(np.int32,) * 4, np.int64))], names=_NAMES)


def _merged(length: int):
    def run(batches):
        """Windows of one document, in order, to passages: windows that overlap or touch are one."""
        for batch in batches:
            lists = batch.column("windows")
            word, a, b, first = (x.to_numpy() for x in lists.flatten().flatten())
            doc = np.repeat(batch.column("doc_id").to_numpy(), lists.value_lengths().to_numpy())
            at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + length))) if len(doc) else np.empty(0, np.int64)
            end = np.append(at[1:], len(doc)) - 1
            yield _passages(doc[at], word[at], word[end] + length, a[at], b[end], np.minimum.reduceat(first, at) if len(at) else first)

    return run


def _whole(length: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        n = np.diff(words.starts)
        d = np.flatnonzero(n >= length)
        a, b = words.chars(words.first[words.starts[d]], d), words.chars(words.last[words.starts[d + 1] - 1], d)
        return _passages(batch.column("doc_id").to_numpy()[d], np.zeros(len(d), np.int64), n[d], a, b, batch.column("first_doc_id").to_numpy()[d])

    return run


_RESULT = "doc_id bigint, first_word int, last_word int, start int, end int, first_doc_id bigint"


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with or without ids; ids is a written table, so counting it is cheap."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def repeats(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, first_word, last_word, start, end, first_doc_id): the maximal passages all of whose windows of `length` words occur more than once in the corpus.

    Words are what white space divides, compared as they are. Words count from 0, last_word is
    past the end; start and end count characters from 0. A place of its own in the same
    document counts as another occurrence. first_doc_id is the least document that holds one of
    the passage's windows. A document that equals another (by SHA-256 of its text) is one passage as a
    whole, if it's long enough. Null and empty texts, texts of fewer words and rows with a null
    id have no passage; rows with one doc_id are one document, with the least of their texts.
    Texts of any length are searched whole; other columns are ignored whatever their names. An
    empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    prints = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h"))
    same = prints.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    equal = stored(prints.join(same, "h").select("doc_id", "first_doc_id"), "equal")
    copies = stored(equal.where("doc_id <> first_doc_id").select("doc_id"), "copies")
    once = _joined(docs, copies, "left_anti")
    symbols = stored(map_slices(once, _symbols(length, rounds), "symbol bigint, doc_id bigint, number int, more array<struct<doc_id:bigint,number:int>>"), "symbols")
    # counted with a partial sum in each task, so that a symbol of a third of all documents is a few rows; then the places of those that recur
    recurring = symbols.where("symbol IS NOT NULL").groupBy("symbol").agg(F.sum(F.size("more") + 1).alias("n")).where("n > 1").select("symbol")
    places = symbols.join(recurring, "symbol", "left_semi").select(F.explode(F.concat(F.array(F.struct("doc_id", "number")), "more")).alias("p")).select("p.*")
    marked = places.union(symbols.where("symbol IS NULL").select("doc_id", "number")).groupBy("doc_id").agg(F.collect_list("number").alias("numbers"))
    windows = stored(map_slices(once.join(marked, "doc_id"), _windows(length, rounds), "name bigint, check bigint, doc_id bigint, word int, a int, b int"), "windows")
    again = windows.groupBy("name", "check").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
    whole = _joined(docs, equal, "inner").select("doc_id", "text", "first_doc_id")
    lone = windows.join(F.broadcast(equal.select("doc_id")) if equal.count() <= BROADCAST_IDS else equal.select("doc_id"), "doc_id", "left_anti")
    lists = lone.join(again, ["name", "check"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "a", "b", "first"))).alias("windows"))
    return lists.mapInArrow(_merged(length), _RESULT).union(map_slices(whole, _whole(length), _RESULT))
