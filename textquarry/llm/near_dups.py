"""Near duplicates by Order MinHash.

A document's k-mers are runs of K words, each labelled with how often it occurred before. A
sketch takes the ORDER k-mers with the least hashes and keeps them in the order of the text, so
that two documents agree on a sketch with a chance that falls with their edit distance, not
just with the words they share. Documents that agree on any of SKETCHES sketches are
candidates, and so is every pair that can be similar enough and whose shorter text has fewer than
SHORT words: cut into one piece more than the edits allowed, it has a piece in common with the
other, near the same place. An alignment of words within the band that the least similarity
allows verifies candidates.
Groups are the connected components of verified candidates.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import Generations, map_slices, small_batches, stored, worker_state
from textquarry.llm.components import components

#: Words of a k-mer, k-mers of a sketch, sketches of a document, edit similarity of near duplicates.
K, ORDER, SKETCHES, SIMILARITY = 3, 2, 24, 0.8
#: Pairs whose shorter text has fewer words are found exactly.
SHORT = 30
#: A set of ids is broadcast up to this size; beyond it a join shuffles.
BROADCAST_IDS = 1_000_000
#: Entries of a generation of a worker's cache of words.
CACHE = 150_000
#: Bits that stand for a text's words, a short text's; documents of a bucket that one task compares with as many others; pairs that it looks at together.
BITS, SHORT_BITS, CELL, PAIRS = 1024, 256, 4096, 100_000

_marks = string.punctuation + "«»„“”‘’‚…–—¿¡·"
_random = np.random.Generator(np.random.PCG64(20240229))
_odd = _random.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """The text's words: cut at white space, lower case, without marks at their ends."""
    return [w for c in text.lower().split() if (w := c.strip(_marks))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _labelled(h: np.ndarray) -> np.ndarray:
    """The hashes, those that occurred before mixed with how often."""
    n = len(h)
    at = np.argsort(h, kind="stable")
    s = h[at]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    place = np.arange(n)
    label = np.empty(n, np.uint64)
    label[at] = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(label > 0, _mixed(h + label * np.uint64(0xD6E8FEB86659FD93)), h)


class Sketcher:
    def __init__(self, k: int = K, order: int = ORDER, sketches: int = SKETCHES):
        self.k, self.order, self.sketches = k, order, sketches
        self.known = Generations(CACHE)

    @staticmethod
    def _hashed(chunks: list[str]) -> list[int]:
        return [xxhash.xxh3_64_intdigest(w) | 1 if (w := c.strip(_marks)) else 0 for c in chunks]

    def hashes(self, text: str) -> np.ndarray:
        """A 64-bit hash for each word."""
        chunks = text.lower().split()
        out = np.fromiter(self.known.find(chunks, self._hashed), np.uint64, len(chunks))
        return out[out > 0]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, int, bytes] | None:
        """A 128-bit hash of the whole sequence of words, the sketches, the number of words, their set as bits; None without words."""
        w = self.hashes(text)
        if not len(w):
            return None
        whole = xxhash.xxh3_128_digest(w.tobytes())
        n = max(len(w) - self.k + 1, 1)
        h = np.zeros(n, np.uint64)
        for i in range(min(self.k, len(w))):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
        h = _labelled(h)
        out = np.empty(self.sketches, np.uint64)
        step = max(1, 2_000_000 // n)
        for j in range(0, self.sketches, step):
            x = h[None, :] * _odd[j : min(j + step, self.sketches), None]
            x ^= x >> np.uint64(32)
            rows = np.arange(len(x))
            chosen = []
            for _ in range(min(self.order, n)):
                p = x.argmin(1)
                chosen.append(p)
                x[rows, p] = np.uint64(0xFFFFFFFFFFFFFFFF)
            key = np.arange(j, j + len(x), dtype=np.uint64)
            for p in np.sort(np.stack(chosen), axis=0):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[p])
            out[j : j + len(x)] = key
        return whole, out.view(np.int64), len(w), word_bits(w)


def banded(a: list[str], b: list[str], most: int) -> int | None:
    """The edit distance of two sequences if it's at most `most`, else None; cells beyond the band of 2 * most + 1 diagonals aren't looked at.

    A column's differences inside the band are the bits of one integer, which moves down a row a column.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return None
    if not n:
        return m
    d = min(most, m)
    width = 2 * d + 1
    mask = (1 << width) - 1
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    vp, vn, distance = mask >> d << d, 0, d
    for j in range(1, n + 1):
        shift = j - d - 1
        x = where.get(b[j - 1], 0)
        x = (x >> shift if shift >= 0 else x << -shift) & mask
        d0 = (((x & vp) + vp) ^ vp | x | vn) & mask
        hp, hn = vn | mask & ~(d0 | vp), d0 & vp
        if j <= m - d:
            distance += not d0 >> 2 * d & 1
        else:
            bit = m - j + d
            distance += (hp >> bit & 1) - (hn >> bit & 1)
        if j <= m - d and distance > most + 2 * d:
            return None
        vp, vn = hn | mask & ~(d0 >> 1 | hp), d0 >> 1 & hp
    return distance if distance <= most else None


def similar(a: list[str], b: list[str], least: float = SIMILARITY) -> float | None:
    """1 - edit distance / longer length if that's at least `least`, else None. Lengths and word counts, which bound the distance from below, are looked at first."""
    longer = max(len(a), len(b))
    if not longer:
        return None
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return None
    x, y = Counter(a), Counter(b)
    common = sum(min(n, y[w]) for w, n in x.items() if w in y)
    if longer - common > most:
        return None
    d = banded(a, b, most)
    return None if d is None else 1 - d / longer


def word_bits(w: np.ndarray, size: int = BITS) -> bytes:
    """The words (from their hashes), each with how often it occurred before, as a set of so many bits. An edit sets one bit and clears one at most, so that the edits between two texts are no fewer than the bits that one has and the other hasn't."""
    bits = np.zeros(size, bool)
    bits[(_labelled(w) >> np.uint64(40)) % np.uint64(size)] = True
    return np.packbits(bits).tobytes()


def _edits(words: int, least: float) -> int:
    """The most edits between texts of which the longer has so many words."""
    return int((1 - least) * words + 1e-9)


def _longest(words: int, least: float) -> int:
    """The most words of a text that can be similar enough to a text of so many."""
    longest = words
    while longest + 1 - words <= _edits(longest + 1, least):
        longest += 1
    return longest


@cache
def _pieces(words: int, least: float) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text of so many words: one more than its edits to any longer text."""
    n = _edits(_longest(words, least), least) + 1
    return [(i * words // n, (i + 1) * words // n) for i in range(n)]


def short_keys(w: np.ndarray, least: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Keys of the pieces of a text (from its words' hashes), and of the runs of its words that can be a piece of a text no longer than it. Of two similar texts, the longer has one of the shorter's pieces among its runs, if the shorter has fewer than SHORT words."""

    def key(a: int, b: int, words: int, i: int) -> int:
        return xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=words * SHORT + i) - (1 << 63)

    n, most = len(w), _edits(len(w), least)
    own = [key(a, b, n, i) for i, (a, b) in enumerate(_pieces(n, least))] if n < SHORT else []
    runs = set()
    for words in range(max(1, n - most), min(n, SHORT - 1) + 1):
        more = n - words
        for i, (a, b) in enumerate(_pieces(words, least)):
            # words moved by s take |s| edits before the piece and |s - more| behind it
            for start in range(max(0, a - (most - more) // 2), min(n - (b - a), a + (most + more) // 2) + 1):
                runs.add(key(start, start + b - a, words, i))
    return own, list(runs)


def _short_pairs(docs: DataFrame, least: float) -> DataFrame:
    """(u, v), u < v: the pairs of short documents that have a piece in common."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketcher = worker_state("near_dups", (), Sketcher)
        ids, keys, own, words, bits = [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            w = sketcher.hashes(text)
            pieces, runs = short_keys(w, least)
            n = len(pieces) + len(runs)
            ids += [doc_id] * n
            keys += pieces + runs
            own += [True] * len(pieces) + [False] * len(runs)
            words += [len(w)] * n
            bits += [word_bits(w, SHORT_BITS)] * n
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(own, pa.bool_()), pa.array(words, pa.int32()), pa.array(bits, pa.binary())], names=["doc_id", "key", "own", "words", "bits"])

    keys = stored(map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, key bigint, own boolean, words int, bits binary"), "short_keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("some"), F.min("own").alias("all"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("some AND NOT all AND lo < hi").select("key", "n")
    return _alike(keys.join(sizes, "key").select("key", "n", "doc_id", F.col("doc_id").alias("label"), "words", F.when(F.col("own"), 1).otherwise(2).alias("role"), "bits"), least)


def _alike(rows: DataFrame, least: float) -> DataFrame:
    """(u, v), u < v: pairs of rows (key, n: rows of the key, doc_id, label, words, role, bits) of one key that differ in label and whose numbers and bits of words don't rule out that they are similar. Of a pair, one has the role 1 and the other 2; 3 is both.

    No text is read. A key's rows are dealt out to blocks and each two blocks are compared by one
    task, so that neither its memory nor its work grows with the key's rows.
    """
    blocks = F.ceil(F.col("n") / CELL)
    block = F.pmod(F.xxhash64("doc_id"), blocks)
    rows = rows.withColumns({"blocks": blocks, "block": block})
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least("block", j) * F.col("blocks") + F.greatest("block", j))
    rows = rows.select("key", F.explode(cells).alias("cell"), "block", F.col("blocks"), "doc_id", "label", "words", "role", "bits")
    small_batches(rows.sparkSession)
    # a cell of two blocks compares across them, one of a single block inside it
    rows = rows.select("key", "cell", F.when(F.col("cell") % F.col("blocks") == F.floor(F.col("cell") / F.col("blocks")), -1).otherwise(F.col("block")).alias("block"), "doc_id", "label", "words", "role", "bits")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(lambda batches: _pairs_of(batches, least), "u bigint, v bigint").distinct()


def _pairs_of(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of _alike() from its rows, sorted by key and cell; a group that goes on in the next batch waits for it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = (pc.equal(now["key"], now["key"][-1]).to_numpy() & pc.equal(now["cell"], now["cell"][-1]).to_numpy()).argmax()
        if last:
            yield from _pairs(now.slice(0, last), least)
        rest = now.slice(last)
    if rest is not None:
        yield from _pairs(rest, least)


def _pairs(rows: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups."""
    key, cell, block, doc, label, words, role = (rows[c].to_numpy() for c in ("key", "cell", "block", "doc_id", "label", "words", "role"))
    n, words = len(key), words.astype(np.int64)
    group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
    order = np.lexsort((words, group))
    block, doc, label, words, role, group = block[order], doc[order], label[order], words[order], role[order], group[order]
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(n, -1)[order]
    held = np.bitwise_count(bits).sum(1, dtype=np.int64)
    # each row with those behind it in its group that aren't too long for it
    wide = np.int64(1) << 40
    ends = np.searchsorted(group * wide + words, group * wide + (words / least).astype(np.int64) + 2, side="right")
    counts = ends - np.arange(n) - 1
    upto = np.cumsum(counts)
    for a in range(0, int(upto[-1]), PAIRS):
        at = np.arange(a, min(a + PAIRS, int(upto[-1])))
        i = np.searchsorted(upto, at, side="right")
        j = at - (upto[i] - counts[i]) + i + 1
        most = ((1 - least) * words[j] + 1e-9).astype(np.int64)
        ok = (label[i] != label[j]) & (words[j] - words[i] <= most) & ((block[i] < 0) | (block[i] != block[j])) & ((role[i] & 1) & (role[j] >> 1) | (role[i] >> 1) & (role[j] & 1)).astype(bool)
        i, j, most = i[ok], j[ok], most[ok]
        common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        ok = np.maximum(held[i], held[j]) - common <= most
        u, v = doc[i[ok]], doc[j[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, sketches, words, bits) of each document with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketcher = worker_state("near_dups", (), Sketcher)
        found = [sketcher(t or "") for t in batch.column("text").to_pylist()]
        keep = [i for i, f in enumerate(found) if f]
        flat = np.concatenate([found[i][1] for i in keep]) if keep else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * SKETCHES), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([found[i][0] for i in keep], pa.binary()), lists, pa.array([found[i][2] for i in keep], pa.int32()), pa.array([found[i][3] for i in keep], pa.binary())], names=["doc_id", "whole", "sketches", "words", "bits"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, whole binary, sketches array<bigint>, words int, bits binary")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (u, v) of pairs that are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("other")), "v").select("u", "v", "text", "other")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache: dict[str, list[str]] = {}
        ok = []
        for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist()):
            wa = cache.get(a) or cache.setdefault(a, words_of(a))
            wb = cache.get(b) or cache.setdefault(b, words_of(b))
            ok.append(similar(wa, wb, least) is not None)
        return batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    return map_slices(both, run, "u bigint, v bigint")


def _alike_lengths(a: str, b: str, least: float) -> Column:
    """Whether texts of so many words can be similar enough: each word that one has more is an edit."""
    longer = F.greatest(a, b)
    return longer - F.least(a, b) <= F.floor((1 - least) * longer + 1e-9)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with an id in ids (distinct); ids is a written table, so counting it is cheap."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, kept_doc_id): each document to drop and the one of its group, that of the least doc_id, that stays.

    Documents without words (null, empty, marks alone) and rows with a null id are in no group.
    Rows with one doc_id are one document, with the least of their texts. Equal texts, and texts
    equal but for case, white space and marks at the words' ends, are always in one group.
    Texts of any length are sketched and aligned whole; every pair that shares a sketch, or a
    piece where the shorter text has fewer than SHORT words, is verified unless the numbers or the counts of
    their words rule it out or other verified pairs already put both in one group. Other columns
    are ignored whatever their names. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    sig = stored(signatures(docs), "signatures")
    same = stored(sig.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "same")
    copies = stored(sig.select("doc_id", "whole").join(same, "whole").where("doc_id <> first").select("doc_id", "first"), "copies")
    ones = sig.select("doc_id", "words", "sketches").join(copies.select("doc_id"), "doc_id", "left_anti")
    keys = ones.select("doc_id", "words", F.explode("sketches").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("doc_id", "words")).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keys.join(buckets.select("key", F.col("l.doc_id").alias("leader"), F.col("l.words").alias("leader_words")), "key"), "members")
    short = stored(ones.where(F.col("words") <= _longest(SHORT - 1, least)).select("doc_id"), "short")
    pairs = stored(_short_pairs(_only(docs, short), least), "short_pairs")
    ids = members.select("doc_id").union(pairs.select("u")).union(pairs.select("v")).distinct()
    texts = stored(_only(docs, stored(ids, "ids")), "texts")
    # the leader of a bucket first: that puts most of a bucket in one group
    led = members.where("doc_id <> leader").where(_alike_lengths("words", "leader_words", least)).select(F.col("leader").alias("u"), F.col("doc_id").alias("v"))
    tried = stored(led.union(pairs).distinct(), "tried")
    edges = stored(_verified(tried, texts, least), "edges")
    label = components(edges)
    labelled = stored(members.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "words", F.coalesce("label", "doc_id").alias("label")), "labelled")
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    open_ = stored(labelled.join(split, "key"), "open")
    bits = sig.select("doc_id", "bits").join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = _alike(open_.join(bits, "doc_id").select("key", "n", "doc_id", "label", "words", F.lit(3).alias("role"), "bits"), least)
    more = stored(_verified(stored(rest.join(tried, ["u", "v"], "left_anti"), "rest"), texts, least), "edges")
    if more.limit(1).count():
        label = components(edges.union(more))
    groups = label.select(F.col("id").alias("doc_id"), F.col("label").alias("kept_doc_id"))
    # copies follow the document that stands for them
    moved = copies.join(label, F.col("first") == F.col("id"), "left").select("doc_id", F.coalesce("label", "first").alias("kept_doc_id"))
    return groups.union(moved)


def without_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without the documents that near_duplicates() drops; rows with one doc_id are one document, of which one row stays (the first by all columns). Rows that are in no group stay, those with a null id too."""
    drop = stored(near_duplicates(docs, least).select("doc_id", F.lit(True).alias("dropped")), "drop")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(again.join(drop, "doc_id", "left_anti").select("doc_id", F.lit(False).alias("dropped")), "again")
    marks = stored(drop.union(again), "marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    columns = docs.columns
    flag = "dropped" if "dropped" not in columns else "_".join(["dropped", *columns])
    all_ = docs.join(marks.withColumnRenamed("dropped", flag), "doc_id", "left").select(*columns, flag)
    once = all_.where(f"`{flag}` IS NULL").select(*columns)
    if not again.limit(1).count():
        return once
    twice = all_.where(f"NOT `{flag}`").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return once.union(twice)
