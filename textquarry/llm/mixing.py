"""Mixing sources to target weights.

Each source's documents are encoded and packed into blocks of BLOCK tokens. To pack in parallel, a
source's stream is made of chunks: a hash of document and text deals documents to chunks, a
chunk's documents follow each other in the order of doc_id, and its last block is shorter. The
blocks of a source are numbered through, chunk by chunk. Output shards have SHARD slots; for each shard a multinomial draw says how many slots each source gets
and where. The m-th draw of a source takes its block number p(m mod n), where n is its number of
blocks and p a pseudorandom permutation (a Feistel network on [0, n) with cycle walking) that
changes with each pass through the source. Slots then meet blocks in a join by index. Texts are
shuffled once, to be packed, and tokens once, to meet their slots; all else moves numbers alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.bpe import PATTERN, Encoder, Vocabulary
from textquarry.llm.common import slices, small_batches, stored, worker_state

#: Tokens in a block, slots in a shard, power of a source's size that its target weight is, seed of the draws.
BLOCK, SHARD, ALPHA, SEED = 2048, 64, 0.7, 17
#: Documents in a chunk of the corpus, about; shards whose counts are added up together.
CHUNK, SHARDS = 4096, 4096
PRIME = 2147483647
#: PATTERN without its look-ahead, which tiktoken runs by an automaton in place of a backtracking engine. It cuts texts alike in which no white space follows white space and none ends the text.
PLAIN = PATTERN.replace(r"|\s+(?!\S)", "")
#: Stands for special tokens, which are never asked for: without any, tiktoken's search for them stops at every character.
NEVER = "<|never|>"
#: Python's white space holds all that tiktoken's pattern takes for it.
_spaced = re.compile(r"\s(?:\s|\Z)").search


def hashed(*parts: Column) -> Column:
    """48 pseudorandom bits from the parts' strings, as a bigint; MD5, so that any engine gets the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("bigint")


def _stream(source: Column) -> Column:
    """A name for a source, null too."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _source(stream: Column) -> Column:
    return F.when(stream != "", F.substring(stream, 2, 1 << 30))


class _Packer:
    """Packs the token ids of documents into blocks; keeps the one that isn't full."""

    def __init__(self, block: int):
        self.block, self.key, self.number, self.size, self.parts = block, None, 0, 0, []
        self.out: list[tuple] = []

    def _close(self) -> None:
        if self.size:
            self.out.append((*self.key, self.number, self.size, self.parts))
            self.number, self.size, self.parts = self.number + 1, 0, []

    def add(self, key: tuple, ids: np.ndarray, of) -> None:
        """of(a, b): what is kept of a document's tokens a to b."""
        if key != self.key:
            self.end()
            self.key, self.number = key, 0
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.block - self.size)
            self.parts.append((*of(at, at + n), ids[at : at + n]))
            self.size += n
            at += n
            if self.size == self.block:
                self._close()

    def end(self) -> None:
        if self.key is not None:
            self._close()


def token_ids(v: Vocabulary) -> Callable[[str], np.ndarray]:
    """A function that gives a text's token ids."""
    special = {NEVER: max(v.ranks.values()) + 1}
    whole = tiktoken.Encoding("mixing", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens=special)
    plain = tiktoken.Encoding("mixing-plain", pat_str=PLAIN, mergeable_ranks=v.ranks, special_tokens=special) if v.pattern == PATTERN else whole

    def ids(text: str) -> np.ndarray:
        try:
            return (plain if _spaced(text) is None else whole).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack ends at runs of about a million spaces
            return np.frombuffer(Encoder(v).encode([text])[0], np.int32)

    return ids


def _bounds(raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """Where each token of a text ends, in bytes, moved on to the next character's start."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(raw + b" ", np.uint8)
    while (inside := data[ends] & 0xC0 == 0x80).any():
        ends = ends + inside
    return ends


def blocks(docs: DataFrame, vocabulary: Vocabulary, block: int = BLOCK, keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """(stream, chunk, number, n_tokens, doc_ids, tokens): the packed blocks of each stream's chunks. With texts, in place of tokens: parts, an array of (doc_id, *keep, text), whose texts are cut at characters: one that a border of blocks cuts in two counts to the block it starts in."""
    kinds = dict(docs.dtypes)
    docs = docs.select("source", "doc_id", "text", *keep).where(F.length("text") > 0)
    # a chunk may hold a number of documents that follows the table's size alone
    chunks = max(1, -(-docs.count() // CHUNK))
    # the text is hashed too: rows with one doc_id, or none, needn't come together
    docs = docs.select(_stream(F.col("source")).alias("stream"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text", *keep)
    docs = docs.repartition("stream", "chunk").sortWithinPartitions("stream", "chunk", F.col("doc_id").asc_nulls_first(), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = ", ".join(f"`{c}`: {kinds[c]}" for c in keep)
    parts = f"parts array<struct<doc_id: {kinds['doc_id']}, {fields}{', ' if keep else ''}text: string>>" if texts else f"doc_ids array<{kinds['doc_id']}>, tokens array<int>"

    def made():
        v = shared.value
        sizes = np.zeros(max(v.ranks.values()) + 1, np.int64)
        for token, rank in v.ranks.items():
            sizes[rank] = len(token)
        return token_ids(v), sizes

    def batch_of(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in out], pa.string()), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3))]
        names, own = ["stream", "chunk", "number", "n_tokens"], [p for r in out for p in r[4]]
        offsets = pa.array(np.cumsum([0, *(len(r[4]) for r in out)]), pa.int32())
        flat = [pa.array([p[i] for p in own], t) for i, t in enumerate(types)]
        if texts:
            struct = pa.StructArray.from_arrays([*flat, pa.array([p[len(types)] for p in own], pa.string())], names=["doc_id", *keep, "text"])
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, struct)], names=[*names, "parts"])
        tokens = np.concatenate([p[-1] for p in own]).astype(np.int32) if own else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r[3] for r in out)]), pa.int32()), pa.array(tokens))
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat[0]), lists], names=[*names, "doc_ids", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, sizes = worker_state("mixing", (shared.value,), made)
        packer, types = _Packer(block), None
        for batch in batches:
            for part in slices(batch):
                types = [part.schema.field(c).type for c in ("doc_id", *keep)]
                rows = zip(*(part.column(c).to_pylist() for c in ("stream", "chunk", "text", "doc_id", *keep)))
                for stream, chunk, text, *own in rows:
                    ids = encoded(text)
                    if texts:
                        raw = text.encode()
                        ends = _bounds(raw, sizes[ids])
                        packer.add((stream, chunk), ids, lambda a, b, own=own, raw=raw, ends=ends: (*own, raw[ends[a] : ends[b]].decode()))
                    else:
                        packer.add((stream, chunk), ids, lambda a, b, own=own: own)
                if packer.out:
                    yield batch_of(packer.out, types)
                    packer.out = []
        packer.end()
        if packer.out:
            yield batch_of(packer.out, types)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"stream string, chunk bigint, number bigint, n_tokens bigint, {parts}")


def permuted(source: str, epoch: int, i: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The images of the indices i under the source's permutation of [0, n) for the epoch."""
    h = int(np.ceil(np.sqrt(n)))
    while h * h < n:
        h += 1
    keys = [int(hashlib.md5(f"{seed}|{source}|{epoch}|{j}".encode()).hexdigest()[:12], 16) % PRIME for j in range(4)]
    out = np.asarray(i, np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        x = out[left]
        a, b = x // h, x % h
        for key in keys:
            t = (b * 1103515245 + key) % PRIME
            a, b = b, (a + t * t % PRIME) % h
        out[left] = a * h + b
        left = left[out[left] >= n]
    return out


def before(df: DataFrame, by: str, order: str, n: str, run: int) -> DataFrame:
    """df, in which `order` counts from 0, with `before`: the sum of n over the rows of the same `by` and a lower `order`. Sums of runs are added up first, so that no window holds all rows of a key."""
    df = df.withColumn("run", F.floor(F.col(order) / run))
    sums = df.groupBy(by, "run").agg(F.sum(n).alias("sum"))
    base = sums.select(by, "run", (F.sum("sum").over(Window.partitionBy(by).orderBy("run")) - F.col("sum")).alias("base"))
    inside = F.sum(n).over(Window.partitionBy(by, "run").orderBy(order)) - F.col(n)
    return df.withColumn("inside", inside).join(base, [by, "run"]).withColumn("before", F.col("base") + F.col("inside")).drop("run", "base", "inside")


def slots(sizes: DataFrame, shard: int = SHARD, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(shard, slot, stream, epoch, block) from (stream, blocks): which block each of as many slots as there are blocks gets. A row for each source is all that the driver sees."""
    spark = sizes.sparkSession
    known = sorted((r.stream, int(r.blocks)) for r in sizes.collect())
    weights = [int(np.floor(1000 * n**alpha)) for _, n in known]
    total, everything = sum(weights), sum(n for _, n in known)
    streams = spark.createDataFrame([(s, n) for s, n in known], "stream string, blocks bigint")
    bounds = np.cumsum([0, *weights]).tolist()
    drawn = spark.range(everything).select(F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"), (hashed(F.lit(seed), F.col("id")) % F.lit(max(total, 1))).alias("u"))
    names = F.array(*(F.lit(s) for s, _ in known)) if known else F.array(F.lit(""))
    # the source whose range of weights holds u
    place = F.size(F.filter(F.array(*(F.lit(b).cast("bigint") for b in bounds)), lambda b: b <= F.col("u")))
    drawn = drawn.select("shard", "slot", F.element_at(names, place).alias("stream"), F.floor(F.col("shard") / SHARDS).alias("run"))
    # draws are numbered in runs of shards, to which what came before is added, so that no window holds all of a stream
    base = drawn.groupBy("stream", "run").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("stream", "run", (F.sum("n").over(Window.partitionBy("stream").orderBy("run")) - F.col("n")).alias("base"))
    numbered = drawn.withColumn("k", F.row_number().over(Window.partitionBy("stream", "run").orderBy("shard", "slot")) - 1)
    m = numbered.join(base, ["stream", "run"]).join(F.broadcast(streams), "stream").select("shard", "slot", "stream", "blocks", (F.col("base") + F.col("k")).alias("m"))

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["epoch"] = f.m // f.blocks
            f["block"] = f.m % f.blocks
            for (stream, epoch), own in f.groupby(["stream", "epoch"]):
                f.loc[own.index, "block"] = permuted(stream, int(epoch), own.block.to_numpy(), int(own.blocks.iloc[0]), seed)
            yield f[["shard", "slot", "stream", "epoch", "block"]]

    return m.mapInPandas(mapped, "shard bigint, slot bigint, stream string, epoch bigint, block bigint")


def _mixed(packed: DataFrame, shard: int, alpha: float, seed: int) -> DataFrame:
    """The rows of packed, a written table, that the slots draw, with shard, slot, source, epoch and block."""
    chunks = packed.groupBy("stream", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chosen = slots(chunks.groupBy("stream").agg(F.sum("n").alias("blocks")), shard, alpha, seed)
    numbers = before(chunks, "stream", "chunk", "n", CHUNK).select("stream", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("number"), "before")
    placed = chosen.join(numbers.select("stream", "chunk", "number", (F.col("before") + F.col("number")).alias("block")), ["stream", "block"])
    # the slots' rows are small: hashed, they spare the blocks a sort
    return packed.join(placed.hint("shuffle_hash"), ["stream", "chunk", "number"]).withColumn("source", _source(F.col("stream")))


def mix(docs: DataFrame, vocabulary: Vocabulary, block: int = BLOCK, shard: int = SHARD, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_ids, tokens): the mixed blocks, as many as the corpus has.

    A source's target weight is its number of blocks to the power alpha: large sources lose
    blocks to small ones, which come again. Rows with a null source are a source of their own.
    Documents with a null or empty text take no part. A block has `block` tokens but the last of
    each chunk of a source. Null ids come first in a chunk; rows with one doc_id in one chunk
    follow each other in the order of their texts; repeated rows count each. Texts of any length
    are cut at block borders. Other columns are ignored whatever their names. An empty table
    gives an empty one.
    """
    packed = stored(blocks(docs, vocabulary, block), "blocks")
    return _mixed(packed, shard, alpha, seed).select("shard", "slot", "source", "epoch", "block", "n_tokens", "doc_ids", "tokens")


def mixed_documents(docs: DataFrame, vocabulary: Vocabulary, block: int = BLOCK, shard: int = SHARD, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each slot that mix() would fill, the parts of documents in its block, with their doc_id, lang and source and their own n_chars, in the columns doc_id, text, lang, source, n_chars. What large sources lose and small ones repeat, and the rest, as for mix()."""
    packed = stored(blocks(docs, vocabulary, block, ("lang",), texts=True), "blocks")
    parts = _mixed(packed, shard, alpha, seed).select("source", F.explode("parts").alias("p"))
    kinds = dict(docs.dtypes)
    return parts.select("p.doc_id", "p.text", "p.lang", "source", F.length("p.text").cast(kinds.get("n_chars", "bigint")).alias("n_chars"))
