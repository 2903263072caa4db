"""Line quality by a linear-chain conditional random field.

Each line of a document is content or boilerplate. Features describe a line alone and its
repetition in its document; transitions tie neighbours. Training maximises the conditional
likelihood on a bounded sample of labelled documents, whose lines take the document's label;
Viterbi decoding marks the lines of every document, and the share of content, by characters,
decides whether the document stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_slices, stored

#: Labelled documents to fit on at most: those first in the order of a hash of doc_id.
SAMPLE = 2000
#: A document stays if at least this share of its characters is content.
LEAST_SHARE = 0.5
#: Lines per training sequence; longer documents give several.
SEQUENCE, ROUNDS = 40, 80

# classes of bytes: 0 other letters and bytes beyond ASCII, 1 upper case, 2 digits, 3 spaces, 4 marks of prose, 5 other marks
_class = np.zeros(256, np.uint8)
_class[65:91] = 1
_class[48:58] = 2
_class[[9, 11, 12, 13, 32]] = 3
_class[[ord(c) for c in ".,;:'\"-()?"]] = 4
_class[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
# the second bytes of two-byte capitals after C3: À to Þ
_capital = np.zeros(256, bool)
_capital[0x80:0x9F] = True
_capital[0x97] = False

FEATURES = 22


def lines_of(text: str) -> list[str]:
    """The text cut at line feeds; a last empty line doesn't count."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return lines


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features (one row a line, all 0 or 1), the number of each one's text, its length in bytes."""
    cut = [lines_of(t) for t in texts]
    doc = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    flat = [line for c in cut for line in c]
    if not flat:
        return np.zeros((0, FEATURES)), doc, np.zeros(0)
    raw = np.frombuffer("\n".join(flat).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    kinds = _class[raw]
    capitals = np.flatnonzero(_capital[raw[1:]] & (raw[:-1] == 0xC3)) + 1
    kinds[capitals] = 1
    line = np.repeat(np.arange(len(flat)), sizes + 1)
    counts = np.bincount(line * 6 + kinds, minlength=6 * len(flat)).reshape(-1, 6)
    counts[:, 0] -= 1 + np.bincount(line[raw >> 6 == 2], minlength=len(flat))  # the line feed; bytes that only continue a character
    chars = np.maximum(counts.sum(1), 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    words, distinct, again, most = (np.empty(len(flat)) for _ in range(4))
    at = 0
    for c in cut:
        seen: dict[str, int] = {}
        spread: set[str] = set()
        total = 0
        for text in c:
            w = text.split()
            own = set(w)
            words[at], distinct[at] = len(w), len(own)
            total += len(w)
            most[at] = len(own & spread) / len(own) if len(own) > 7 else 0
            spread |= own
            again[at] = seen.get(text, 0)
            seen[text] = 1
            at += 1
    upper, digits, prose, marks = (counts[:, i] / chars for i in (1, 2, 4, 5))
    ratio = distinct / np.maximum(words, 1)
    width = letters / np.maximum(words, 1)
    x = np.stack(
        [
            np.ones(len(flat)), chars < 15, (chars >= 15) & (chars < 60), chars >= 400, words <= 3,
            counts[:, 1] / letters > 0.5, counts[:, 1] / letters > 0.2, digits > 0.1, digits > 0.3, marks > 0.02, marks > 0.08, marks > 0.2,
            prose < 0.005, prose > 0.15, (words > 8) & (ratio < 0.2), (words > 8) & (ratio < 0.5), (words > 8) & (ratio > 0.8),
            width < 2.5, width > 9, again > 0, most > 0.9, counts[:, 3] / chars > 0.3,
        ],
        axis=1,
    ).astype(np.float64)
    return x, doc, sizes.astype(np.float64)


class Crf:
    """Weights of a two-label chain: label 1 is content. emit: features x 2, move: label x next label, first: label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.emit, self.move, self.first = emit, move, first

    def viterbi(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best labels of all lines, document by document; content wins ties."""
        scores = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        f0, f1 = self.first.tolist()
        n, docs = len(scores), doc.tolist()
        to0, to1 = bytearray(n), bytearray(n)  # the label before, if this one is 0 or 1
        last = bytearray(n)
        a = b = 0.0
        for i, (s0, s1) in enumerate(scores):
            if i == 0 or docs[i] != docs[i - 1]:
                a, b = f0 + s0, f1 + s1
            else:
                x0, y0, x1, y1 = a + m00, b + m10, a + m01, b + m11
                to0[i], to1[i] = y0 >= x0, y1 >= x1
                a, b = max(x0, y0) + s0, max(x1, y1) + s1
            last[i] = b >= a
        labels = np.empty(n, np.int8)
        now = 1
        for i in range(n - 1, -1, -1):
            if i == n - 1 or docs[i] != docs[i + 1]:
                now = last[i]
            labels[i] = now
            now = to1[i] if now else to0[i]
        return labels


def train(x: np.ndarray, doc: np.ndarray, good: list[int], rounds: int = ROUNDS) -> Crf:
    """From the features of all lines, the number of each one's document and the documents' labels. Gradient ascent (Adagrad) with the forward-backward sums over all sequences at once; documents of the rarer label weigh more, so that both count alike. Without documents of both labels every line is content."""
    emit, move, first = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    gold = np.array(good, np.int64)
    if not len(x) or not 0 < gold[np.unique(doc)].sum() < len(np.unique(doc)):
        return Crf(emit, move, first)
    _, begin, count = np.unique(doc, return_index=True, return_counts=True)
    pieces = [(b + k, min(SEQUENCE, n - k)) for b, n in zip(begin, count) for k in range(0, n, SEQUENCE)]
    steps = max(n for _, n in pieces)
    own = np.array([gold[doc[b]] for b, _ in pieces])
    weight = np.where(own == 1, 0.5 / max(own.mean(), 1e-9), 0.5 / max(1 - own.mean(), 1e-9))
    pad = np.zeros((len(pieces), steps, FEATURES))
    mask = np.zeros((len(pieces), steps))
    for p, (b, n) in enumerate(pieces):
        pad[p, :n], mask[p, :n] = x[b : b + n], 1
    target = np.zeros((len(pieces), 2))
    target[np.arange(len(pieces)), own] = 1
    inside = mask[:, 1:, None, None]
    flat = pad.reshape(-1, FEATURES)
    seen = [np.full_like(v, 1e-6) for v in (emit, move, first)]
    sums = lambda v, axis: (top := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis))
    for _ in range(rounds):
        s = pad @ emit
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = first + s[:, 0]
        for t in range(1, steps):
            new = sums(alpha[:, t - 1, :, None] + move, 1) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = sums(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, beta[:, t + 1])
        z = sums(alpha[:, -1], 1)
        state = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside
        want = target[:, None, :] * mask[:, :, None]
        w = weight[:, None, None]
        g_emit = flat.T @ ((want - state) * w).reshape(-1, 2) - 0.1 * emit
        same = (target[:, :, None] * target[:, None, :])[:, None] * inside
        g_move = ((same - pair) * w[..., None]).sum((0, 1)) - 1.0 * move
        g_first = ((want - state)[:, 0] * weight[:, None]).sum(0) - 1.0 * first
        for v, g, n in zip((emit, move, first), (g_emit, g_move, g_first), seen):
            n += g * g
            v += 0.3 * g / np.sqrt(n)
    return Crf(emit, move, first)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """From labelled documents (labels' doc_id and quality, docs' doc_id and text); rows with a null id, label or text don't count, and of rows with one doc_id the first by label and text does."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select("doc_id").where("text IS NOT NULL AND doc_id IS NOT NULL").distinct()
    drawn = stored(labels.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "drawn")
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The lines' features as bits: texts stay where they are."""
        x, doc, _ = line_features(batch.column("text").to_pylist())
        own = np.split(x.astype(np.uint8), np.searchsorted(doc, np.arange(1, batch.num_rows))) if batch.num_rows else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([np.packbits(f, axis=1).tobytes() for f in own], pa.binary())], names=["doc_id", "quality", "x"])

    found = sorted(map_slices(rows, lines, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x binary").collect())
    width = -(-FEATURES // 8)
    own = [np.unpackbits(np.frombuffer(bytes(r.x), np.uint8).reshape(-1, width), axis=1, count=FEATURES) for r in found]
    x = np.concatenate(own).astype(np.float64) if own else np.zeros((0, FEATURES))
    return train(x, np.repeat(np.arange(len(own)), [len(f) for f in own]), [int(r.quality == 1) for r in found])


def quality(docs: DataFrame, model: Crf, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_lines, n_content, content_share, keep) for every row of docs.

    content_share is by bytes. Repeated rows and null ids give a row each; other columns are
    ignored whatever their names. A null or empty text, or one of empty lines alone, has no
    content to lose: share 0, not kept. Whole texts of any length are decoded. An empty table
    gives an empty one. Of equally good label sequences content wins at the last line that differs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        x, doc, size = line_features(texts)
        label = shared.value.viterbi(x, doc) if len(x) else np.zeros(0, np.int8)
        n = len(texts)
        lines, content = np.bincount(doc, minlength=n), np.bincount(doc, label, n).astype(np.int64)
        total = np.bincount(doc, size, n)
        share = np.bincount(doc, size * label, n) / np.maximum(total, 1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(content, pa.int64()), pa.array(share, pa.float64()), pa.array((share >= least_share) & (total > 0), pa.bool_())], names=["doc_id", "n_lines", "n_content", "content_share", "keep"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines bigint, n_content bigint, content_share double, keep boolean")
