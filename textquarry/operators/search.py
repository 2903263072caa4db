"""Line search with context, counts, distinct files and BM25.

Nothing but the corpus statistics of BM25 (one row, from one aggregation) and a requested order
is shuffled: whole texts are ruled out before lines are cut, and context comes from the array of
a document's lines rather than from a window. Arrays are exploded as outer ones, since the inner
kind makes the optimizer compute each array twice, first to see whether it is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.functions.patterns import Matcher, simple_glob, word
from textquarry.functions.scoring import bm25, bm25_tf
from textquarry.functions.text import lines
from textquarry.storage import small_batches


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. bm25: off, tf or full. root: only paths at or under it. include: glob of file names, applied last. strict: ^ and $ of a text's prefilter hold at its ends alone and context is as wide on both sides."""

    patterns: tuple[str, ...]
    regex: bool = True
    ignore_case: bool = False
    word: bool = False
    before: int = 0
    after: int = 0
    max_results: int | None = None
    max_count: int | None = None
    smart_case: bool = False
    bm25: str = "off"
    root: str | None = None
    include: str | None = None
    strict: bool = False

    @property
    def matcher(self) -> Matcher:
        own, regex = self.patterns, self.regex
        if self.word:
            own, regex = tuple(word(p, not self.regex) for p in own), True
        ignore_case = self.ignore_case or self.smart_case and not any(c.isupper() for p in own for c in p)
        return Matcher(own, regex, ignore_case)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path.cast("string"), "/"), -1)


def statistics(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """One row: n_docs, avg_size (1 without documents), df (documents that hold a match, inside the root)."""
    docs = corpus.docs
    hit = docs.text.isNotNull() & (docs.text != "") & spec.matcher.in_text(docs.text, spec.strict)
    if spec.root is not None:
        hit &= under(docs.path, spec.root)
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("size"), F.lit(1.0)).alias("avg_size"), F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("df"))


def under(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path.cast("string") == root) | path.cast("string").startswith(root + "/")


def matched_docs(corpus: Corpus, spec: SearchSpec, columns: tuple[str, ...] = (), stats: DataFrame | None = None) -> DataFrame:
    """Documents that hold a match: path, text, bm25_score (null where off) and the columns named, tf and doc_len among them."""
    m, docs = spec.matcher, corpus.docs
    if spec.root is not None:
        docs = docs.where(under(docs.path, spec.root))
    docs = docs.where(docs.text.isNotNull() & (docs.text != ""))
    if not corpus.single_file:
        docs = docs.where(m.in_text(docs.text, spec.strict))
    docs = docs.withColumns({"tf": m.count(docs.text, spec.strict), "doc_len": F.octet_length("text").cast("bigint")})
    if spec.bm25 == "off":
        score = F.lit(None).cast("double")
    elif corpus.single_file:
        score = bm25_tf(F.col("tf"), F.col("doc_len"), F.col("doc_len"))
    else:
        docs = docs.crossJoin(F.broadcast(statistics(corpus, spec) if stats is None else stats))
        tf, length, average = F.col("tf"), F.col("doc_len"), F.col("avg_size")
        score = bm25_tf(tf, length, average) if spec.bm25 == "tf" else bm25(tf, length, average, F.col("n_docs"), F.col("df"))
    return docs.select("path", "text", score.alias("bm25_score"), *columns)


def search(corpus: Corpus, spec: SearchSpec, stats: DataFrame | None = None) -> DataFrame:
    """A row for each matching line: path, line_number, line_content, context_before, context_after, bm25_score (of the document)."""
    m = spec.matcher
    before, after = (max(spec.before, spec.after),) * 2 if spec.strict else (spec.before, spec.after)
    docs = matched_docs(corpus, spec, stats=stats).select("path", "bm25_score", lines(F.col("text")).alias("lines"))
    if spec.max_count is not None:
        numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line")))
        hits = docs.select("*", F.explode(F.slice(F.filter(numbered, lambda s: m.matches(s["line"])), 1, spec.max_count)).alias("h")).select("path", "bm25_score", "lines", F.col("h.i").alias("i"), F.col("h.line").alias("line_content"))
    else:
        hits = docs.select("path", "bm25_score", "lines", F.posexplode_outer("lines").alias("i", "line_content")).where(m.matches(F.col("line_content")))
    none = F.array().cast("array<string>")
    i = F.col("i")
    ahead = F.slice("lines", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))) if before else none
    behind = F.slice("lines", i + 2, F.lit(after)) if after else none
    found = hits.select("path", (i + 1).cast("bigint").alias("line_number"), "line_content", ahead.alias("context_before"), behind.alias("context_after"), "bm25_score")
    if spec.include is not None and not corpus.single_file:
        found = found.where(simple_glob(name_of(F.col("path")), spec.include))
    if spec.max_results is not None:
        found = found.orderBy("path", "line_number").limit(spec.max_results)
    return found


def counts(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """(path, n): matching lines of each document that has any. No shuffle: a document is one row."""
    m = spec.matcher
    found = matched_docs(corpus, spec).select("path", F.size(F.filter(lines(F.col("text")), m.matches)).cast("bigint").alias("n")).where("n > 0")
    return found if spec.include is None else found.where(simple_glob(name_of(F.col("path")), spec.include))


def paths_with_matches(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """(path) of each document with a matching line."""
    m = spec.matcher
    found = matched_docs(corpus, spec).where(F.exists(lines(F.col("text")), m.matches)).select("path")
    return found if spec.include is None else found.where(simple_glob(name_of(F.col("path")), spec.include))


def occurrences(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """(path, n): matches, rather than matching lines, of each document that has any."""
    return matched_docs(corpus, spec, ("tf",)).select("path", F.col("tf").alias("n"))


def grouped(corpus: Corpus, spec: SearchSpec, most: int = 5) -> DataFrame:
    """(path, bm25_score, n_lines, lines): each document with a matching line, how many it has, and its first ones as (line_number, line_content). No shuffle: a document is one row."""
    m = spec.matcher
    numbered = F.transform(lines(F.col("text")), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_number"), x.alias("line_content")))
    found = matched_docs(corpus, spec).select("path", "bm25_score", F.filter(numbered, lambda s: m.matches(s["line_content"])).alias("all"))
    found = found.select("path", "bm25_score", F.size("all").cast("bigint").alias("n_lines"), F.slice("all", 1, most).alias("lines")).where("n_lines > 0")
    return found if spec.include is None else found.where(simple_glob(name_of(F.col("path")), spec.include))


def ranked(corpus: Corpus, spec: SearchSpec, top: int) -> DataFrame:
    """(path, bm25_score) of the best documents, best first, of equal ones the least path."""
    return matched_docs(corpus, spec).select("path", "bm25_score").orderBy(F.desc("bm25_score"), "path").limit(top)


def spans(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """(path, offset, pattern_index, length) of all matches in the documents' texts, in bytes."""
    docs = corpus.docs.where(F.col("text").isNotNull() & spec.matcher.in_text(F.col("text"), spec.strict))
    small_batches(docs.sparkSession)
    return docs.select("path", F.explode(spec.matcher.spans(F.col("text"))).alias("s")).select("path", "s.*")


def union(results: list[DataFrame]) -> DataFrame:
    """Results of several roots one after another; what both find stays twice."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def numbered(corpus: Corpus) -> DataFrame:
    """(path, line_number, line): every line of the documents, as a numbered read shows them: five spaces, the number, a tab, the line."""
    return corpus.docs.where("text <> ''").select("path", F.posexplode_outer(lines(F.col("text"))).alias("i", "x")).select("path", (F.col("i") + 1).cast("bigint").alias("line_number"), F.concat(F.lit("     "), (F.col("i") + 1).cast("string"), F.lit("\t"), F.col("x")).alias("line"))
