"""What must not grow with the input: shuffles, batches, calls."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.functions import text as words
from textquarry.functions.patterns import Matcher
from textquarry.operators import projection, terms
from textquarry.operators.terms import postings, tfidf
from textquarry.sources import filetree

ODD = ["getUserName parseHTMLDocument", "The the THE tHe", "a b c​d\x1ce\x1ff", "ÉtéÉTÉÑandÚ ßtraße ÀB", "𝐀𝐁c x𝐀 İstanbul ΑΣ ΑΣ'ΑΣ", "", "...", "_a_B__cD9Ef", "日本語Text", "A", "ABc", "aB\r\ncD\x0b\x85eF"]


def test_token_counts_equal_tokens(spark):
    # not upper case beyond U+FFFF before upper case: Java's look-behind sees half of such a character
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice("aBcDéÉ ._ßΣ1\n") for _ in range(40)) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words.tokens(F.col("t")).alias("w")).collect()
    for r in rows:
        want: dict = {}
        for w in r.w:
            want[w] = want.get(w, 0) + 1
        assert words.token_counts(r.t) == want, r.t


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_distinct_paths_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b C"), (3, None), (4, "")], "doc_id bigint, text string")
    post = postings(Corpus.from_table(docs))
    assert "Exchange" not in _plan(post)
    assert {tuple(r) for r in post.collect()} == {(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)}
    assert "MapInArrow" not in _plan(tfidf(Corpus.from_table(docs)))  # terms are counted once, not for each side of the join


def test_postings_of_equal_paths_are_added_up(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b C")], "doc_id bigint, text string")
    assert {tuple(r) for r in postings(Corpus.from_table(docs)).collect()} == {(1, "a", 2), (1, "b", 2), (1, "c", 1)}


def test_postings_are_passed_on_in_runs(monkeypatch):
    monkeypatch.setattr(terms, "POSTINGS", 10)
    batch = pa.RecordBatch.from_pydict({"path": list(range(9)), "text": [" ".join(f"w{j}" for j in range(7))] * 9})
    assert [b.num_rows for b in terms._counted([batch])] == [14, 14, 14, 14, 7]


def test_rules_are_only_kept_where_there_are_some(tmp_path):
    """Each level without ignore files cost a look at every entry."""
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "x.txt").write_text("x")
    assert filetree._inner(str(deep), None) is None
    (tmp_path / ".gitignore").write_text("/a/b/c/y*\n")
    (deep / "y.txt").write_text("y")
    names = {os.path.basename(r[1]) for r in filetree.walk(str(tmp_path))}
    assert names == {".gitignore", "a", "b", "c", "x.txt"}


def test_spans_make_no_object_for_each_match(spark, monkeypatch):
    """A struct for each match was a Python dict."""
    docs = spark.createDataFrame([("the one the two",), (None,), ("none",), ("äthe",)], "t string")
    got = [r.s for r in docs.select(Matcher(("the",), False).spans(F.col("t")).alias("s")).collect()]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[(0, 0, 3), (8, 0, 3)], None, [], [(2, 0, 3)]]


@pytest.mark.parametrize("most", [None, 4 * 16 * 3])
def test_hashes_and_rows_in_bulk(monkeypatch, most):
    if most:
        monkeypatch.setattr(projection, "ROWS_BYTES", most)
    monkeypatch.setattr(projection, "_kept", {})
    own = ["", "a", "größe", "日本" * 30, "x" * 100, *(f"w{i}" for i in range(50))]
    assert projection.hashed(pa.array(own).slice(1)).tolist() == [projection.fnv1a(w) for w in own[1:]]
    p = projection.RandomProjection(16, 1000, 7)
    for some in (own[:5], own, own[3:20]):
        assert np.array_equal(p.rows(some), p._made(np.array([projection.fnv1a(w) % 1000 for w in some])))
