import numpy as np
import pytest

from textquarry.corpus import Corpus
from textquarry.operators import lsa, search, terms
from textquarry.operators.projection import RandomProjection, fnv1a
from textquarry.plans import render
from textquarry.streaming.search import search_stream

DOCS = ["user login authentication password check", "authentication token and password reset for login", "session token of the user login page", "matrix vector multiplication of linear algebra", "eigenvalue of a matrix in linear algebra", "vector space and matrix rank theory"]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_table(spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)] + [(90, ""), (91, None)], "doc_id int, text string"))


def reference(query: str, k: int):
    words = sorted({w for d in DOCS for w in d.split()})
    a = np.array([[d.split().count(w) for d in DOCS] for w in words], float)
    a *= np.log(len(DOCS) / (a > 0).sum(1))[:, None]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    u, s, v = u[:, :k], s[:k], vt[:k].T
    q = np.array([query.split().count(w) for w in words], float) * np.log(len(DOCS) / np.array([sum(w in d.split() for d in DOCS) for w in words]))
    q = u.T @ q / s
    return v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)


@pytest.mark.parametrize("gram, k", [(1500, 6), (1500, 3), (0, 3)])
def test_rank_equals_numpy(spark, corpus, monkeypatch, gram, k):
    monkeypatch.setattr(lsa, "GRAM_DOCS", gram)
    model = lsa.LsaModel.fit(corpus, k)
    got = {r.path: r.score for r in model.rank("password login matrix").collect()}
    assert [got[i] for i in range(6)] == pytest.approx(reference("password login matrix", k).tolist(), abs=1e-6)


def test_folding_in_ranks_every_document(spark, corpus):
    got = {r.path: r.score for r in lsa.LsaModel.fit(corpus, 3, fit_docs=4).rank("matrix algebra").collect()}
    assert sorted(got) == list(range(6))


def test_folded_document_without_a_fitted_term_has_score_zero(spark):
    docs = [(i, f"common{i % 3} shared{i % 2}") for i in range(8)] + [(8 + i, f"own{i}") for i in range(8)]
    corpus = Corpus.from_table(spark.createDataFrame(docs, "doc_id int, text string"))
    got = {r.path: r.score for r in lsa.LsaModel.fit(corpus, 2, fit_docs=6).rank("common1 shared1").collect()}
    assert sorted(got) == list(range(16)) and sum(s == 0 for s in got.values()) >= 2


def test_every_document_of_a_large_corpus_is_fitted(spark):
    n = 20_400
    docs = [(i, f"own{i}" if i % 2 else "big" if i % 3 else "mid" if i % 5 else "small") for i in range(n)]
    corpus = Corpus.from_table(spark.createDataFrame(docs, "doc_id int, text string"))
    model = lsa.LsaModel.fit(corpus, 2)
    assert model.v.shape == (n, 2) and model.doc_vectors.select("path").distinct().count() == n
    assert model.terms.count() == n // 2 + 3
    score = {r.path: r.score for r in model.rank("big").collect()}
    assert len(score) == n and score[2] == pytest.approx(1, abs=1e-9)


def test_iterated_vectors_equal_the_exact_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.minimum(rng.zipf(1.25, (2500, 40)), 6000)
    corpus = Corpus.from_table(spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words)], "doc_id int, text string"))
    got = []
    for gram in (3000, 1500):
        monkeypatch.setattr(lsa, "GRAM_DOCS", gram)
        model = lsa.LsaModel.fit(corpus)
        got.append((model.v, model.sigma, {r.path: r.score for r in model.rank("w3 w17 w40").collect()}))
    (v, sigma, exact), (u, other, scores) = got
    assert other == pytest.approx(sigma, rel=1e-7) and np.linalg.norm(v.T @ u) ** 2 == pytest.approx(128, abs=1e-6)
    assert max(abs(exact[i] - scores[i]) for i in exact) < 1e-4


def test_fit_that_does_not_converge_raises(spark, corpus, monkeypatch):
    monkeypatch.setattr(lsa, "GRAM_DOCS", 0)
    monkeypatch.setattr(lsa, "WIDTH", 1)
    monkeypatch.setattr(lsa, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="not converged"):
        lsa.LsaModel.fit(corpus, 3)


def test_slices_of_columns_give_the_same_terms(spark, corpus, monkeypatch):
    model = lsa.LsaModel.fit(corpus, 3)
    whole = {r.term: r.vec for r in model.term_vectors().collect()}
    monkeypatch.setattr(lsa, "SLICE_BYTES", 8 * len(DOCS))
    assert {r.term: r.vec for r in model.term_vectors().collect()} == {t: pytest.approx(v, abs=1e-12) for t, v in whole.items()}


def test_save_and_load(spark, corpus, tmp_path):
    model = lsa.LsaModel.fit(corpus, 3)
    model.save(str(tmp_path / "m"))
    score = lambda m: {r.path: round(r.score, 9) for r in m.rank("matrix").collect()}
    assert score(lsa.LsaModel.load(spark, str(tmp_path / "m"))) == score(model)


def test_semantic_search(spark, corpus):
    rows = lsa.semantic_search(corpus, "password authentication").collect()
    assert rows[0].path in (0, 1) and rows[0].rank == 1 and rows[0].line_content == DOCS[rows[0].path]
    assert "ranked by semantic relevance" in render.semantic_text(rows)
    alone = Corpus.from_table(spark.createDataFrame([(1, "one document alone")], "doc_id int, text string"))
    assert lsa.semantic_search(alone, "document").count() == 0
    assert lsa.semantic_search(Corpus(corpus.docs.limit(0)), "x").count() == 0


def test_tfidf_leaves_out_terms_of_all_documents(spark):
    rows = terms.tfidf(Corpus.from_table(spark.createDataFrame([(1, "a b b"), (2, "a c")], "doc_id int, text string"))).collect()
    assert {(r.path, r.term): r.weight for r in rows} == {(1, "b"): pytest.approx(2 * np.log(2)), (2, "c"): pytest.approx(np.log(2))}


def test_random_projection(spark, corpus):
    assert fnv1a("a") == 0xAF63DC4C8601EC8C
    rp = RandomProjection()
    got = {r.path: r.score for r in rp.score(corpus, "user login password").collect()}
    assert got[0] > 0.4 > max(got[3], got[4], got[5]) and got[90] == 0 and 91 not in got
    again = {r.path: r.score for r in RandomProjection().score(Corpus(corpus.docs.repartition(5)), "user login password").collect()}
    assert again == got
    rows = np.stack([rp.row(f"w{i}") for i in range(300)])
    assert np.var(rows) == pytest.approx(1 / 256, rel=0.05)


@pytest.fixture(scope="module")
def texts(spark):
    return Corpus.from_table(spark.createDataFrame([("d/a.rs", "one\ntwo hit\nthree\nfour hit\n"), ("d/b.md", "hit hit\r\nno"), ("e/c.rs", "none"), ("e/d.rs", ""), ("e/e.rs", None)], "doc_id string, text string"))


def test_search_context_and_bm25_metamorphic(spark, texts):
    spec = search.SearchSpec(("hit",), before=1, after=1)
    plain = search.search(texts, spec).orderBy("path", "line_number").collect()
    assert [(r.path, r.line_number, r.context_before, r.context_after) for r in plain] == [("d/a.rs", 2, ["one"], ["three"]), ("d/a.rs", 4, ["three"], []), ("d/b.md", 1, [], ["no"])]
    for mode in ("tf", "full"):
        scored = search.search(texts, search.SearchSpec(("hit",), bm25=mode)).collect()
        assert {(r.path, r.line_number) for r in scored} == {(r.path, r.line_number) for r in plain} and all(r.bm25_score > 0 for r in scored)
    n = {r.path: r.n for r in search.counts(texts, spec).collect()}
    assert sum(n.values()) == len(plain) and {r.path for r in search.paths_with_matches(texts, spec).collect()} == set(n)
    assert {r.path: r.n for r in search.occurrences(texts, spec).collect()} == {"d/a.rs": 2, "d/b.md": 2}


def test_search_options(spark, texts):
    paths = lambda **kw: sorted(r.path for r in search.search(texts, search.SearchSpec(**kw)).collect())
    assert paths(patterns=("hit",), include="*.md") == ["d/b.md"] and paths(patterns=("n",), root="e") == ["e/c.rs"]
    assert paths(patterns=("^two",)) == ["d/a.rs"] and paths(patterns=("^two",), strict=True) == [] and paths(patterns=("hit$",)) == ["d/a.rs"] * 2 + ["d/b.md"]
    assert paths(patterns=("HIT",), smart_case=True) == [] and len(paths(patterns=("hit",), max_results=1)) == 1 and len(paths(patterns=("hit",), max_count=1)) == 2
    strict = search.search(texts, search.SearchSpec(("two",), before=1, strict=True)).first()
    assert (strict.context_before, strict.context_after) == (["one"], ["three"])


def test_matches_survive_repartition(spark, texts):
    spec = search.SearchSpec(("hit",), bm25="full")
    rows = lambda c: sorted(map(str, search.search(c, spec).collect()))
    assert rows(texts) == rows(Corpus(texts.docs.repartition(7)))


def test_prefilter_is_before_the_explode(spark, texts):
    plan = search.search(texts, search.SearchSpec(("hit",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" in plan or "Contains" in plan


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a hit\nb"), (2, "none")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    fixed = spark.createDataFrame([(10, 20.0, 3)], "n_docs bigint, avg_size double, df bigint")
    out = search_stream(source, search.SearchSpec(("hit",), bm25="tf"), stats=fixed)
    q = out.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM hits").collect()
    assert len(row) == 1 and row[0].line_content == "a hit" and row[0].bm25_score > 0
    with pytest.raises(ValueError):
        search_stream(source, search.SearchSpec(("hit",), bm25="full"))
