import os
from collections import Counter

import pytest
from oracle import DATA, same, views
from pyspark.sql import functions as F
from test_operators import brute_mix, plain_bpe

import __spark_entry__
import corpus_pipeline
from textquarry.llm import bpe, mixing, near_dups, pii, queries


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, DATA), queries.oracle_sql()[name], views())


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stage_by_stage(spark, rows, labels, folder, extra=()):
    """Runs each stage on what the one before wrote, as run() does, and yields (name, what it got, what it gave)."""
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra:
        docs = docs.withColumn(name, F.lit(value))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        out.write.parquet(f"{folder}/{name}")
        yield name, docs, spark.read.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")


def pairs_in_one_group(texts):
    """Ids to keep by comparing all pairs."""
    ids, root = sorted(texts), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and near_dups.similar(near_dups.words_of(texts[i]), near_dups.words_of(texts[j])) is not None:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in ids if top(i) == i}


def corpus():
    clean = [" ".join(f"{w}{i}x{j}" for j, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split() * 3)) for i in range(40)]
    toxic = [f"{clean[i][:60]} vile scum filth hate vile scum filth hate rotten" for i in range(20)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)] + [(100 + i, t, "en", "s0", len(t)) for i, t in enumerate(toxic)]
    near = clean[3] + " one more word"
    mail = "write to jane.doe42@mail.example.com or stay away from all of this today please " + clean[0][::-1]
    rows += [(200, near, "en", "s1", len(near)), (201, clean[4], "en", "s1", len(clean[4])), (202, mail, "en", "s1", len(mail))]
    return rows, [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 1) for i in range(0, 20, 2)]


def test_pipeline_stage_by_stage(spark, tmp_path, monkeypatch):
    """Each stage's rows against brute force on its own input."""
    monkeypatch.setattr(mixing, "CHUNK", 8)
    vocabulary, weights = bpe.Vocabulary.load(), pii.model()
    rows, labels = corpus()
    for name, got, gave in stage_by_stage(spark, rows, labels, tmp_path):
        before, after = got.collect(), gave.collect()
        if name == "toxicity":
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - set(range(100, 120)) and set(after) <= set(before)
        elif name == "near_duplicates":
            assert {r.doc_id for r in after} == pairs_in_one_group({r.doc_id: r.text for r in before}) == set(range(40)) | {202} and set(after) <= set(before)
        elif name == "pii":
            want = {r.doc_id: r.text for r in before}
            for i, t in want.items():
                for a, b, kind, _ in reversed(pii.best(t, weights)):
                    want[i] = f"{want[i][:a]}[{kind}]{want[i][b:]}"
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {i: (t, len(t)) for i, t in want.items()} and "[EMAIL]" in want[202]
        elif name == "mixing":
            want = brute_mix(spark, got, vocabulary, mixing.BLOCK, mixing.SHARD)
            texts = {r.doc_id: r.text for r in before}
            # blocks are larger than any chunk here, so a part is a whole document
            assert Counter((r.source, r.doc_id, r.text) for r in after) == Counter((s, i, texts[i]) for s, _, _, _, ids in want.values() for i in ids)
            assert all(r.n_chars == len(r.text) and r.lang == "en" for r in after)
        else:
            assert Counter((r.doc_id, tuple(r.tokens)) for r in after) == Counter((r.doc_id, tuple(plain_bpe(vocabulary, r.text))) for r in before)
            assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in after)
        if name != "bpe":
            assert gave.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_runs_its_stages(spark, tmp_path):
    rows, labels = corpus()
    *_, (_, _, last) = stage_by_stage(spark, rows, labels, tmp_path)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, last.collect()))


def test_pipeline_odd(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    clean = corpus()[0][:30]
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = clean + [(None, clean[0][1] + " with a null id and more words than the other has", "en", "s0", 9), (50, None, "en", "s0", None), (51, "", None, None, 0), (52, "   ", "en", "s0", 3)]
    rows += [(53, "lonely words of their own without any source", None, None, None), (54, long, "en", "s1", len(long)), (5, *clean[5][1:]), (55, "!!! ... !!!", "en", "s1", 11), (56, "wörter ünd 漢字 🙂", "de", "s2", 15)]
    labels = [(0, 1, 0), (1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 1)]
    seen = {}
    for name, got, gave in stage_by_stage(spark, rows, labels, tmp_path, (("score", 1.0), ("toxic", True), ("key", "k"), ("block", 1), ("tokens", "t"), ("dropped", True))):
        seen[name] = gave.collect()
    ids = {name: Counter(r.doc_id for r in own) for name, own in seen.items()}
    everything = Counter(r[0] for r in rows)
    assert ids["toxicity"] == everything  # of one label alone nothing is learned
    assert ids["near_duplicates"] == ids["pii"] == everything - Counter([5])
    assert set(ids["mixing"]) <= set(everything) - {50, 51} and sum(len(r.text) for r in seen["mixing"]) > 0
    assert ids["bpe"] == ids["mixing"] and all(r.round_trip for r in seen["bpe"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    for _, _, gave in stage_by_stage(spark, [], [], tmp_path):
        assert gave.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
