"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.llm import bpe, common, licenses, mixing, near_dups, neighbours, pii, quality, repeats, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone cloud paper engine garden window silver market letter bridge summer winter copper forest island music".split()


def frame(spark, texts, source="s", extra=False):
    rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    # names that operators use inside
    return df.selectExpr("*", "1 AS words", "'x' AS key", "2 AS block", "'y' AS tokens", "0.5 AS score", "true AS toxic", "1 AS n", "'z' AS dropped", "1 AS shard") if extra else df


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 300)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   "), (None, text(1, 30)), (5, text(2, 30)), (5, text(2, 30)), (6, "!!! ..."), (7, "wörter ünd 漢字 🙂")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD + [(8, text(3, 20_000))], extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], extra=True)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load()


# --- 1 mixing ---


def brute_mix(spark, docs, vocabulary, block, shard, alpha=mixing.ALPHA, seed=mixing.SEED):
    """{(shard, slot): (source, epoch, block, doc ids, tokens)}, one row after another."""
    rows = docs.where("length(text) > 0")
    chunks = max(1, -(-rows.count() // mixing.CHUNK))
    streams = defaultdict(list)
    for r in rows.selectExpr("source", f"pmod(xxhash64(doc_id, text), {chunks}) AS chunk", "doc_id", "text").collect():
        streams["" if r.source is None else "=" + r.source, r.chunk].append((r.doc_id is not None, r.doc_id or 0, r.text, r.doc_id))
    packed = defaultdict(list)
    for key in sorted(streams):
        tokens = [((n, i), t) for n, (*_, text_, i) in enumerate(sorted(streams[key])) for t in plain_bpe(vocabulary, text_)]
        for a in range(0, len(tokens), block):
            own = tokens[a : a + block]
            packed[key[0]].append(own)
    names = sorted(packed)
    weights = [int(np.floor(1000 * len(packed[s]) ** alpha)) for s in names]
    drawn, out = Counter(), {}
    for i in range(sum(map(len, packed.values()))):
        u = int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:12], 16) % sum(weights)
        s = next(s for s, w in zip(names, np.cumsum(weights)) if u < w)
        m, n = drawn[s], len(packed[s])
        drawn[s] += 1
        b = int(mixing.permuted(s, m // n, np.array([m % n]), n, seed)[0])
        out[i // shard, i % shard] = (s[1:] or None, m // n, b, [t for _, t in packed[s][b]], [i for (_, i), _ in groupby(packed[s][b], key=lambda x: x[0])])
    return out


def test_mixing_against_brute_force(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 25)  # several chunks
    monkeypatch.setattr(mixing, "SHARDS", 3)
    docs = frame(spark, [(i, text(i, 37)) for i in range(60)], "a").union(frame(spark, [(100 + i, text(i, 11)) for i in range(20)], "b")).union(frame(spark, [(200 + i, text(i, 9)) for i in range(9)], None))
    rows = mixing.mix(docs, vocabulary, block=32, shard=8).collect()
    want = brute_mix(spark, docs, vocabulary, 32, 8)
    assert {(r.shard, r.slot): (r.source, r.epoch, r.block, r.tokens, r.doc_ids) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_tokens == len(r.tokens) for r in rows) and max(r.n_tokens for r in rows) == 32
    # as documents: the same blocks, part by part
    parts = Counter((r.source, r.doc_id, r.text) for r in mixing.mixed_documents(docs, vocabulary, block=32, shard=8).collect())
    assert Counter((r.source, i) for r in rows for i in r.doc_ids) == sum((Counter({k[:2]: n}) for k, n in parts.items()), Counter())
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(t in texts[i] for _, i, t in parts)


def test_parts_of_documents_are_cut_at_characters(spark, vocabulary):
    t = "漢字🙂 wörter ünd 漢字🙂🙂 " * 30
    packed = mixing.blocks(frame(spark, [(1, t)]), vocabulary, 7, ("lang",), texts=True).collect()
    assert "".join(p.text for r in sorted(packed, key=lambda r: r.number) for p in r.parts) == t
    assert [r.n_tokens for r in sorted(packed, key=lambda r: r.number)][:-1] == [7] * (len(packed) - 1)


WHITE = ["", " ", "  ", "\n\n", " \n", "\t ", "\x1c", "\x1c ", "\x85", "\u3000 ", "\xa0\u2028"]


@given(st.lists(st.tuples(st.sampled_from(WHITE), st.one_of(st.text(max_size=6), st.sampled_from(["it's", "a12", mixing.NEVER, "漢字", "..."]))), max_size=8), st.sampled_from(WHITE))
@settings(max_examples=300, deadline=None)
def test_mixing_encodes_as_plain_merges(words, end):
    t = "".join(map("".join, words)) + end
    assert mixing_ids()(t).tolist() == plain_bpe(encoder()[0], t)


@cache
def mixing_ids():
    return mixing.token_ids(encoder()[0])


def test_mixing_encodes_in_less_time_than_tiktoken_alone():
    v = encoder()[0]
    alone, texts = tiktoken.Encoding("alone", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={}), [text(i, 400) for i in range(100)]

    def seconds(encode):
        begun = time.thread_time()
        for t in texts:
            encode(t)
        return time.thread_time() - begun

    # in turns, as the machine's speed varies
    runs = [(seconds(mixing_ids()), seconds(lambda t: alone.encode_to_numpy(t, disallowed_special=()))) for _ in range(9)]
    assert min(a for a, _ in runs) < 0.75 * min(b for _, b in runs)


def test_mixing_draws_by_target_weights(spark):
    rows = mixing.slots(spark.createDataFrame([("a", 4000), ("b", 500), ("c", 60)], "stream string, blocks bigint")).collect()
    n, whole = Counter(r.stream for r in rows), 4000**0.7 + 500**0.7 + 60**0.7
    assert len(rows) == 4560 and all(abs(n[s] - 4560 * b**0.7 / whole) < 5 * np.sqrt(n[s]) for s, b in (("a", 4000), ("b", 500), ("c", 60)))
    for (s, epoch), k in Counter((r.stream, r.epoch) for r in rows).items():
        assert len({r.block for r in rows if (r.stream, r.epoch) == (s, epoch)}) == k


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted("x", 3, np.arange(n), n)) == list(range(n))


def test_mixing_odd(spark, odd, empty, vocabulary):
    """Null and empty texts take no part; ties, repeated rows and null ids and sources do."""
    rows = mixing.mix(odd, vocabulary, block=64).collect()
    assert {i for r in rows for i in r.doc_ids} <= {None, 3, 5, 6, 7, 8} and rows
    assert {(r.shard, r.slot): (r.source, r.epoch, r.block, r.tokens, r.doc_ids) for r in rows} == brute_mix(spark, odd, vocabulary, 64, mixing.SHARD)
    assert mixing.mix(empty, vocabulary).count() == 0 and mixing.mixed_documents(empty, vocabulary).count() == 0
    parts = mixing.mixed_documents(odd, vocabulary, block=64)
    assert parts.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in parts.collect()} <= {None, 3, 5, 6, 7, 8}


# --- 2 PII ---


def test_pii_on_held_out_sentences():
    weights = pii.model()
    right = found = wanted = 0
    for t, gold in pii._sentences(random.Random(99), 200):
        got = {(a, b, k) for a, b, k, _ in pii.entities(t, weights)}
        right, found, wanted = right + len(got & set(gold)), found + len(got), wanted + len(gold)
    assert right / found > 0.95 and right / wanted > 0.95


def test_decoding_is_the_best_segmentation():
    weights = pii.model()
    for t in ("call +1 (555) 123-4567 or 10.0.0.1, a@b.com", "4111 1111 1111 1111 123-45-6789", "v1.2.3 1999-2001"):
        spans = pii.atoms(t)
        scored = [(i, j, sum(weights.get(f, 0) for f in pii.features(t, spans[i][0], spans[j - 1][1], k))) for i, j, k in pii.candidates(t, spans)]
        best = [0.0] * (len(spans) + 1)
        for j in range(1, len(spans) + 1):
            best[j] = max([best[j - 1]] + [best[i] + s for i, e, s in scored if e == j])
        assert sum(s for *_, s in pii.best(t, weights)) == pytest.approx(best[-1])


def test_stretches_lose_nothing_of_the_whole_text():
    """Decoding near triggers against decoding the whole text, with words and marks of any length."""
    weights = pii.model()
    r = random.Random(5)
    parts = ["1", "22", "@", "a", "bc", ".", " ", "-", "+", "(", ")", "AKIA", "sk_live_", "_", "\n", "é", "4111", "123-45-6789", "x" * 300, "joe@mail.example.com", "0f" * 20]
    for _ in range(600):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert pii.entities(t, weights) == pii.best(t, weights)


def test_decoding_against_all_segmentations():
    """Every set of candidates that don't overlap, enumerated."""
    weights = pii.model()

    def value(chosen):
        return sum(s for *_, s in chosen)

    for t in ("a@b.com 1.2.3.4", "123-45-6789 x", "+1 (555) 123-4567", "10.0.0.1 2001", "1 2 3"):
        spans = pii.atoms(t)
        scored = [(i, j, k, sum(weights.get(f, 0.0) for f in pii.features(t, spans[i][0], spans[j - 1][1], k))) for i, j, k in pii.candidates(t, spans)]
        scored = [x for x in scored if x[3] > 0]  # others never help
        top = 0.0

        def grow(at, chosen):
            nonlocal top
            top = max(top, value(chosen))
            for x in scored:
                if x[0] >= at:
                    grow(x[1], [*chosen, x])

        grow(0, [])
        assert value(pii.best(t, weights)) == pytest.approx(top)


@pytest.mark.parametrize("n", [1, 200, 201, 401, 601, 5000])
def test_pii_in_words_of_any_length(spark, n):
    docs = frame(spark, [(1, "see 1" + "b" * n + " end"), (2, "mail " + "q" * n + "@mail.example.com now"), (3, "k" * n + "7" + "b" * n)])
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[2] == "mail [EMAIL] now"
    if n >= 200:
        assert (out[1], out[3]) == ("see [SECRET] end", "[SECRET]")


def test_pii_ties_and_repeated_rows(spark):
    t = "write to joe.smith@mail.example.com or 123-45-6789"
    rows = pii.find_pii(frame(spark, [(1, t), (1, t), (None, t)], extra=True)).collect()
    assert Counter((r.doc_id, r.kind) for r in rows) == {(1, "EMAIL"): 2, (1, "SSN"): 2, (None, "EMAIL"): 1, (None, "SSN"): 1}
    # of equal scores the type that is listed first wins: a weight for two types of one span
    kinds = ("SSN:bias", "PHONE:bias")
    assert [x[2] for x in pii.best("123-45-6789", dict.fromkeys(kinds, 1.0))] == ["PHONE"]
    # and no entity wins over one of score zero
    assert pii.best("123-45-6789", dict.fromkeys(kinds, 0.0)) == []


def test_pii_keys_of_letters_alone():
    weights = pii.model()
    for key in ("AKIA" + "BCDEFGHIJKLMNOPQ", "sk_live_" + "abcdefghijklmnopqrstuvwx"):
        assert [(a, b, k) for a, b, k, _ in pii.entities(f"api_key={key} rest", weights)] == [(8, 8 + len(key), "SECRET")]


def test_pii_odd(spark, odd, empty):
    assert pii.find_pii(odd).count() == 0 and pii.find_pii(empty).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    one = frame(spark, [(1, "x " * 30_000 + "mail joe.smith@mail.example.com now"), (2, "ssn 123-45-6789")])
    assert {(r.doc_id, r.kind) for r in pii.find_pii(one).collect()} == {(1, "EMAIL"), (2, "SSN")}
    assert {r.doc_id: r.n_chars for r in pii.redact(one).collect()}[2] == len("ssn [SSN]")


# --- 3 BPE ---


def plain_bpe(v, t):
    return [v.ranks[p] for w in regex.findall(v.pattern, t) for p in bpe.merge(w.encode(), v.ranks)]


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_plain_merges(t):
    v, e = encoder()
    assert np.frombuffer(e.encode([t])[0], np.int32).tolist() == plain_bpe(v, t)


@cache
def encoder():
    v = bpe.Vocabulary.load()
    return v, bpe.Encoder(v)


def test_bpe_odd(spark, odd, empty, vocabulary):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    out = bpe.encode(odd, vocabulary, keep=("doc_id", "text"))
    for r in out.collect():
        assert (r.tokens, r.n_tokens, r.round_trip) == ((None, None, None) if r.text is None else (other.encode_ordinary(r.text), len(other.encode_ordinary(r.text)), True))
    back = bpe.decode(out, vocabulary, keep=("doc_id",))
    assert Counter(r.text for r in back.collect()) == Counter(r.text for r in odd.collect())
    assert bpe.encode(empty, vocabulary).count() == 0


WHITE = " \t\n\r\v\f\x1c\x1d\x85\xa0\u2009\u3000"


@given(st.lists(st.sampled_from([*WHITE, " ", "a", "Ab", "1", ",", "é", "\0", "'s", "漢", "x" * 70]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_white_space_is_cut_as_the_pattern_does(t):
    v, e = encoder()
    want = plain_bpe(v, t)
    assert np.frombuffer(e.encode([t])[0], np.int32).tolist() == want
    for table in (pa.array([], pa.string()), np.zeros(0, np.uint8)), (pa.array(["a", "Ab"]), np.array([1, 1], np.uint8)):
        assert counter().of(pa.array([t, None, ""]), *table).tolist() == [len(want), 0, 0]


@cache
def counter():
    return token_counts._Counts(encoder()[0])


def test_tokens_replace_columns_of_their_names(spark, odd, vocabulary):
    out = bpe.encode(odd, vocabulary, keep=tuple(odd.columns))
    assert sorted(out.columns) == sorted({*odd.columns, "n_tokens", "round_trip"}) and dict(out.dtypes)["tokens"] == "array<int>"


def test_frequent_pre_tokens_are_those_of_all_documents(spark, vocabulary):
    texts = [text(i, 50) for i in range(30)] + ["first " + "only here " * 40]
    n = Counter(x for t in texts for x in bpe.chunks_of(t)[1:])
    want = [x for x, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:20]]
    found, sizes = token_counts.frequent(frame(spark, list(enumerate(texts))), vocabulary, 20)
    assert found.to_pylist() == want and sizes.tolist() == [len(plain_bpe(vocabulary, " " + x)) for x in want]
    assert len(token_counts.frequent(frame(spark, []), vocabulary)[0]) == 0


def test_generations_keep_what_is_asked_for():
    made = []
    known = common.Generations(4, 3)

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]

    assert known.find(["a", "b", "a"], make) == ["aa", "bb", "aa"] and sorted(made) == ["a", "b"]
    for other in ("cd", "ef", "gh", "ij"):
        assert known.find(["a", *other], make) == ["aa", *(x * 2 for x in other)]
    assert made.count("a") == 1 and len(known.young) + len(known.old) <= 8
    assert known.find(["long"], make) == known.find(["long"], make) == ["longlong"] and made.count("long") == 2


def test_worker_state_is_of_one_operator():
    a, b = object(), object()
    first = common.worker_state("x", (a,), list)
    assert common.worker_state("x", (a,), list) is first
    assert common.worker_state("x", (b,), list) is not first
    assert common.worker_state("y", (), dict) == {} and common.worker_state("x", (b,), list) is not first


# --- 9 token counts ---


def test_token_counts(spark, odd, empty, vocabulary):
    want = Counter((r.doc_id, r.n_tokens) for r in bpe.encode(odd, vocabulary).collect())
    for table in (None, (pa.array([], pa.string()), np.zeros(0, np.uint8)), (pa.array(["the", "of"]), np.array([1, 1], np.uint8))):
        assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd, vocabulary, table).collect()) == want
    assert token_counts.token_counts(empty, vocabulary).count() == 0


# --- 4 near duplicates ---


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(0, 14))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, most):
    d = levenshtein(a, b)
    assert near_dups.banded(a, b, most) == (d if d <= most else None)


def edited(t, seed, n):
    r, w = random.Random(seed), t.split()
    for _ in range(n):
        at = r.randrange(len(w))
        w[at : at + r.choice((0, 1, 1))] = [r.choice(WORDS)]
    return " ".join(w)


def test_near_duplicates_against_all_pairs(spark):
    base = [(i, text(i, 60 + i % 30)) for i in range(40)]
    copies = [(100 + i, edited(t, i, 1 + i % 6)) for i, t in base[:25]] + [(200 + i, t.upper() + " !") for i, t in base[:3]] + [(300 + i, " ".join(reversed(t.split()))) for i, t in base[:5]]
    docs = base + copies
    words = {i: near_dups.words_of(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in docs:
        for j, _ in docs:
            if i < j and 1 - levenshtein(words[i], words[j]) / max(len(words[i]), len(words[j])) >= near_dups.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in parent if root(i) != i}
    got = {r.doc_id: r.kept_doc_id for r in near_dups.near_duplicates(frame(spark, docs)).collect()}
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want)
    kept = near_dups.without_near_duplicates(frame(spark, docs))
    assert {r.doc_id for r in kept.collect()} == set(parent) - set(got)


def test_near_duplicates_of_short_texts_are_found_at_the_threshold(spark):
    r, pairs = random.Random(8), []
    for n in range(5, 30):
        for kind in range(12):
            w = [f"w{n}x{kind}x{i}" for i in range(n)]
            v, edits = list(w), n // 5
            for place, e in enumerate(sorted(r.sample(range(n), edits), reverse=True)):
                # substitutions alone, or insertions and deletions in turn, which keep the length
                if kind % 2 or edits < 2:
                    v[e] = f"new{n}x{kind}x{e}"
                elif place % 2:
                    v.insert(e, f"new{n}x{kind}x{e}")
                else:
                    del v[e]
            if near_dups.similar(w, v) is not None:
                pairs.append((w, v))
    docs = [(2 * i + j, " ".join(p[j])) for i, p in enumerate(pairs) for j in (0, 1)]
    got = {r.doc_id: r.kept_doc_id for r in near_dups.near_duplicates(frame(spark, docs)).collect()}
    assert len(pairs) > 250 and got == {2 * i + 1: 2 * i for i in range(len(pairs))}


def test_near_duplicates_odd(spark, odd, empty):
    assert near_dups.near_duplicates(odd).count() == 0
    out = near_dups.without_near_duplicates(odd)
    assert out.columns == odd.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert near_dups.near_duplicates(empty).count() == 0 and near_dups.without_near_duplicates(empty).count() == 0
    many = frame(spark, [(i, text(1, 40)) for i in range(500)])
    assert {(r.doc_id, r.kept_doc_id) for r in near_dups.near_duplicates(many).collect()} == {(i, 0) for i in range(1, 500)}


# --- 5 toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    bad = ["vile", "scum", "filth", "rotten"]
    texts = [(i, " ".join([r.choice(WORDS) for _ in range(25)] + ([r.choice(bad) for _ in range(6)] if i % 3 == 0 else []))) for i in range(150)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out_and_exact(spark, labelled):
    """Weights, neighbours and their order of every row against dense vectors made from the definition."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, model, keep=("doc_id", "text")).collect()
    assert {r.doc_id for r in rows if r.toxic} == {i for i in range(150) if i % 3 == 0}
    tf = {r.doc_id: Counter(regex.findall(r"[^\W_]+", r.text.lower())) for r in rows}
    known = sorted({t for i in range(90) for t in tf[i]})
    assert model.vocabulary == known
    held = [{i for i in range(90) if t in tf[i]} for t in known]
    weight = []
    for t, own in zip(known, held):
        a = sum(i % 3 == 0 for i in own)
        weight.append(np.log(150 / sum(t in x for x in tf.values())) * np.log2(2 + a / max(len(own) - a, 1)))
    assert np.allclose(weight, model.weight)

    def dense(i, without=False):
        v = np.array([(1 + np.log(tf[i][t])) * w if t in tf[i] and not (without and own == {i}) else 0.0 for t, w, own in zip(known, weight, held)])
        return v / (np.linalg.norm(v) or 1)

    examples = {i: dense(i) for i in range(90)}
    for r in rows:
        q = dense(r.doc_id, r.doc_id < 90)
        near = sorted((-round(float(q @ x), 9), i) for i, x in examples.items() if i != r.doc_id and round(float(q @ x), 9) > 0)[: toxicity.NEIGHBOURS]
        assert [e.example for e in r.evidence] == [i for _, i in near]
        assert np.allclose([e.similarity for e in r.evidence], [-s for s, _ in near], atol=2e-9)


def test_counts_of_terms(monkeypatch):
    """Against a plain count, with a table that is emptied again and again."""
    r = random.Random(2)
    vocabulary = sorted({w + str(i) for w in WORDS for i in range(40)} | {"wörter", "漢字", "i"})
    texts = [" ".join(r.choice((x, x.upper(), x + ",", f"({x})", f"{x}-{x}", "none", "漢字 Wörter")) for x in r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(60)] + [None, "", "  "]
    for known in (1, 50, 5000):
        monkeypatch.setattr(toxicity, "KNOWN", known)
        counts = toxicity.Counts(vocabulary)
        for a in range(0, len(texts), 9):
            own = texts[a : a + 9]
            at, term, n = counts(pa.array(own, pa.string()))
            for i, t in enumerate(own):
                want = Counter(w for w in regex.findall(r"[^\W_]+", (t or "").lower()) if w in set(vocabulary))
                assert {vocabulary[x]: y for x, y in zip(term[at[i] : at[i + 1]], n[at[i] : at[i + 1]])} == want


@pytest.mark.parametrize("block, head", [(4, 0), (4, 5), (64, 40), (1, 1000)])
def test_block_max_index_is_exact(block, head):
    rng = np.random.default_rng(block + head)
    n, terms, k = 90, 60, 7

    def vectors(count):
        rows = [np.sort(rng.choice(terms, rng.integers(0, 12), False, p=np.arange(terms, 0, -1) / (terms * (terms + 1) / 2))) for _ in range(count)]
        rows[1] = rows[2]  # ties
        at = np.cumsum([0, *map(len, rows)])
        w = [np.ones(len(r)) / np.sqrt(max(len(r), 1)) if rng.random() < 0.5 else (x := rng.random(len(r)) + 0.1) / np.linalg.norm(x) if len(r) else np.empty(0) for r in rows]
        w[1] = w[2]
        return at, np.concatenate(rows).astype(np.int64), np.concatenate(w)

    def dense(at, term, w):
        out = np.zeros((len(at) - 1, terms))
        for i in range(len(at) - 1):
            out[i, term[at[i] : at[i + 1]]] = w[at[i] : at[i + 1]]
        return out

    own, asked = vectors(n), vectors(40)
    ids = rng.permutation(1000)[:n]
    index = toxicity.Index(ids, np.zeros(n), *own, terms, k, block, head)
    without = [int(ids[i]) if i % 4 == 0 else None for i in range(40)]
    sims = np.round(dense(*asked) @ dense(*own).T, 9)
    for q, (near, cosines) in enumerate(index.nearest(*asked, without)):
        want = sorted((-s, int(i)) for s, i in zip(sims[q], ids) if s > 0 and i != without[q])[:k]
        got = list(zip((-cosines).tolist(), index.ids[near].tolist()))
        assert [i for _, i in got] == [i for _, i in want] or np.allclose(*(np.array(x)[:, 0] for x in (got, want)), atol=2e-9)
        assert np.allclose(-cosines, [s for s, _ in want], atol=2e-9)


def test_toxicity_odd(spark, labelled, odd, empty):
    docs, labels = labelled
    out = toxicity.toxicity(odd, toxicity.fit(docs, labels)).collect()
    assert len(out) == odd.count() and not any(r.toxic for r in out)
    assert toxicity.toxicity(empty, toxicity.fit(empty, labels)).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 1, 1)], labels.schema)
    assert toxicity.toxicity(odd, toxicity.fit(docs, nulls), keep=tuple(odd.columns), evidence=False).count() == odd.count()


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert x.tolist() == [0.1, 0.2, 0.4] and y.tolist() == [0, 0.5, 1]


# --- 6 repeats ---


def brute_repeats(docs, length):
    texts = defaultdict(list)
    for i, t in docs:
        if i is not None and t is not None:
            texts[i].append(t)
    texts = {i: min(t) for i, t in texts.items()}
    same = defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    once = {i for own in same.values() for i in own if i == min(own)}
    n, first = Counter(), {}
    for i in sorted(once):
        w = texts[i].split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            n[key] += 1
            first.setdefault(key, i)
    out = set()
    for i, t in texts.items():
        w = t.split()
        if len(same[t]) > 1:
            if len(w) >= length:
                out.add((i, 0, len(w)))
            continue
        at = [k for k in range(len(w) - length + 1) if n[tuple(w[k : k + length])] > 1]
        runs = []
        for k in at:
            if runs and k <= runs[-1][1]:
                runs[-1][1] = k + length
            else:
                runs.append([k, k + length])
        out |= {(i, a, b) for a, b in runs}
    return out


@pytest.mark.parametrize("length", [10, 50])
def test_repeats_against_brute_force(spark, length):
    shared = [text(900 + i, 20 + 25 * i) for i in range(4)]
    docs = [(i, " ".join([text(i, i % 40), shared[i % 4], text(50 + i, 13), shared[(i + 1) % 3] if i % 5 == 0 else "x"])) for i in range(40)]
    docs += [(60, docs[0][1]), (61, "a " * 200), (62, "b c " * 90 + "d"), (63, docs[1][1] + " tail"), (None, docs[2][1]), (64, None), (65, "")]
    got = repeats.repeats(frame(spark, docs, extra=True), length).collect()
    assert {(r.doc_id, r.first_word, r.last_word) for r in got} == brute_repeats(docs, length)
    texts = dict(docs)
    for r in got:
        assert texts[r.doc_id][r.start : r.end].split() == texts[r.doc_id].split()[r.first_word : r.last_word]


@given(st.lists(st.lists(st.sampled_from([*WHITE, "a", "b", "ab", "é", "漢", "🙂", "\0", "\u200b", "\xa1", "\u2010", "\u2030"]), max_size=12).map("".join) | st.none(), max_size=6), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_words_are_those_of_split(texts, skip):
    w = repeats.Words(pa.array(texts, pa.string())[skip:])
    texts = texts[skip:]
    flat = [x for t in texts for x in (t or "").split()]
    raw = w.raw.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.first, w.last)] == flat
    assert np.diff(w.starts).tolist() == [len((t or "").split()) for t in texts]
    of = {}
    for base in (repeats._BASE, repeats._OTHER):
        h = w.hashes(base).tolist()
        assert len({(x, y) for x, y in zip(flat, h)}) == len(set(flat)) == len(set(h))
    for d, t in enumerate(texts):
        at = w.chars(w.first[w.starts[d] : w.starts[d + 1]], np.full(w.starts[d + 1] - w.starts[d], d))
        assert at.tolist() == [m.start() for m in regex.finditer(r"[^\s\x1c-\x1f]+", t or "")]


def test_repeats_in_runs_and_by_the_second_fingerprint(spark, monkeypatch):
    """Tiny runs of hashing; windows told apart where the first fingerprint can't."""
    t = text(3, 300)
    whole = repeats.Words(pa.array([t])).hashes()
    monkeypatch.setattr(repeats, "RUN", 7)
    assert (repeats.Words(pa.array([t])).hashes() == whole).all()
    names = repeats.window_names
    monkeypatch.setattr(repeats, "window_names", lambda s, at, n, base=repeats._BASE: names(s, at, n, base) & np.uint64(1) if base == repeats._BASE else names(s, at, n, base))
    run = repeats._windows(10, 0)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": [text(5, 60)], "numbers": pa.array([[-1]], pa.list_(pa.int32()))})
    out = run(batch).to_pydict()
    assert len(set(out["name"])) == 2 and len(set(zip(out["name"], out["check"]))) == 51


def test_repeats_odd(spark, odd, empty):
    assert {r.doc_id for r in repeats.repeats(odd).collect()} == set() and repeats.repeats(empty).count() == 0


# --- 7 licences ---


def ends_within(notice, t, most):
    """{end: edits} of the places where some part of t that ends there is within `most` edits of the notice."""
    row = list(range(len(notice) + 1))
    out = {}
    for j, c in enumerate(t, 1):
        new = [0]
        for i, x in enumerate(notice, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        if row[-1] <= most:
            out[j] = row[-1]
    return out


def test_licences_against_every_place_of_every_notice():
    """No place within a notice's edits is without a found notice that is as good; what is found is as near as it says."""
    scanner = licenses.Scanner()
    r = random.Random(8)
    for n in range(45):
        name, notice = licenses.NOTICES[n % len(licenses.NOTICES)]
        w = list(notice)
        for _ in range(r.randint(0, len(notice) // licenses.CHARS_PER_EDIT)):
            at = r.randrange(1, len(w) - 1)
            w[at : at + 1] = r.choice([[], ["#"], [w[at], "#"]])
        t = "qqq " * r.randint(0, 5) + "".join(w) + " zzz" * r.randint(0, 5) + r.choice(["", " " + notice[: len(notice) // 2], " " + notice.upper()])
        low, found = licenses.folded(t), scanner.scan(t)
        for license, a, b, edits in found:
            own = [x for k, x in licenses.NOTICES if k == license]
            # what isn't listed is an identifier behind a tag
            assert not own or edits == min(levenshtein(low[a:b], licenses.folded(x)) for x in own)
        for _, other, most in scanner.notices:
            for end, edits in ends_within(other, low, most).items():
                assert any(a < end and end - len(other) - most < b and e <= edits for _, a, b, e in found), (t, other, end, found)
    assert scanner.scan("nothing of the kind " * 200) == []


def test_licences_wrapped_and_tagged():
    scan = licenses.Scanner().scan
    for t in ("x Licensed under  the Apache\n   License, Version 2.0 y", " * Licensed under the\n * Apache License,\n *  Version 2.0\n", "# Licensed under\n#\n# the Apache License,\t Version 2.0", "// Licensed under the Apache License,\n// Version 2.0"):
        [(name, a, b, edits)] = scan(t)
        assert (name, edits) == ("Apache-2.0", 0) and t[a:].startswith("Licensed") and t[:b].endswith("2.0")
    t = "code /* SPDX-License-Identifier: GPL-2.0-only */"
    assert [(n, t[a:b]) for n, a, b, _ in scan(t)] == [("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only")]
    # ties: of equal edits the longer notice, then the one listed first
    own = licenses.Scanner([("short", "all rights reserved"), ("long", "all rights reserved by us"), ("other", "all rights reserved by us")]).scan
    assert [f[0] for f in own("All rights reserved by us")] == ["long"]
    shuffled = licenses.places("a  b\n# c")
    assert [shuffled(i) for i, c in enumerate(licenses.spaced("a  b\n# c")) if c != " "] == [0, 3, 7]


def test_licences_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "All rights reserved."), (1, "All rights reserved."), (None, "All rights reserved.")]
    docs = frame(spark, rows, extra=True).selectExpr("*", "1 AS license", "2 AS matched", "3 AS start", "4 AS edits")
    assert Counter(r.doc_id for r in licenses.licenses(docs).collect()) == {1: 2, None: 1}


def test_licences_odd(spark, odd, empty):
    assert licenses.licenses(odd).count() == 0 and licenses.licenses(empty).count() == 0
    got = licenses.licenses(frame(spark, [(1, "y " * 30_000 + "ALL RIGHTS RESERVED."), (None, "All rights reservd"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.license, r.edits) for r in got) == [(0, "proprietary", 1), (1, "proprietary", 0)]


# --- 8 quality ---


def test_quality_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 7
        crf = quality.Crf(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 3))
        e = x @ crf.emit
        score = lambda p: crf.first[p[0]] + sum(e[i, p[i]] for i in range(n)) + sum(crf.move[a, b] for a, b in zip(p, p[1:]))
        best = max((tuple(k >> i & 1 for i in range(n)) for k in range(1 << n)), key=score)
        assert tuple(crf.viterbi(x, np.zeros(n, int))) == best


def test_quality_held_out(spark):
    r = random.Random(5)
    good = lambda: "\n".join(" ".join(r.choice(WORDS) + r.choice(("", "", ",")) for _ in range(25)) + "." for _ in range(6))
    bad = lambda: "\n".join(r.choice(("Home | About | Login", "$$$ BUY NOW $$$ !!!", "*** *** ### 123 456", "click")) for _ in range(10))
    docs = frame(spark, [(i, good() if i % 2 else bad()) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    rows = quality.quality(docs, quality.fit(docs, labels)).collect()
    assert np.mean([r.keep == bool(r.doc_id % 2) for r in rows if r.doc_id >= 60]) > 0.95


def test_quality_odd(spark, odd, empty, labelled):
    model = quality.fit(*labelled)
    rows = quality.quality(odd, model).collect()
    assert len(rows) == odd.count() and {r.keep for r in rows if r.doc_id in (1, 2)} == {False}
    assert quality.quality(empty, quality.fit(empty, labelled[1])).count() == 0


# --- 10 neighbours ---


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 8)) + r.integers(0, 6, 600)[:, None] * 4
    x[50] = x[51] = x[52]
    return x


def brute_neighbours(x, k):
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), neighbours.DECIMALS)
    np.fill_diagonal(d, np.inf)
    return {(i, rank, int(j), round(float(np.sqrt(d[i, j])), 6)) for i in range(len(x)) for rank, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k], 1)}


def rows_of(df):
    return {(r.vec_id, r.rank, r.neighbour_id, round(r.distance, 6)) for r in df.collect()}


@pytest.mark.parametrize("size, leaf", [(1000, 16), (100, 8)])
def test_neighbours_exact_at_factor_one(spark, points, size, leaf):
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(points)], "vec_id bigint, embedding array<double>, label int")
    assert rows_of(neighbours.neighbours(df, 5, 1.0, size, leaf)) == brute_neighbours(points, 5)


@pytest.mark.parametrize("size", [1000, 60])
def test_neighbours_of_some_among_all(spark, points, size):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id bigint, embedding array<double>")
    got = rows_of(neighbours.neighbours(df, 5, 1.0, size, 8, queries=F.col("vec_id") % 50 == 0))
    assert got == {r for r in brute_neighbours(points, 5) if r[0] % 50 == 0}


def test_neighbours_in_split_cells(spark, points, monkeypatch):
    """Cells of several shards, routes in several runs."""
    monkeypatch.setattr(neighbours, "PIVOTS", 3)
    monkeypatch.setattr(neighbours, "ROUTES", 7)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id bigint, embedding array<double>")
    assert rows_of(neighbours.neighbours(df, 5, 1.0, 50, 8)) == brute_neighbours(points, 5)


def test_neighbours_recall_when_relaxed(spark, points):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id bigint, embedding array<double>")
    want, got = brute_neighbours(points, 5), rows_of(neighbours.neighbours(df, 5, 1.5, 100, 8))
    assert len({r[::2] for r in want} & {r[::2] for r in got}) >= 0.9 * len(want)
    tree = neighbours.Tree(np.arange(600), points, 8)
    visited = []
    for factor in (1.0, 3.0):
        tree.visited = 0
        tree.search(np.arange(600), points, 5, factor)
        visited.append(tree.visited)
    assert visited[1] < visited[0] < 600 * 600


def test_neighbours_odd(spark):
    schema = "vec_id bigint, embedding array<float>, cell int, far int, shard int, ids int"
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    assert rows_of(neighbours.neighbours(df, 3)) == {(1, 1, 2, 0.0), (1, 2, 3, 1.414214), (2, 1, 1, 0.0), (2, 2, 3, 1.414214), (3, 1, 1, 1.414214), (3, 2, 2, 1.414214)}
    assert neighbours.neighbours(df.limit(0)).count() == 0 and neighbours.neighbours(df.where("vec_id = 3")).count() == 0


def test_near_duplicates_shared_passage_is_not_compared_by_text(spark, monkeypatch):
    """Texts that share a passage and nothing else were all verified with one another; the sets of their words rule nearly all out."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    long = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(25)), *passage]) for _ in range(60)]
    short = [" ".join([*passage[:9], *(f"w{rng.randrange(10**6)}" for _ in range(12))]) for _ in range(60)]
    texts = [*long, *short, long[7].replace(long[7].split()[3], "other"), short[7].replace(short[7].split()[15], "other")]
    seen, verified = [], near_dups._verified
    monkeypatch.setattr(near_dups, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    monkeypatch.setattr(near_dups, "CELL", 16, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {tuple(r) for r in near_dups.near_duplicates(docs).collect()}
    assert found == {(120, 7), (121, 67)}
    assert sum(seen) < 600


def test_word_bits_bound_the_edits():
    rng = np.random.Generator(np.random.PCG64(3))
    hashed = near_dups.Sketcher().hashes
    for size in (64, near_dups.SHORT_BITS, near_dups.BITS):
        for _ in range(200):
            a = [f"w{i}" for i in rng.integers(0, 300, rng.integers(1, 120))]
            b = list(a)
            for _ in range(int(rng.integers(0, 12))):
                at, kind = int(rng.integers(0, len(b) + 1)), int(rng.integers(0, 3))
                b[at : at + (kind > 0)] = [f"w{rng.integers(0, 300)}"] * (kind < 2)
            x, y = (np.unpackbits(np.frombuffer(near_dups.word_bits(hashed(" ".join(t)), size), np.uint8)).astype(bool) for t in (a, b))
            d = near_dups.banded(a, b, len(a) + len(b))
            assert max((x & ~y).sum(), (y & ~x).sum()) <= d
