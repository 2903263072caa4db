import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import scoring, vectors
from textquarry.functions.patterns import Matcher, PatternError, escape, glob, simple_glob, translate, word
from textquarry.functions.text import lines, plain_tokens, tokens, trimmed


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def hit(spark, pattern, text, **kw):
    return one(spark, Matcher((pattern,), **kw).matches(F.col("c0")), text)


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        (r"\bfoo\b", "foobar", False), (r"\bfoo\b", "a foo.", True), (r"\w+", "é", True), ("(?i)é", "É", True), ("a.b", "a\u0085b", True), ("a.b", "a\rb", True), ("a$", "a\n", False),
        (r"[[:alpha:]]", ":", False), (r"[[:^alpha:]]", "1", True), (r"(?P<n>x)y", "xy", True), (r"(?<n_1>x)y", "xy", True), (r"\x{e9}", "é", True), (r"é", "é", True), (r"\p{Greek}", "α", True),
        (r"\p{Lu}", "a", False), (r"\pL", "a", True), (r"[a&&b]", "a", False), (r"[&]", "&", True), (r"[]a]", "]", True), (r"x{,2}y", "xxy", True), (r"a|", "zzz", True), (r"\$5", "$5", True), ("", "x", True),
    ],
)
def test_matches(spark, pattern, text, want):
    assert hit(spark, pattern, text) is want


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?>a)", r"(a)\1", r"\k<n>", "a++", "a**", "(", ")", "[a", "*a", "a{2", "a{3,2}", r"\Q", r"[a--b]", "\\", "[[:what:]]"])
def test_rejects(pattern):
    with pytest.raises(PatternError):
        Matcher((pattern,)).java  # noqa: B018


def test_folding(spark):
    assert hit(spark, "É", "é", ignore_case=True)
    assert not hit(spark, "É", "é", regex=False, ignore_case=True)
    assert hit(spark, "ABC", "xabcx", regex=False, ignore_case=True)


def test_dollar_and_lines():
    assert translate("a$") == r"a\z" and translate("a$", lines=True) == "a$" and translate("(?m)a$") == "(?m)a$"


@given(st.text(max_size=12))
@settings(max_examples=60, deadline=None)
def test_escape_is_literal(text):
    assert Matcher((escape(text),)).java is not None
    # the escaped form stays valid where Java and Python agree
    assert re.fullmatch(re.escape(text), text)


def test_spans_and_counts(spark):
    def spans(m, text):
        return [tuple(x) for x in one(spark, m.spans(F.col("c0")), text)]

    assert spans(Matcher(("hello",), False), "say hello world") == [(4, 0, 5)]
    assert spans(Matcher(("login", "auth", "session"), False), "login auth session") == [(0, 0, 5), (6, 1, 4), (11, 2, 7)]
    assert spans(Matcher(("abcd", "bc"), False), "abcd") == [(1, 1, 2)]
    assert spans(Matcher(("é",), True), "aéé") == [(1, 0, 2), (3, 0, 2)]
    for m, text, n in [(Matcher(("aa",), False), "aaaaa", 2), (Matcher(("abcd", "bc"), False), "abcdbc", 2), (Matcher(("a+",)), "aa b a", 2), (Matcher(("^x",)), "x\nx\ny", 2), (Matcher(("",), False), "ab", 3)]:
        assert one(spark, m.count(F.col("c0")), text) == n


def test_word():
    assert word("a.b", literal=True) == r"\ba\.b\b" and word("a|b") == r"\b(?:a|b)\b"


def test_globs(spark):
    for pattern, name, want in [("*.rs", "main.rs", True), ("*.rs", "main.txt", False), ("a?c", "abc", True), ("a?c", "ac", False), ("*", "", True), ("[a]", "a", False), ("a*b*c", "a/x/b/c", True), ("(x)", "(x)", True)]:
        assert one(spark, glob(F.col("c0"), pattern), name) is want
    assert one(spark, glob(F.col("c0"), "*.RS", True), "É.rs")
    for pattern, name, want in [("*.rs", "a.rs", True), ("a*", "abc", True), ("*b*", "abc", True), ("abc", "abc", True), ("a*c", "abc", False), ("**", "a*", True), ("?", "a", False)]:
        assert one(spark, simple_glob(F.col("c0"), pattern), name) is want


@pytest.mark.parametrize("text, want", [("a\n", ["a"]), ("a\n\n", ["a", ""]), ("", []), ("a\r\nb\r", ["a", "b\r"]), ("\n", [""]), ("a", ["a"]), ("a\r\r\n", ["a\r"])])
def test_lines(spark, text, want):
    assert one(spark, lines(F.col("c0")), text) == want


@pytest.mark.parametrize("text, want", [("Hello, world! This is a test.", "hello world this is a test"), ("getUserName", "get user name"), ("get_user_name", "get user name"), ("parseHTMLDocument", "parse html document"), ("", "")])
def test_tokens(spark, text, want):
    assert one(spark, tokens(F.col("c0")), text) == want.split()


def test_plain_tokens_and_trim(spark):
    assert one(spark, plain_tokens(F.col("c0")), "getUser_Name x") == ["getuser", "name", "x"]
    assert one(spark, trimmed(F.col("c0")), "  a b ") == "a b"


def test_bm25(spark):
    import math

    got = one(spark, scoring.bm25(F.lit(3), F.lit(40), F.lit(50.0), F.lit(100), F.lit(10)))
    tf = 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 40 / 50))
    assert got == pytest.approx(math.log(90.5 / 10.5 + 1) * tf)


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, vectors.norm_squared(v(3, 4))) == 25
    assert one(spark, vectors.dot(v(*range(1, 10)), v(*range(9, 0, -1)))) == 165
    assert one(spark, vectors.add_scaled(v(*range(1, 10)), v(*[2] * 9), 0.5)) == [float(i) for i in range(2, 11)]
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) == 0 and one(spark, vectors.cosine(v(1, 1), v(2, 2))) == pytest.approx(1)
