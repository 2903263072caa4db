"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.functions import vectors
from textquarry.functions.patterns import Matcher, glob, simple_glob
from textquarry.functions.text import plain_tokens
from textquarry.operators import find as finding
from textquarry.operators import search as s
from textquarry.operators import terms
from textquarry.operators.lsa import LsaModel, semantic_search
from textquarry.operators.projection import RandomProjection
from textquarry.plans import render
from textquarry.sources import cache, extract
from textquarry.storage import spread

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import textquarry.plans.file_queries  # noqa: F401, it adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_table(spread(_read(spark, sf_dir, "documents")))


def _lines(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The common tables: lines(key, line, line_number)."""
    return f"""WITH l0 AS (SELECT {key}, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM {table} WHERE {text} <> ''),
l1 AS (SELECT {key}, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l0),
lines AS (SELECT {key}, unnest(a) AS line, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_number FROM l1)
"""


_folded = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _found(results: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    return results.select(F.col("path").alias(key), "line_number", F.col("line_content").alias("line"), *columns)


def _search(name: str, where: str, table: str = "documents", key: str = "doc_id", text: str = "text", **spec) -> None:
    @_add(name, _lines(table, key, text) + f"SELECT {key}, line_number, line FROM lines WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(s.search(Corpus.from_table(_read(spark, sf_dir, table), key, text), s.SearchSpec(**spec)), key)


_search("search_literal", "contains(line, 'the')", patterns=("the",), regex=False)
_search("search_literal_ci", f"contains({_folded.format('line')}, 'the')", patterns=("THE",), regex=False, ignore_case=True)
_search("search_regex", "regexp_matches(line, '[0-9]{3}[-.][0-9]{2,4}')", patterns=(r"[0-9]{3}[-.][0-9]{2,4}",))
_search("search_regex_ci", "regexp_matches(line, '(?i)license[sd]?|contact')", patterns=(r"license[sd]?|contact",), ignore_case=True)
_search("search_anchored", "regexp_matches(line, '^[A-Z]') AND regexp_matches(line, '[.]$')", patterns=(r"^[A-Z].*[.]$",))
_search("search_posix_class", "regexp_matches(line, '[[:digit:]]+[[:alpha:]]')", patterns=(r"[[:digit:]]+[[:alpha:]]",))
_search("search_word", r"regexp_matches(line, '\bthe\b')", patterns=("the",), regex=False, word=True)
_search("search_multi_literal", "contains(line, 'the') OR contains(line, 'license') OR contains(line, '@')", patterns=("the", "license", "@"), regex=False)
_search("search_multi_regex", "regexp_matches(line, '[0-9]{4}') OR regexp_matches(line, 'ing[.,]')", patterns=(r"[0-9]{4}", r"ing[.,]"))
_search("search_smart_case", "contains(line, 'The')", patterns=("The",), smart_case=True)
_search("pages_search", "contains(line, '<p')", "pages", "page_id", "html", patterns=("<p",), regex=False)
_search("benchmark_search", "regexp_matches(line, '[a-z]{3}on[.]')", "benchmark", "item_id", "text", patterns=(r"[a-z]{3}on\.",))


@_add("conversations_search", _lines("(SELECT conv_id || '/' || turn AS path, text FROM conversations)", "path") + "SELECT path, line_number, line FROM lines WHERE contains(line, 'the')")
def conversations_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "conversations").withColumn("path", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return _found(s.search(Corpus.from_table(table, "path"), s.SearchSpec(("the",), False)), "path")


@_add(
    "search_context",
    _lines()
    + """, w AS (SELECT *, lag(line) OVER p AS b1, lag(line, 2) OVER p AS b2, lead(line) OVER p AS a1 FROM lines WINDOW p AS (PARTITION BY doc_id ORDER BY line_number))
SELECT doc_id, line_number, line, array_to_string(list_filter([b2, b1], lambda x: x IS NOT NULL), chr(10)) AS before, coalesce(a1, '') AS after FROM w WHERE contains(line, 'license')""",
)
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.search(_docs(spark, sf_dir), s.SearchSpec(("license",), False, before=2, after=1))
    return _found(found, "doc_id", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


@_add("search_max_count", _lines() + "SELECT doc_id, line_number, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS n FROM lines WHERE contains(line, 'the')) WHERE n <= 2")
def search_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(s.search(_docs(spark, sf_dir), s.SearchSpec(("the",), False, max_count=2)))


@_add("search_max_results", _lines() + "SELECT doc_id, line_number, line FROM lines WHERE contains(line, 'the') ORDER BY doc_id, line_number LIMIT 1000")
def search_max_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(s.search(_docs(spark, sf_dir), s.SearchSpec(("the",), False, max_results=1000)))


@_add("count_per_doc", _lines() + "SELECT doc_id, count(*) AS n FROM lines WHERE contains(line, 'the') GROUP BY doc_id")
def count_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.counts(_docs(spark, sf_dir), s.SearchSpec(("the",), False)).withColumnRenamed("path", "doc_id")


@_add("files_with_matches", _lines() + r"SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(line, '[0-9]+\.[0-9]+')")
def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.paths_with_matches(_docs(spark, sf_dir), s.SearchSpec((r"[0-9]+\.[0-9]+",))).withColumnRenamed("path", "doc_id")


@_add("total_matches", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:er|an)th')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?:er|an)th')")
def total_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.occurrences(_docs(spark, sf_dir), s.SearchSpec((r"(?:er|an)th",))).withColumnRenamed("path", "doc_id")


@_add(
    "find_all_spans",
    """WITH p AS (SELECT doc_id, string_split(text, 'the') AS a FROM documents WHERE contains(text, 'the')),
n AS (SELECT doc_id, a, unnest(range(1, len(a))) AS i FROM p)
SELECT doc_id, CAST(list_sum(list_transform(a[:i], lambda x: strlen(x))) + 3 * (i - 1) AS BIGINT) AS start_byte, CAST(0 AS INTEGER) AS pattern_index, CAST(3 AS BIGINT) AS n_bytes FROM n""",
)
def find_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.spans(_docs(spark, sf_dir), s.SearchSpec(("the",), False))
    return found.select(F.col("path").alias("doc_id"), F.col("offset").alias("start_byte"), "pattern_index", F.col("length").alias("n_bytes"))


@_add("search_root", "SELECT page_id, 'web/' || lang || '/' || page_id AS path FROM (SELECT page_id, html, regexp_extract(url, 'example[.](com|net|org)', 1) AS lang FROM pages) WHERE contains(html, 'the') AND lang = 'org'")
def search_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("web/"), F.regexp_extract("url", "example[.](com|net|org)", 1), F.lit("/"), F.col("page_id").cast("string"))
    found = s.paths_with_matches(Corpus.from_table(_read(spark, sf_dir, "pages").withColumn("path", path), "path", "html"), s.SearchSpec(("the",), False, root="web/org"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("bigint").alias("page_id"), "path")


@_add("include_glob", _lines("pages", "url", "html") + "SELECT url, line_number, line FROM lines WHERE contains(line, '<') AND ends_with(string_split(url, '/')[-1], '1')")
def include_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(s.search(Corpus.from_table(_read(spark, sf_dir, "pages"), "url", "html"), s.SearchSpec(("<",), False, include="*1")), "url")


@_add("union_paths", _lines() + "SELECT doc_id, line_number, line FROM lines WHERE contains(line, 'license') UNION ALL SELECT doc_id, line_number, line FROM lines JOIN documents USING (doc_id) WHERE contains(line, 'license') AND lang = 'en'")
def union_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spec = _read(spark, sf_dir, "documents"), s.SearchSpec(("license",), False)
    return _found(s.union([s.search(Corpus.from_table(docs), spec), s.search(Corpus.from_table(docs.where("lang = 'en'")), spec)]))


_bm25_sql = """SELECT n_docs, avgdl, df, doc_id, tf, dl FROM
(SELECT count(*) AS n_docs, avg(strlen(text)) AS avgdl, sum(CAST(contains(text, 'the') AS BIGINT)) AS df FROM documents),
(SELECT doc_id, (strlen(text) - strlen(replace(text, 'the', ''))) / 3 AS tf, strlen(text) AS dl FROM documents WHERE contains(text, 'the'))"""
_tf_score = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_full_score = f"ln((n_docs - df + 0.5) / (df + 0.5) + 1) * {_tf_score}"


def _scored(name: str, mode: str, score: str) -> None:
    @_add(name, f"SELECT doc_id, round({score}, 6) AS score FROM ({_bm25_sql})")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return s.matched_docs(_docs(spark, sf_dir), s.SearchSpec(("the",), False, bm25=mode)).select(F.col("path").alias("doc_id"), F.round("bm25_score", 6).alias("score"))


_scored("bm25_tf", "tf", _tf_score)
_scored("bm25_full", "full", _full_score)


@_add("search_bm25_full", _lines() + f", b AS (SELECT doc_id, round({_full_score}, 6) AS score FROM ({_bm25_sql})) SELECT doc_id, line_number, line, score FROM lines JOIN b USING (doc_id) WHERE contains(line, 'the')")
def search_bm25_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(s.search(_docs(spark, sf_dir), s.SearchSpec(("the",), False, bm25="full")), "doc_id", F.round("bm25_score", 6).alias("score"))


@_add("bm25_ranked", f"SELECT doc_id, score FROM (SELECT doc_id, round({_full_score}, 6) AS score, {_full_score} AS raw FROM ({_bm25_sql})) ORDER BY raw DESC, doc_id LIMIT 20")
def bm25_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.ranked(_docs(spark, sf_dir), s.SearchSpec(("the",), False, bm25="full"), 20).select(F.col("path").alias("doc_id"), F.round("bm25_score", 6).alias("score"))


@_add("bm25_single_doc", f"SELECT doc_id, round(tf * 2.2 / (tf + 1.2), 6) AS score FROM ({_bm25_sql})")
def bm25_single_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(_docs(spark, sf_dir).docs, single_file=True)
    return s.matched_docs(corpus, s.SearchSpec(("the",), False, bm25="full"), ("tf",)).where("tf > 0").select(F.col("path").alias("doc_id"), F.round("bm25_score", 6).alias("score"))


_space = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}[:punct:]]+"
_tokens_sql = rf"""WITH split AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([^\p{{Lu}}\s[:punct:]])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g') AS x FROM documents WHERE text <> ''),
tokens AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(x, '{_space}'), lambda t: lower(t)), lambda t: t <> '')) AS term FROM split),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
"""


@_add("tokenize_counts", _tokens_sql + "SELECT doc_id, term, tf FROM postings")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.postings(_docs(spark, sf_dir)).withColumnRenamed("path", "doc_id")


@_add("term_df", _tokens_sql + "SELECT term, df FROM dfs")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.document_frequencies(terms.postings(_docs(spark, sf_dir)))


@_add("tfidf", _tokens_sql + "SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents WHERE text <> '') / df), 6) AS weight FROM postings JOIN dfs USING (term) WHERE df < (SELECT count(*) FROM documents WHERE text <> '')")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tfidf(_docs(spark, sf_dir)).select(F.col("path").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@_add("top_terms", _tokens_sql + "SELECT term, df FROM dfs ORDER BY df DESC, term LIMIT 50")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_df(spark, sf_dir).orderBy(F.desc("df"), "term").limit(50)


@_add("plain_token_count", rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_space}'), lambda t: t <> '')) AS BIGINT) AS n FROM documents")
def plain_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(plain_tokens(F.col("text"))).cast("bigint").alias("n"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))


def _query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of the least id, one row."""
    return _vectors(spark, sf_dir).agg(F.min_by("v", "vec_id").alias("q"))


_vec_sql = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT arg_min(v, vec_id) AS q FROM e) "


@_add("vec_dot", _vec_sql + "SELECT vec_id, round(list_dot_product(v, q), 6) AS dot FROM e, q")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).crossJoin(F.broadcast(_query_vector(spark, sf_dir))).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("q")), 6).alias("dot"))


@_add("vec_norm", _vec_sql + "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm_squared FROM e")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.norm_squared(F.col("v")), 6).alias("norm_squared"))


@_add("vec_axpy", _vec_sql + "SELECT vec_id, round(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] + 0.5 * x[2]) * (x[1] + 0.5 * x[2]))), 6) AS norm_squared FROM e, q")
def vec_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = vectors.add_scaled(F.col("v"), F.col("q"), 0.5)
    return _vectors(spark, sf_dir).crossJoin(F.broadcast(_query_vector(spark, sf_dir))).select("vec_id", F.round(vectors.norm_squared(moved), 6).alias("norm_squared"))


@_add("vec_cosine_topk", _vec_sql + "SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS cosine FROM e, q ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 20")
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _vectors(spark, sf_dir).crossJoin(F.broadcast(_query_vector(spark, sf_dir))).select("vec_id", vectors.cosine(F.col("v"), F.col("q")).alias("c"))
    return near.orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("cosine"))


@_add("grouped_results", _lines() + "SELECT doc_id, count(*) AS n_lines, array_to_string(list(line ORDER BY line_number)[:5], chr(10)) AS shown FROM lines WHERE contains(line, 'the') GROUP BY doc_id")
def grouped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.grouped(_docs(spark, sf_dir), s.SearchSpec(("the",), False)).select(F.col("path").alias("doc_id"), "n_lines", F.array_join("lines.line_content", "\n").alias("shown"))


@_add("text_output", _lines() + "SELECT doc_id || ':' || line_number || ':' || line AS line FROM lines WHERE contains(line, 'license')")
def text_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.match_text(s.search(_docs(spark, sf_dir), s.SearchSpec(("license",), False)), line_numbers=True).select("line")


@_add("json_output", _lines() + "SELECT 'match' AS type, CAST(doc_id AS VARCHAR) AS path, line, line_number FROM lines WHERE contains(line, 'license')")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render.match_json(s.search(_docs(spark, sf_dir), s.SearchSpec(("license",), False)))
    field = lambda p: F.get_json_object("line", p)
    return out.select(field("$.type").alias("type"), field("$.data.path.text").alias("path"), field("$.data.lines.text").alias("line"), field("$.data.line_number").cast("bigint").alias("line_number"))


@_add("cat_numbered", _lines() + "SELECT doc_id, line_number, '     ' || line_number || chr(9) || line AS line FROM lines")
def cat_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.numbered(_docs(spark, sf_dir)).withColumnRenamed("path", "doc_id")


@_add("glob_match", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?s)\Ahttps://.*/.*1.\z')")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").where(glob(F.col("url"), "https://*/*1?")).select("page_id", "url")


@_add("glob_match_ci", r"SELECT page_id FROM pages WHERE regexp_matches(lower(url), '(?s)\A.*[.]exampl..org.*\z')")
def glob_match_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").where(glob(F.col("url"), "*.EXAMPL?.ORG*", True)).select("page_id")


@_add("simple_glob", "SELECT page_id FROM pages WHERE starts_with(url, 'https') AND contains(url, 'e')")
def simple_glob_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").where(simple_glob(F.col("url"), "https*") & simple_glob(F.col("url"), "*e*")).select("page_id")


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts table as a file relation: brand directories hold files named after the type."""
    part = _read(spark, sf_dir, "part")
    path = F.concat(F.lit("/root/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."), F.lower(F.split("p_type", " ")[0]))
    return part.select(s.name_of(path).alias("name"), path.alias("path"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(False).alias("is_dir"))


_part_files = "(SELECT '/root/' || p_brand || '/' || p_partkey || '.' || lower(string_split(p_type, ' ')[1]) AS path, p_partkey || '.' || lower(string_split(p_type, ' ')[1]) AS name FROM part)"


@_add("find_name_path", rf"SELECT './' || path[7:] AS display FROM {_part_files} WHERE regexp_matches(name, '\A1.*\z') AND regexp_matches('./' || path[7:], '\A\./.*2/.*\z')")
def find_name_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding.find(_as_files(spark, sf_dir), "/root", ".", name="1*", path="./*2/*", entry_type="f").select("display")


@_add("find_iname", f"SELECT path AS display FROM {_part_files} WHERE lower(name) LIKE '%.s%'")
def find_iname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding.find(_as_files(spark, sf_dir), "/root", "/root", iname="*.S*").select("display")


@_add("fd_extension", f"SELECT path[7:] AS display FROM {_part_files} WHERE string_split(name, '.')[-1] = 'standard' AND regexp_matches(name, '1[0-9]')")
def fd_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding.fd(_as_files(spark, sf_dir), "/root", "1[0-9]", "STANDARD", "f").select("display")


@_add("fd_fixed", f"SELECT path[7:] AS display FROM {_part_files} WHERE contains(name, '7.s')")
def fd_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding.fd(_as_files(spark, sf_dir), "/root", "7.S", ignore_case=True, fixed=True).select("display")


@_add("detect_type", "SELECT page_id, CASE WHEN contains(html, chr(0)) THEN 'unknown' ELSE 'text' END AS file_type FROM pages")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", extract.file_type(F.lit("index.html"), F.encode(F.col("html"), "UTF-8")).alias("file_type"))


@_add("cache_key", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


_lru = """SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 1000000"""


@_add("cache_lru", _lru)
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return cache.newest_that_fit(entries, "doc_id", "doc_id", 1_000_000).select("doc_id")


@_add("lsa_doc_rank")
def lsa_doc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their similarity to a query in the space of the truncated SVD."""
    model = LsaModel.fit(_docs(spark, sf_dir))
    return model.rank("license terms of the software").select(F.col("path").alias("doc_id"), F.round("score", 4).alias("score"))


@_add("lsa_line_rank")
def lsa_line_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _docs(spark, sf_dir)
    return semantic_search(corpus, "license terms of the software").withColumnRenamed("path", "doc_id")


@_add("rp_project")
def rp_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their similarity to a query under a random projection."""
    return RandomProjection().score(_docs(spark, sf_dir), "license terms of the software").withColumnRenamed("path", "doc_id")
