import gzip
import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from textquarry.corpus import Corpus
from textquarry.plans import commands, flags
from textquarry.sources import filetree
from textquarry.sources.cache import ExtractCache, newest_that_fit
from textquarry.sources.extract import ExtractError, detect, extract, extracted, file_type

W = 'xmlns:w="urn:w"'


def zipped(**entries: bytes | str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def docx(*paragraphs: list[str]) -> bytes:
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>" for runs in paragraphs)
    return zipped(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pdf(text: str, deflate: bool) -> bytes:
    body = f"BT /F1 12 Tf ({text}) Tj T* [(se) -300 (cond)] TJ ET".encode()
    body = zlib.compress(body) if deflate else body
    return b"%PDF-1.4\n1 0 obj\n<< >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


CASES = {
    "a.txt": (b"plain needle\n", "text", "plain needle\n"),
    "a.log.gz": (gzip.compress(b"zipped needle\n"), "gzip", "zipped needle\n"),
    "two.gz": (gzip.compress(b"one") + gzip.compress(b"two"), "gzip", "one"),
    "a.zip": (zipped(src__main="fn needle", bin=b"\0\1"), "zip", "--- src/main ---\nfn needle"),
    "a.docx": (docx(["Hello ", "World"], [], ["needle"]), "docx", "Hello World\nneedle"),
    "a.xlsx": (zipped(**{"xl__sharedStrings.xml": "<sst><si><t>one</t></si><si><r><t>two</t></r><r><t>three</t></r></si></sst>"}), "xlsx", "one\ntwo\nthree"),
    "a.pdf": (pdf("first \\(needle\\)", False), "pdf", "first (needle)\nse cond"),
    "b.pdf": (pdf("first", True), "pdf", "first\nse cond"),
    "gzip.txt": (gzip.compress(b"x"), "gzip", "x"),
    "cut": (b"123456789012345\xc3\xa9", "text", "123456789012345é"),
    "empty.bin": (b"", "text", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_detect_and_extract(name):
    data, kind, text = CASES[name]
    assert detect(name, data[:16]) == kind and extract(name, data) == text


@pytest.mark.parametrize("name, data", [("x.bin", b"a\0b"), ("x.rs", b"\xff\xfe"), ("x.zip", b"PK\x03\x04junk"), ("x.docx", zipped(a="b")), ("x.gz", b"\x1f\x8bjunk"), ("x.pdf", b"%PDF-1.4 nothing"), ("x.docx", docx([]))])
def test_unreadable(name, data):
    with pytest.raises(ExtractError):
        extract(name, data)


def test_cut_character_when_strict():
    assert detect("cut", CASES["cut"][0][:16], strict=True) == "unknown"


def test_detect_column_agrees(spark):
    cases = {**CASES, "x.bin": (b"a\0b", "unknown", ""), "y": (b"\xff\xfe", "unknown", "")}
    df = spark.createDataFrame([(n, bytearray(d)) for n, (d, _, _) in cases.items()], "name string, content binary")
    assert {r.name: r.t for r in df.select("name", file_type(F.col("name"), F.col("content")).alias("t")).collect()} == {n: k for n, (_, k, _) in cases.items()}


@pytest.fixture
def tree(tmp_path):
    for name, (data, _, _) in CASES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "main.rs").write_text("fn main() {\n    needle();\n    other();\n}\n")
    (tmp_path / "src" / "deep" / "Keep.LOG").write_text("needle needle\n")
    (tmp_path / "src" / "deep" / "keep.log").write_text("needle\n")
    (tmp_path / "src" / ".gitignore").write_text("!keep.log\n")
    (tmp_path / "x.log").write_text("needle\n")
    (tmp_path / "target" / "out.txt").write_text("needle\n")
    (tmp_path / ".hidden").write_text("nothing\n")
    (tmp_path / ".gitignore").write_text("# comment\n*.log\n/target/\n")
    return tmp_path


def test_walk_and_ignore(spark, tree):
    names = {os.path.relpath(r.path, tree) for r in filetree.files(spark, str(tree)).collect()}
    assert {".hidden", ".gitignore", "src", "src/main.rs", "src/deep/keep.log", "src/deep/Keep.LOG", "empty.bin"} <= names
    assert not {"x.log", "target", "target/out.txt"} & names
    every = {os.path.relpath(r.path, tree) for r in filetree.files(spark, str(tree), gitignore=False).collect()}
    assert {"x.log", "target", "target/out.txt"} <= every
    assert {r.name for r in filetree.named(filetree.files(spark, str(tree)), "*.pd[f]").collect()} == {"a.pdf", "b.pdf"}
    assert filetree.named(filetree.files(spark, str(tree)), "[").count() == 0
    with pytest.raises(FileNotFoundError):
        filetree.files(spark, str(tree / "none"))


@pytest.mark.parametrize("line, path, is_dir, want", [("a/**/b", "a/x/y/b", False, True), ("a/**", "a/x", False, True), ("**/c", "x/c", False, True), ("*.o", "x/y.o", False, True), ("/x", "y/x", False, False), ("d/", "d", False, False), ("d/", "d", True, True), ("[!a]z", "bz", False, True), (r"\#x", "#x", False, True)])
def test_ignore_rules(line, path, is_dir, want):
    pattern, _, only_dirs = filetree._rule(line)
    assert bool(pattern.match(path) and (is_dir or not only_dirs)) is want


def test_extracted_and_cache(spark, tree, tmp_path_factory):
    cache = ExtractCache(str(tmp_path_factory.mktemp("cache") / "c"), 10_000)
    files = filetree.files(spark, str(tree)).where("NOT is_dir")
    first = {os.path.basename(r.path): r for r in extracted(files).collect()}
    assert first["a.docx"].text == "Hello World\nneedle" and first["a.docx"].extract_error is None
    key = cache.key(CASES["a.docx"][0])
    cache.put(spark.createDataFrame([(key, "from the cache")], "sha256 string, text string"))
    again = {os.path.basename(r.path): r.text for r in extracted(files, cache).collect()}
    assert again["a.docx"] == "from the cache" and again["a.txt"] == "plain needle\n"
    got = cache.get(spark.createDataFrame([(bytearray(CASES["a.docx"][0]),), (bytearray(b"?"),)], "content binary")).collect()
    assert sorted((r.text or "") for r in got) == ["", "from the cache"]


def test_cache_is_written_through(spark, tree, tmp_path_factory):
    """A miss is extracted and put, a hit counts as used again, a changed file misses."""
    cache = ExtractCache(str(tmp_path_factory.mktemp("cache") / "c"), 10_000)
    corpus = lambda: {os.path.basename(r.path): r.text for r in Corpus.from_path(spark, str(tree), cache).docs.collect()}
    plain = {os.path.basename(r.path): r.text for r in Corpus.from_path(spark, str(tree)).docs.collect()}
    assert corpus() == plain
    kept = {r.sha256: r for r in cache.table(spark).collect()}
    binary = {n: d for n, (d, kind, _) in CASES.items() if kind not in ("text", "unknown")}
    assert {cache.key(d) for d in binary.values()} == set(kept)
    cache.put(spark.createDataFrame([(cache.key(binary["a.docx"]), "kept")], "sha256 string, text string"))
    (tree / "a.xlsx").write_bytes(zipped(**{"xl__sharedStrings.xml": "<sst><si><t>new</t></si></sst>"}))
    assert corpus() == {**plain, "a.docx": "kept", "a.xlsx": "new"}
    again = {r.sha256: r for r in cache.table(spark).collect()}
    assert len(again) == len(kept) + 1 and again[cache.key(binary["a.docx"])].last_used > kept[cache.key(binary["a.docx"])].last_used
    stale = cache.key(binary["a.xlsx"])
    assert again[stale].last_used == kept[stale].last_used


def test_trees_are_cut_by_bytes_and_entries(spark, tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"f{i:02d}").write_bytes(b"x" * 10)
    reader = filetree._Reader({"path": str(tmp_path)})
    monkeypatch.setattr(filetree, "BYTES", 35)
    assert [len(p.rows) for p in reader.partitions()] == [3, 3, 3, 3]
    monkeypatch.setattr(filetree, "ENTRIES", 2)
    assert [len(p.rows) for p in reader.partitions()] == [2] * 6


def test_cache_evicts_the_oldest(spark, tmp_path):
    rows = [(f"k{i}", 10, i) for i in (1, 2, 3, 4)]
    kept = newest_that_fit(spark.createDataFrame(rows, "k string, size bigint, t int"), "k", "t", 30)
    assert sorted(r.k for r in kept.collect()) == ["k2", "k3", "k4"]
    cache = ExtractCache(str(tmp_path / "c"), 25)
    for i in range(3):
        cache.put(spark.createDataFrame([(f"k{i}", "x" * 10)], "sha256 string, text string"))
    assert sorted(r.sha256 for r in cache.table(spark).collect()) == ["k1", "k2"]


def run(spark, tree, command, *args):
    return commands.dispatch(spark, command, list(args), str(tree))


def test_rg(spark, tree):
    out = run(spark, tree, "rg", "-n", "needle", "src")
    root = os.path.realpath(tree)
    assert out.exit_code == 0 and out.stdout.splitlines() == [f"{root}/src/deep/Keep.LOG:1:needle needle", f"{root}/src/deep/keep.log:1:needle", f"{root}/src/main.rs:2:    needle();"]
    assert run(spark, tree, "rg", "-c", "needle", "src/main.rs").stdout == f"{root}/src/main.rs:1\n"
    assert run(spark, tree, "rg", "-C", "1", "-n", "needle", "src/main.rs").stdout.splitlines()[0] == f"{root}/src/main.rs-1-fn main() {{"
    assert run(spark, tree, "rg", "-l", "-g", "*.rs", "needle").stdout == f"{root}/src/main.rs\n"
    assert '"type":"match"' in run(spark, tree, "rg", "--json", "needle", "src/main.rs").stdout
    assert run(spark, tree, "rg", "--bm25", "needle", "src/main.rs").stdout.startswith("[1.00] ")
    assert run(spark, tree, "rg", "absent-word").exit_code == 1
    assert run(spark, tree, "rg", "(?=x)").exit_code == 2 and run(spark, tree, "rg", "x", "nowhere").exit_code == 2
    assert run(spark, tree, "rg", "--pcre2", "x").exit_code == 200 and run(spark, tree, "rg").exit_code == 200


def test_grep(spark, tree):
    root = os.path.realpath(tree)
    assert run(spark, tree, "grep", "-rhn", "needle", "src/main.rs", "src/main.rs").stdout == "2:    needle();\n" * 2
    assert run(spark, tree, "grep", "-w", "--include=*.rs", "needle", "src").stdout == f"{root}/src/main.rs:    needle();\n"
    assert run(spark, tree, "grep", "-hc", "needle", "src/main.rs").stdout == "1\n"
    assert run(spark, tree, "grep", "--color", "x").exit_code == 200


def test_find_fd_cat(spark, tree):
    assert run(spark, tree, "find", "src", "-name", "*.rs", "-type", "f").stdout == "src/main.rs\n"
    assert run(spark, tree, "find", ".", "-type", "d").stdout.splitlines() == ["./src", "./src/deep", "./target"]
    assert run(spark, tree, "fd", "-e", "log", "-i", "KEEP").stdout.splitlines() == ["src/deep/Keep.LOG", "src/deep/keep.log"]
    assert run(spark, tree, "fd", "zzz").exit_code == 1 and run(spark, tree, "fd", "(").exit_code == 200 and run(spark, tree, "find", "-mtime", "1").exit_code == 200
    assert run(spark, tree, "cat", "-n", "a.docx").stdout == "     1\tHello World\n     2\tneedle\n"
    out = run(spark, tree, "cat", "a.txt", "none")
    assert out.exit_code == 1 and out.stdout == "plain needle\n" and run(spark, tree, "cat", "-").exit_code == 200
    assert run(spark, tree, "sed").exit_code == 200


def test_what_is_not_served(spark, tree):
    assert run(spark, tree, "rg", "-U", "needle", "src/main.rs").exit_code == 0
    assert run(spark, tree, "rg", "-U", r"needle\s+other", "src").exit_code == 200 and run(spark, tree, "rg", "-U", "--multiline-dotall", "a.b").exit_code == 200
    assert run(spark, tree, "rg", "-t", "nothing", "needle").exit_code == 2
    out = commands.dispatch(spark, "rg", ["needle"], str(tree), max_results=2)
    assert len(out.stdout.splitlines()) == 2 and "2 results" in out.stderr


def test_search_command(spark, tree):
    assert run(spark, tree, "search", "needle", "src/main.rs").stdout == f"{os.path.realpath(tree)}/src/main.rs:2:    needle();\n"
    assert run(spark, tree, "search").exit_code == 2 and run(spark, tree, "search", "--what", "x").exit_code == 2
    # a single file is searched line by line
    assert run(spark, tree, "search", "needle", "src/main.rs", "--semantic").stdout.endswith("needle();\n")
    assert run(spark, tree, "search", "main function", ".", "--semantic").exit_code == 0


def test_parsers():
    a = commands.parse_rg(["--bm25=full", "-i", "-s", "--context=2", "-A", "x", "p", "q", "r"])
    assert (a.bm25, a.ignore_case, a.before, a.after, a.pattern, a.paths) == ("full", False, 2, 2, "p", ["q"])
    assert commands.parse_rg(["--max-depth", "3", "x", "."]) is None and commands.parse_rg(["-ni", "x"]) is None and commands.parse_rg(["-A"]) is None
    assert commands.parse_rg(["--", "-x"]).pattern == "-x"
    g = commands.parse_grep(["-ril", "pattern"])
    assert g.ignore_case and g.files and g.paths == ["."]
    assert commands.parse_fd(["-t", "x"]) is None and commands.parse_find(["-type", "directory"])["entry_type"] == "d"
    assert flags.kind("-e") == "value" and flags.kind("--json") == "bool" and flags.kind("--what") is None and flags.kind("--json=x") == "value"


def test_single_file_corpus(spark, tree):
    assert Corpus.from_path(spark, str(tree / "a.txt")).single_file
