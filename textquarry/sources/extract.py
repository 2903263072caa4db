"""File types and texts of plain, gzip, zip, docx, xlsx and PDF files."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.schema import DOCS
from textquarry.storage import small_batches, written

#: Extensions of text files, without the dot.
TEXT = frozenset(
    "adoc bash c cfg clj cmake conf cpp css csv dockerignore editorconfig el env ex exs fs gitignore go gradle graphql h hs htm html ini java js json jsx kt lua m makefile markdown md ml org php pl proto py r rb rs rst sbt scala sh sql sv swift toml ts tsv tsx txt v vhd vim xml yaml yml zsh".split()
)
_ends = re.compile(r"\.(?:" + "|".join(sorted(TEXT)) + r")\Z")
NAMES = frozenset("changelog dockerfile gemfile license makefile procfile rakefile readme vagrantfile".split())


class ExtractError(Exception):
    """A file whose text can't be had."""


def detect(name: str, header: bytes, strict: bool = False) -> str:
    """text, gzip, zip, docx, xlsx, pdf or unknown, from the first 16 bytes, then the name. strict: a character cut by the header's end makes a file unknown."""
    name = name.lower()
    if header.startswith(b"\x1f\x8b"):
        return "gzip"
    if header.startswith(b"PK\x03\x04"):
        return "docx" if name.endswith(".docx") else "xlsx" if name.endswith(".xlsx") else "zip"
    if header.startswith(b"%PDF-"):
        return "pdf"
    if _ends.search(name):
        return "text"
    try:
        header.decode()
    except UnicodeDecodeError as e:
        if strict or len(header) < 16 or e.end != len(header) or e.reason != "unexpected end of data":
            return "unknown"
    return "text" if name.rpartition("/")[2] in NAMES or b"\0" not in header else "unknown"


def file_type(name: Column, content: Column) -> Column:
    """detect() as a column; a character cut by the header's end doesn't matter."""
    header, low = F.substring(content, 1, 16), F.lower(name)
    head = F.hex(header)
    text = low.rlike(_ends.pattern.replace(r"\Z", r"\z")) | (F.is_valid_utf8(header) | F.is_valid_utf8(F.substring(content, 1, 15)) | F.is_valid_utf8(F.substring(content, 1, 14)) | F.is_valid_utf8(F.substring(content, 1, 13))) & (
        F.element_at(F.split(low, "/"), -1).isin(*sorted(NAMES)) | ~F.regexp_like(head, F.lit(r"\A(?:..)*00"))
    )
    zipped = F.when(low.endswith(".docx"), "docx").when(low.endswith(".xlsx"), "xlsx").otherwise("zip")
    return F.when(head.startswith("1F8B"), "gzip").when(head.startswith("504B0304"), zipped).when(head.startswith("255044462D"), "pdf").when(text, "text").otherwise("unknown")


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise ExtractError(f"not UTF-8: {e}") from e


def _gzip(data: bytes) -> str:
    """The first member."""
    try:
        opened = zlib.decompressobj(31)
        out = opened.decompress(data) + opened.flush()
        if not opened.eof:
            raise ExtractError("gzip: unexpected end")
        return _utf8(out)
    except zlib.error as e:
        raise ExtractError(f"gzip: {e}") from e


def _member(data: bytes, name: str) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read(name)
    except (KeyError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, ValueError) as e:
        raise ExtractError(f"{name}: {e}") from e


def _zip(data: bytes) -> str:
    """Each readable text entry below a line with its name."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for entry in z.infolist():
                if entry.is_dir():
                    continue
                try:
                    raw = z.read(entry)
                    if raw and b"\0" not in raw:
                        out.append(f"--- {entry.filename} ---\n{raw.decode()}")
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, UnicodeDecodeError):
                    continue
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise ExtractError(f"zip: {e}") from e
    if not out:
        raise ExtractError("zip: no text entry")
    return "\n".join(out)


def _xml(data: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ExtractError(f"XML: {e}") from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _docx(data: bytes) -> str:
    """A line for each paragraph with text."""
    paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in _xml(_member(data, "word/document.xml")).iter() if _local(p) == "p"]
    if not (out := "\n".join(p for p in paragraphs if p)):
        raise ExtractError("docx: no text")
    return out


def _xlsx(data: bytes) -> str:
    """A line for each text of the shared strings; numbers aren't among them."""
    if not (out := "\n".join(t.text for t in _xml(_member(data, "xl/sharedStrings.xml")).iter() if _local(t) == "t" and t.text)):
        raise ExtractError("xlsx: no text")
    return out


_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n", b"\r") else _escapes.get(x, x)

    out = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)
    return out[2:].decode("utf-16-be", "replace") if out.startswith(b"\xfe\xff") else out.decode("cp1252", "replace")


_shown = re.compile(rb"\[((?:\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*)\]\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|['\"])|(T\*|(?:Td|TD|ET)\b)", re.S)
_strings = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)", re.S)


def _pdf(data: bytes) -> str:
    """The strings that content streams show (flat or deflated), in fonts with plain encodings; pypdf where it is installed."""
    try:
        import pypdf

        out = "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    except ImportError:
        parts: list[str] = []
        for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
            body = m[1]
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                pass
            if b"Tj" not in body and b"TJ" not in body and b"'" not in body:
                continue
            for s in _shown.finditer(body):
                if s[3]:
                    parts.append("\n")
                for text, code, kern in _strings.findall((s[1] or b"") + (s[2] or b"")):
                    if kern:
                        parts.append(" " if float(kern) < -200 else "")
                    else:
                        parts.append(_pdf_string(bytes.fromhex(re.sub(rb"\s", b"", code).decode() + "0" * (len(re.sub(rb"\s", b"", code)) % 2))) if code else _pdf_string(text))
        out = re.sub(r"\n{2,}", "\n", "".join(parts)).strip("\n")
    except Exception as e:  # a damaged PDF may fail anywhere in the parser
        raise ExtractError(f"pdf: {e}") from e
    if not out.strip():
        raise ExtractError("pdf: no text")
    return out


_readers = {"text": _utf8, "gzip": _gzip, "zip": _zip, "docx": _docx, "xlsx": _xlsx, "pdf": _pdf}


def extract(name: str, data: bytes, strict: bool = False) -> str:
    """The text of a file's bytes; empty for an empty file."""
    if not data:
        return ""
    kind = detect(name, data[:16], strict)
    if kind not in _readers:
        raise ExtractError("unsupported file type")
    return _readers[kind](data)


#: Characters of text that are passed on together.
TOGETHER = 1_000_000
_EXTRACTED = ("path", "size", "file_type", "text", "extract_error")


def _batches(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    """Rows, whose fourth value is a text, as batches of a bounded size (a single text may be longer)."""
    own, size = [], 0
    for row in rows:
        own.append(row)
        size += len(row[3] or "")
        if size > TOGETHER or len(own) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names=list(names))
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names=list(names))


def _read(path: str, name: str, cached: bool) -> tuple[str, str | None, str | None, str | None]:
    """File type, text, error and, for formats that a cache keeps, the hash of the bytes; such a file's text is left to later."""
    kind = "unknown"
    try:
        with open(path, "rb") as f:
            data = f.read()
        kind = detect(name, data[:16])
        if cached and data and kind != "text":
            return kind, None, None, hashlib.sha256(data).hexdigest()
        return kind, extract(name, data), None, None
    except (ExtractError, OSError) as e:
        return kind, None, str(e), None


def extracted(files: DataFrame, cache=None) -> DataFrame:
    """path, size, file_type, text and extract_error of the files; text is null where there is an error.

    cache: an ExtractCache. Files of binary formats are looked up in it by the hash of their
    bytes, in a join; those it lacks are extracted and put into it, those it has count as just used. That
    happens at the call, whose result is a written table.
    """
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, name, size in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "size"))):
                    kind, text, error, key = _read(path, name, cache is not None)
                    yield path, size, kind, text, error, key

        n = 5 if cache is None else 6
        yield from _batches((r[:n] for r in rows()), (*_EXTRACTED, "sha256")[:n], kinds[:n])

    small_batches(files.sparkSession)
    if cache is None:
        return files.select("path", "name", "size").mapInArrow(run, DOCS)
    spark = files.sparkSession
    keyed = files.select("path", "name", "size").mapInArrow(run, "path string, size bigint, file_type string, text string, extract_error string, sha256 string")
    found = keyed.join(cache.table(spark).select("sha256", F.col("text").alias("kept")), "sha256", "left")

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, size, kind, text, error, key, kept in zip(*(c.to_pylist() for c in batch.columns)):
                    if key is not None and kept is None:
                        _, kept, error, _ = _read(path, path.rpartition("/")[2], False)
                        yield path, size, kind, kept, error, key, False
                    else:
                        yield path, size, kind, text if key is None else kept, error, key, None if key is None else True

        yield from _batches(rows(), (*_EXTRACTED, "sha256", "hit"), (*kinds, pa.bool_()))

    columns = found.select(*_EXTRACTED, "sha256", "kept")
    out = written(columns.mapInArrow(missing, "path string, size bigint, file_type string, text string, extract_error string, sha256 string, hit boolean"), "extracted")
    cache.put(out.where("NOT hit AND text IS NOT NULL").groupBy("sha256").agg(F.first("text").alias("text")))
    cache.touch(spark, out.where("hit").select("sha256").distinct())
    return out.select(*_EXTRACTED)
