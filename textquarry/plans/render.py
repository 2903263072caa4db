"""Results as text and JSON lines, as columns; what a terminal shows is joined on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _prefix():
    return F.when(F.col("bm25_score").isNull(), F.lit("")).otherwise(F.format_string("[%.2f] ", "bm25_score"))


def match_text(results: DataFrame, line_numbers: bool = False, filename: bool = True) -> DataFrame:
    """(path, line_number, line): each match with its context; context lines have dashes in place of colons. Contexts that overlap come again."""
    path, n, prefix = F.col("path").cast("string"), F.col("line_number"), _prefix()

    def context(c: str, first):
        return F.transform(c, lambda x, i: F.concat(prefix, path, F.lit("-"), (first + i).cast("string"), F.lit("-"), x))

    parts = [path] if filename else []
    parts += [n.cast("string")] if line_numbers else []
    own = F.concat(prefix, F.concat_ws(":", *parts, F.col("line_content")))
    all_ = F.concat(context("context_before", n - F.size("context_before")), F.array(own), context("context_after", n + 1))
    return results.select("path", "line_number", F.array_join(all_, "\n").alias("line"))


def match_json(results: DataFrame) -> DataFrame:
    """(path, line_number, line): a JSON object a match."""
    text = lambda c: F.struct(c.alias("text"))
    submatch = F.struct(text(F.lit("")).alias("match"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    data = F.struct(text(F.col("path").cast("string")).alias("path"), text(F.col("line_content")).alias("lines"), "line_number", F.lit(0).alias("absolute_offset"), F.array(submatch).alias("submatches"), "bm25_score")
    return results.select("path", "line_number", F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("line"))


def semantic_text(rows: list, most: int = 5) -> str:
    """The best documents with their lines in colours, from collected rows (path, score, line_number, line_content) in order."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["path"], []).append(r)
    out = []
    for path, own in groups.items():
        out.append(f"\x1b[36m[{own[0]['score'] or 0.0:.4f}]\x1b[0m \x1b[1;35m{path}\x1b[0m\n")
        out += [f"  \x1b[32m{r['line_number']}\x1b[0m: {r['line_content']}\n" for r in own[:most]]
        out.append(f"  ... and {len(own) - most} more matches\n" * (len(own) > most) + "\n")
    return "".join(out) + (f"\x1b[33m{len(groups)} files matched, ranked by semantic relevance\x1b[0m\n" if groups else "")
