import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import same, views

from textquarry.plans import queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents of which one of each format is empty, one is null and two are line feeds alone."""
    texts = [*(f"license of text {i}\n\nthe end" for i in range(12)), *[""] * 6, None, "one word", "\n"]
    out = tmp_path_factory.mktemp("odd")
    rows = {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "lang": pa.array(["en"] * len(texts)), "source": pa.array(["s1"] * len(texts)), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(rows), os.path.join(out, "documents.parquet"))
    return str(out)


@pytest.mark.parametrize("name", "plain_text gzip_text zip_text docx_text xlsx_text pdf_text file_types cache_through cache_entries".split())
def test_empty_texts_equal_sql(spark, folder, name):
    same(queries.queries()[name](spark, folder), queries.oracle_sql()[name], views(folder))
