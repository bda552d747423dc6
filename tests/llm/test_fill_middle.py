import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import fill_middle as fim

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


def plain(i, text, unit="line", fim_percent=100, spm_percent=50, seed=7):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", text, None, None
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", f"<S>{tail}<P>{head}<M>{middle}", len(head), len(middle)
    return n, "psm", f"<P>{head}<S>{tail}<M>{middle}", len(head), len(middle)


ODD = ["a\n\nb\n", "\n", "\n\n\n", "x", "no break at all", "<P>", "a<S", "S><M", "é\n日本\n𝄞𝄞\n", "<", "<S><", "a\r\nb\x0bc\n", " lead\ttail ", "end <M> here"]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_against_plain_version(spark, edge_docs, unit):
    base = edge_docs.unionByName(spark.createDataFrame([(1000 + 50 * k + j, t, None, None, None, None, None) for k, t in enumerate(ODD) for j in range(9)], edge_docs.schema))
    for share, spm in ((100, 50), (60, 20)):
        done = fim.fill_in_middle(base, unit=unit, fim_percent=share, spm_percent=spm)
        rows = done.withColumn("back", fim.restored(F.col("_fim_output"), F.col("_fim_form"))).collect()
        assert len(rows) == base.count() and done.columns[: len(base.columns)] == base.columns
        for r in rows:
            assert (r._fim_n, r._fim_form, r._fim_output, r._fim_prefix_chars, r._fim_middle_chars) == plain(r.doc_id, r.text, unit, share, spm)
            assert r.back == (r.text or "")


def test_clashing_names_and_empty_tables(spark, no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a\nb", "kept", [1, 2])], "doc_id long, text string, `_fim_n` string, `c0` array<int>")
    done = fim.fill_in_middle(docs)
    assert done.columns[4:] == [f"__fim_{c}" for c in ("n", "form", "output", "prefix_chars", "middle_chars")]
    assert done.first()._fim_n == "kept" and done.first().c0 == [1, 2]
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=("<P>", "><", "<M>"))
    with pytest.raises(ValueError):
        fim.boundaries(np.zeros(1, np.uint32), np.array([0, 1]), "page")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n<é日𝄞\x00", max_size=12), max_size=6))
def test_boundaries_and_encoding(texts):
    points, offsets = fim.decode(pa.array(texts, pa.string()))
    assert fim.encode(points, offsets).to_pylist() == texts
    for unit, pattern in (("line", UNITS["line"]), ("char", UNITS["char"])):
        at, first = fim.boundaries(points, offsets, unit)
        for k, t in enumerate(texts):
            own = (at[first[k] : first[k + 1]] - offsets[k]).tolist()
            ends = [m.end() for m in re.finditer(pattern, t)]
            assert own == [0, *ends]
