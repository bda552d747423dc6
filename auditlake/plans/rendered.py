"""Rendered pages: what a browser's snapshots hold beyond the words of the raw HTML.

A snapshot is one rendering of a page: (url, seq, text, content_length, shadow array<struct<tag, length>>, load_more),
where text is all of the document's text once the network was idle and content_length the length of that text when
the document had loaded. A null text is empty, a null length or count is zero, and of several renderings of a URL
the one with the greatest seq counts (of equal ones, the greatest by its other columns). Rows without a URL take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.sources import html

GAP = " [...] "
LEAST_RUN = 4  # shorter runs are trivial differences
PREVIEW = 1000
CHUNK = 1 << 20  # characters found that leave a task at once


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each URL, by a partial maximum."""
    rest = [c for c in ("seq", "text", "content_length", "shadow", "load_more")]
    return snapshots.filter("url is not null").groupBy("url").agg(F.max(F.struct(*rest)).alias("s")).select("url", "s.*")


def _fresh(known: set[str], shown: list[list[str]]) -> str:
    """Runs of words at consecutive places that are not known, those of at least LEAST_RUN characters, joined by GAP."""
    places = [(place, word) for words in shown for place, word in enumerate(words) if word not in known]
    if len(shown) > 1:
        places.sort()
    runs, last = [], None
    for place, word in places:
        if last is not None and place == last + 1:
            runs[-1].append(word)
        else:
            runs.append([word])
        last = place
    return GAP.join(run for run in map(" ".join, runs) if len(run) >= LEAST_RUN)


def merged(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """(url, has_raw, js_text) for every rendered URL; raw and rendered hold (url, text).

    Each text is shuffled once, by URL, and a task reads its URLs one after the other, raw texts first. Of a URL it holds
    the distinct words of its raw texts, however many these are, and the words of its renderings; no table of words is made.
    """
    side = lambda rows, shown: rows.select("url", F.lit(shown).alias("shown"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    out = T.StructType([rendered.select("url").schema[0], T.StructField("has_raw", T.BooleanType()), T.StructField("js_text", T.StringType())])
    both = side(raw, False).unionByName(side(rendered, True))
    both.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(html.BATCH))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, url, known, shown, any_raw, done, size = None, None, set(), [], False, [], 0
        for batch in batches:
            kind = batch.schema.field("url").type
            for own, is_shown, text in zip(*(batch.column(c).to_pylist() for c in ("url", "shown", "text")), strict=True):
                if own != url:
                    if shown:
                        done.append((url, any_raw, _fresh(known, shown)))
                        size += len(done[-1][2])
                    url, known, shown, any_raw = own, set(), [], False
                    if size > CHUNK or len(done) >= html.BATCH:
                        yield _rows(done, kind)
                        done, size = [], 0
                words = text.split()
                if is_shown:
                    shown.append(words if own is not None else [])
                else:
                    known.update(words)
                    any_raw = own is not None
        if shown:
            done.append((url, any_raw, _fresh(known, shown)))
        if done:
            yield _rows(done, kind)

    return both.repartition("url").sortWithinPartitions("url", "shown").mapInArrow(step, out)


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.bool_(), pa.string()), strict=True)], names=["url", "has_raw", "js_text"])


def text_diff(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """(url, js_text) for every rendered URL; raw and rendered hold (url, text)."""
    return merged(raw, rendered).select("url", "js_text")


def pages(parsed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row a rendered URL, as render.compile_findings takes them; parsed holds (url, page)."""
    last = latest(snapshots)
    diff = text_diff(parsed.select("url", F.col("page.full_text").alias("text")), last)
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return last.join(diff, "url").select(
        "url",
        F.length("js_text").cast("long").alias("js_text_length"),
        F.substring("js_text", 1, PREVIEW).alias("js_preview"),
        (F.length(F.coalesce("text", F.lit(""))) - zero("content_length")).cast("long").alias("ajax_delta"),
        F.coalesce("shadow", F.array().cast("array<struct<tag: string, length: long>>")).cast("array<struct<tag: string, length: long>>").alias("shadow"),
        zero("load_more").alias("load_more"),
    )
