"""Extension: the audit over a stream of fetched pages. Each micro-batch is deduplicated by URL within
a watermark, parsed once, judged by the same stateless rules and appended as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.plans import report


def audit_stream(pages: DataFrame, path: str, checkpoint: str, time_column: str = "fetched_at", delay: str = "1 hour", as_of=None) -> StreamingQuery:
    """Start the query: pages (page_id, url, html, fetched_at) in, Parquet findings with batch_id out.

    A batch is written under its own id, so that a batch repeated after a failure replaces itself. Each batch is
    judged by itself, and as of its newest page unless as_of is given, so that a repeated one gives the same rows.
    """
    unique = pages.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["url"])

    def write(batch: DataFrame, batch_id: int) -> None:
        now = as_of if as_of is not None else F.lit(batch.agg(F.max(time_column)).first()[0]).cast("timestamp")
        found = report.all_findings(report.with_sites(batch), now)
        found.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
