"""Readers and writers: analysis inputs as JSON files, findings and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id long, url string, final_url string, status_code int, content_type string, last_modified string, html string"
ROBOTS = "site string, status int, body string"
SITEMAPS = "sitemap_url string, status int, content string"
CLAIMS = "site string, ord long, type string, value string, status string, external_value string"
SCHEMAS = {"pages": PAGES, "robots": ROBOTS, "sitemaps": SITEMAPS, "claims": CLAIMS}


#: Bytes of a response body that are read.
BODY_BYTES = 3_000_000


def read_json(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """JSON files of one of the kinds of SCHEMAS: a value or an array a file, or with `lines` a value a line.

    Missing fields are null. Files of lines are split among tasks; a file of one value is read by one.
    """
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", not lines).json(path)


def first_bytes(body: Column, most: int = BODY_BYTES) -> Column:
    """The bytes of a body that are read, as binary: no character is looked at."""
    return F.substring(body.cast("binary"), 1, most)


def capped(body: Column, most: int = BODY_BYTES) -> Column:
    """The first `most` bytes of a body; a character that the cap cuts becomes a replacement character."""
    return F.when(F.octet_length(body) <= most, body).otherwise(F.make_valid_utf8(first_bytes(body, most).cast("string")))


def skill_json(findings: DataFrame) -> DataFrame:
    """(site, skill, total_findings, json): the findings of each skill in their order."""
    item = F.struct("seq", "id", "title", "severity", "url", "source", "locator", "observed", "expected", "action", "priority")
    grouped = findings.groupBy("site", "skill").agg(F.count("*").alias("total_findings"), F.array_sort(F.collect_list(item)).alias("findings"))
    return grouped.select("site", "skill", "total_findings", F.to_json(F.struct("skill", "total_findings", "findings")).alias("json"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
