"""The findings contract and the report: ids, dedupe, collapse, order, counts, checks, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import fixed

#: Columns of a findings table. seq gives the input order within a site.
COLUMNS = ("site", "seq", "id", "title", "severity", "skill", "url", "source", "locator", "observed", "expected", "action", "priority")


def _lookup(key: Column, values: dict, default: str) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def finding_id(skill: Column, check_id: Column, locator: Column, url: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", check_id, locator, url).cast("binary"))
    return F.concat(_lookup(skill, fixed.SKILL_PREFIXES, "xx"), F.lit("-"), F.substring(digest, 1, 6))


def priority(severity: Column) -> Column:
    return _lookup(severity, fixed.PRIORITIES, "P3")


def severity_rank(severity: Column) -> Column:
    out = F.lit(99)
    for rank, name in enumerate(fixed.SEVERITIES):
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def make(rows: DataFrame) -> DataFrame:
    """Findings from rows (site, seq, skill, check_id, severity, title, action, url, source, observed[, locator, expected]).

    A severity or source outside the contract raises when the row is evaluated.
    """
    have = set(rows.columns)
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    checked = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {c}: "), F.coalesce(c, F.lit("null")))).cast("string"))
    locator, url = text("locator", ""), text("url", "")
    return rows.select(
        "site",
        F.col("seq").cast("long").alias("seq"),
        finding_id(F.col("skill"), F.col("check_id"), locator, url).alias("id"),
        "title",
        checked("severity", fixed.SEVERITIES).alias("severity"),
        "skill",
        url.alias("url"),
        checked("source", fixed.EVIDENCE_SOURCES).alias("source"),
        locator.alias("locator"),
        text("observed", "").alias("observed"),
        (F.col("expected") if "expected" in have else F.lit(None)).cast("string").alias("expected"),
        "action",
        priority(F.col("severity")).alias("priority"),
    )


def dedupe(findings: DataFrame) -> DataFrame:
    """First finding of each id of a site."""
    order = Window.partitionBy("site", "id").orderBy("seq")
    return findings.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def collapse(findings: DataFrame) -> DataFrame:
    """The same issue on several pages becomes its first finding, which counts the pages and names the first six.

    A partial aggregate keeps, per issue, the first row and each URL's first place; the named pages come from
    a ranked window whose limit Spark pushes below the shuffle, so no list of an issue's pages is held.
    """
    keys = ["site", "skill", "severity", "title", "action"]
    rest = [c for c in COLUMNS if c not in keys]
    urls = findings.filter(F.length("url") > 0).groupBy(*keys, "url").agg(F.min("seq").alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "url"))
    named = urls.withColumn("_r", place).filter("_r <= 6").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("_urls"))
    total = urls.groupBy(*keys).agg(F.count("*").alias("_n"))
    pages = total.join(named.select(*[F.col(k).alias(f"_{k}") for k in keys], "_urls"), [total[k].eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "_n", "_urls")
    first = findings.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("f"))
    null_safe = [first[k].eqNullSafe(pages[k]) for k in keys]
    joined = first.join(pages, null_safe, "left").select(*[first[k] for k in keys], "f", "_n", "_urls")
    shown = F.concat(
        F.array_join(F.slice(F.transform("_urls", lambda u: u["url"]), 1, 6), ", "), F.when(F.col("_n") > 6, F.lit(" …")).otherwise(F.lit(""))
    )
    more = F.concat(F.col("f.observed"), F.lit("  Affects "), F.col("_n").cast("string"), F.lit(" pages: "), shown, F.lit("."))
    out = joined.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest if c != "observed"], F.when(F.col("_n") > 1, more).otherwise(F.col("f.observed")).alias("observed"))
    return out.select(*COLUMNS)


def ordered(findings: DataFrame) -> DataFrame:
    """With `place`: the order of a report, by severity, skill and id."""
    window = Window.partitionBy("site").orderBy(severity_rank(F.col("severity")), "skill", "id")
    return findings.withColumn("place", F.row_number().over(window))


def counts(findings: DataFrame) -> DataFrame:
    each = [F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES]
    return findings.groupBy("site").agg(F.count("*").alias("total_findings"), *each)


def report(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site of `sites` (site, audited_at, pages_audited): counts, findings, proposals."""
    final = ordered(collapse(dedupe(findings)))
    item = F.struct(
        "place", "id", "title", "severity", "skill",
        F.struct("url", "source", "locator", "observed", "expected").alias("evidence"),
        F.struct(F.col("action").alias("summary"), "priority").alias("suggested_action"),
    )
    listed = final.groupBy("site").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    joined = sites.join(counts(final), "site", "left").join(listed, "site", "left").join(proposals(findings, sites), "site", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total_findings", *fixed.SEVERITIES)]
    return joined.select("site", "audited_at", "pages_audited", F.struct(*numbers).alias("summary"), "findings", "proactive_improvements")


def proposals(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """Forward-looking items; the index file is proposed unless a finding says that it is there."""
    has = findings.groupBy("site").agg(F.max(F.contains(F.lower("title"), F.lit("valid /llms.txt"))).alias("_has"))
    item = lambda title, summary: F.struct(F.lit(title).alias("title"), F.lit(summary).alias("summary"), F.lit("P3").alias("priority"))
    index = item("Publish an llms.txt index for AI agents", "Add /llms.txt summarizing the brand, key products, and canonical doc links so AI web agents can orient quickly.")
    always = (
        item("Add FAQPage / HowTo schema where you have Q&A or step content", "Structured Q&A and step markup are directly consumable by AI answer engines and increase citation odds."),
        item("Keep sameAs + Wikidata grounding current", "Maintain sameAs links and a Wikidata item so assistants disambiguate the brand and trust its facts."),
    )
    joined = sites.select("site").distinct().join(has, "site", "left")
    return joined.select("site", F.when(F.coalesce("_has", F.lit(False)), F.array(*always)).otherwise(F.array(index, *always)).alias("proactive_improvements"))


def violations(findings: DataFrame, summary: DataFrame, audited: DataFrame) -> DataFrame:
    """What breaks the report contract: (site, rule, detail). No rows: the report is valid.

    V1 shape, V2 unique ids, V3 total, V4 counts by severity, V5 and V6 time in UTC.
    """
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    shape = findings.filter(
        blank("id") | blank("title") | ~F.coalesce(F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)) | blank("action")
        | ~F.coalesce(F.col("priority").isin("P0", "P1", "P2", "P3"), F.lit(False)) | F.col("url").isNull() | F.col("source").isNull() | F.col("observed").isNull()
    ).select("site", F.lit("V1").alias("rule"), F.coalesce("id", F.lit("")).alias("detail"))
    twice = findings.groupBy("site", "id").count().filter("count > 1").select("site", F.lit("V2").alias("rule"), F.col("id").alias("detail"))
    actual = counts(findings)
    both = summary.alias("s").join(actual.alias("a"), "site", "left")
    drift = F.filter(
        F.array(*[
            F.struct(F.lit("V3" if c == "total_findings" else "V4").alias("rule"), F.lit(c).alias("detail"), (F.col(f"s.{c}") != F.coalesce(F.col(f"a.{c}"), F.lit(0))).alias("bad"))
            for c in ("total_findings", *fixed.SEVERITIES)
        ]),
        lambda x: x["bad"],
    )
    counted = both.select("site", F.inline(drift)).select("site", "rule", "detail")
    time = F.col("audited_at")
    readable = F.try_to_timestamp(F.regexp_replace(F.substring(time, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    timed = audited.select(
        "site", F.when(~F.coalesce(readable, F.lit(False)), F.lit("V5")).when(~time.rlike(r"(Z|[+]00:00)$"), F.lit("V6")).alias("rule"), time.alias("detail")
    ).filter("rule is not null")
    return shape.unionByName(twice).unionByName(counted).unionByName(timed)


def skill_totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site", "skill").agg(F.count("*").alias("total_findings"))


def markdown(reports: DataFrame) -> DataFrame:
    """(site, markdown): a report as Markdown text, its findings in order."""
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rows = [
        ("critical", "Immediate blocker for machine discovery or brand safety"),
        ("high", "High impact on AI visibility, citation, or conversion"),
        ("medium", "Material friction in crawling, freshness, or schema depth"),
        ("low", "Quality hygiene, minor schema, or edge optimization"),
        ("info", "Informational observation or positive verification"),
    ]
    table = [
        line(f"| **{s.capitalize()}** | ", F.col(f"summary.{s}").cast("string"), f" | {fixed.PRIORITIES[s]} | {words} |") for s, words in rows
    ]

    def item(f: Column) -> Column:
        evidence, action = f["evidence"], f["suggested_action"]
        expected = F.when(F.length(evidence["expected"]) > 0, line(" *(Expected: `", evidence["expected"], "`)*")).otherwise(F.lit(""))
        place = F.when(F.length(evidence["locator"]) > 0, evidence["locator"]).otherwise(evidence["source"])
        return F.concat_ws(
            "\n",
            line("### [", F.upper(f["severity"]), " | ", action["priority"], "] ", f["title"]),
            F.lit(""),
            line("- **Severity:** ", F.initcap(f["severity"]), " (`", action["priority"], "`)"),
            line("- **Skill:** `", f["skill"], "`  |  **Finding ID:** `", f["id"], "`"),
            line("- **Target URL:** ", evidence["url"]),
            line("- **Evidence:** `", place, "` - ", evidence["observed"], expected),
            line("- **Remediation:** ", action["summary"]),
            F.lit(""),
        )

    listed = F.coalesce(F.col("findings"), F.array().cast(reports.schema["findings"].dataType))
    found = F.when(F.size(listed) == 0, F.lit("_No findings identified. The audited properties meet baseline criteria._\n")).otherwise(
        F.array_join(F.transform(listed, item), "\n")
    )
    ideas = F.array_join(F.transform("proactive_improvements", lambda p: F.concat_ws("\n", line("#### ", p["title"]), p["summary"], F.lit(""))), "\n")
    return reports.select(
        "site",
        F.concat_ws(
            "\n",
            F.lit("# Site Readiness Audit Report"), F.lit(""),
            line("**Target Site:** `", F.col("site"), "`  "), line("**Audited At:** ", F.col("audited_at"), "  "),
            line("**Pages Audited:** ", F.col("pages_audited").cast("string"), "  "), F.lit(""),
            F.lit("## Executive Summary"), F.lit(""),
            F.lit("| Severity | Findings | Priority | Action Guidance |"), F.lit("| :--- | :---: | :---: | :--- |"),
            *table, line("| **Total** | **", F.col("summary.total_findings").cast("string"), "** | - | - |"), F.lit(""),
            F.lit("## Detailed Findings"), F.lit(""), found,
            F.lit("## Strategic Proactive Opportunities"), F.lit(""), ideas,
        ).alias("markdown"),
    )
