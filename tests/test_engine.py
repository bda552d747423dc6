"""Behaviour on crafted inputs: the contract, the policies, each skill's rules, the report."""

import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.functions import text, urls
from auditlake.operators import findings, robots, sitemaps
from auditlake.plans import crawl, engagement, freshness, render, report, structured
from auditlake.sources import html, tables

def as_of():
    return F.lit("2026-09-13 00:00:00").cast("timestamp")


def page_rows(spark, *pages):
    """(url, html) to pages with site and ord."""
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return report.with_sites(frame)


def parsed(spark, *pages):
    rows = page_rows(spark, *pages)
    return html.parse(rows.select("site", "ord", "url", F.col("html").alias("raw"), "html")).withColumnRenamed("raw", "html")


def found(rows):
    return sorted((r.check_id, r.severity) for r in rows.collect())


def finding(spark, **change):
    row = {"site": "s", "seq": 1, "skill": "crawl-access-audit", "check_id": "CA-01", "severity": "critical", "title": "t", "action": "a", "url": "u", "source": "html", "observed": "o", "locator": "l"} | change
    return spark.createDataFrame([row])


def test_same_finding_has_the_same_id(spark):
    a, b = (findings.make(finding(spark, seq=i)).first() for i in (1, 2))
    assert a.id == b.id and a.id.startswith("ca-") and len(a.id) == 9 and a.priority == "P0"


@pytest.mark.parametrize("change", [{"severity": "SEV?"}, {"source": "not_a_source"}])
def test_values_outside_the_contract_raise(spark, change):
    with pytest.raises(Exception, match="invalid"):
        findings.make(finding(spark, **change)).collect()


def test_same_issue_on_three_pages_is_one(spark):
    rows = finding(spark).unionByName(finding(spark, seq=2, url="u2")).unionByName(finding(spark, seq=3, url="u3"))
    out = findings.collapse(findings.dedupe(findings.make(rows))).collect()
    assert len(out) == 1 and out[0].observed == "o  Affects 3 pages: u, u2, u3." and out[0].url == "u"


def test_more_than_six_pages_are_cut(spark):
    rows = [finding(spark, seq=i, url=f"u{i}") for i in range(8)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    assert findings.collapse(findings.make(whole)).first().observed.endswith("u0, u1, u2, u3, u4, u5 ….")


def test_report_is_valid_and_drift_is_not(spark):
    made = findings.make(finding(spark).unionByName(finding(spark, seq=2, check_id="x", severity="low")))
    good = spark.createDataFrame([("s", "2026-09-13T00:00:00+00:00", 1)], "site string, audited_at string, pages_audited int")
    assert findings.violations(made, findings.counts(made), good).collect() == []
    wrong = findings.counts(made).withColumn("total_findings", F.lit(5)).withColumn("low", F.lit(9))
    rules = [r.rule for r in findings.violations(made.unionByName(made), wrong, good.withColumn("audited_at", F.lit("2026-09-13T00:00:00"))).collect()]
    assert {"V2", "V3", "V4", "V6"} <= set(rules)


def test_markdown_and_json(spark, tmp_path):
    made = findings.make(finding(spark))
    sites = spark.createDataFrame([("s", "2026-09-13T00:00:00Z", 1), ("t", "2026-09-13T00:00:00Z", 0)], "site string, audited_at string, pages_audited int")
    reports = findings.report(made, sites)
    lines = {r.site: r.markdown for r in findings.markdown(reports).collect()}
    assert "### [CRITICAL | P0] t" in lines["s"] and "No findings identified" in lines["t"]
    tables.write_reports(reports, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {r.site: r.summary.total_findings for r in back.collect()} == {"s": 1, "t": 0}
    record = json.loads(tables.skill_json(made).first().json)
    assert record["total_findings"] == 1 and record["findings"][0]["title"] == "t"


def test_json_source(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"page_id": 1, "url": "https://a/", "html": "<p>"}, {"url": "https://b/"}]')
    rows = tables.read_json(spark, str(tmp_path / "p.json"), "pages")
    assert rows.filter("status_code is null").count() == 2 and rows.columns[0] == "page_id"


def test_robots_of_one_search_bot(spark):
    """A bot that is blocked at the root is reported once, not again for each path."""
    body = spark.createDataFrame([("s", "User-agent: ChatGPT-User\nDisallow: /")], "site string, body string")
    row = robots.analysis(body).first()
    assert row.search_blocked == ["chatgpt-user"] and row.critical_blocks == [] and not row.wildcard_disallow_all


def test_robots_grammar(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: c\nCrawl-delay: 3\nDisallow: /y # note\nAllow: /y/ok"
    agents, rules, delays = robots.tables(spark.createDataFrame([("s", body)], "site string, body string"))
    assert {(r.group_id, r.agent) for r in agents.collect()} == {(1, "a"), (1, "b"), (2, "c")}
    assert {(r.group_id, r.kind, r.path) for r in rules.collect()} == {(1, "disallow", "/x"), (2, "disallow", "/y"), (2, "allow", "/y/ok")}
    assert [(r.group_id, r.crawl_delay) for r in delays.collect()] == [(2, 3.0)]


def test_blocked_site_without_sitemap_and_noindex_home(spark):
    body = spark.createDataFrame([("s", "User-agent: *\nDisallow: /")], "site string, body string")
    rows = found(crawl.robots_rules(robots.analysis(body).withColumn("robots_url", F.lit("https://s/robots.txt"))))
    assert ("CA-01-wildcard", "critical") in rows and ("CA-01-searchbots", "critical") in rows
    site = spark.createDataFrame([("s", "https://s/", "", 0, None, 0)], "site string, site_root string, robots_url string, n_sitemaps int, declared boolean, duplicate_count int")
    arrays = ("first_sitemaps", "dead_urls", "duplicate_examples", "param_paths", "param_keys", "errors")
    site = site.select("*", *[F.array().cast("array<string>").alias(a) for a in arrays])
    files = spark.createDataFrame([], "site string, ord long, url string, status int, xml_valid boolean, errors array<string>")
    assert found(crawl.sitemap_rules(site, files)) == [("CA-05-nositemap", "medium")]
    there = site.withColumn("n_sitemaps", F.lit(1)).withColumn("declared", F.lit(True))
    assert found(crawl.sitemap_rules(there, files)) == [("CA-05-declared", "info")]


def test_sitemap_parser_keeps_order_and_reports_errors(spark):
    files = spark.createDataFrame([("a", "﻿<urlset><url><loc>x</loc><loc>y</loc></url></urlset>"), ("b", "oops")], "sitemap_url string, content string")
    rows = {r.sitemap_url: r for r in sitemaps.parse(files).collect()}
    assert rows["a"].entries[0].loc == "y" and rows["b"].kind == "error" and "XML" in rows["b"].xml_error


SHELL = '<html><head><title>App</title><script src="/main.js"></script></head><body><div id="root">Loading the app</div><img src="a.jpg"><img src="b.jpg"><img src="c.jpg" alt=""></body></html>'


def test_shell_page_and_images(spark):
    rows = {r.check_id: r.severity for r in render.compile_findings(parsed(spark, ("https://s.example/", SHELL))).collect()}
    assert rows["RE-02-shell"] == "high" and rows["RE-04-img-alt"] == "high"


def test_render_media_rules(spark):
    body = (
        "<main>" + "words and more words " * 40 + "</main><canvas id='chart1'></canvas><video src='a.mp4'></video><video src='b.mp4'><track kind='captions'></video>"
        "<video autoplay muted loop src='bg.mp4'></video><iframe src='https://other.example/x'></iframe><iframe src='https://youtube.com/x'></iframe><a href='/price.pdf?x=1'>Price list</a>"
        "<i class='material-icons'>home</i><div class='load-more'>x</div><style>p:before{content:'New offer'}</style>"
    )
    rows = {r.check_id: r for r in render.compile_findings(parsed(spark, ("https://s.example/", f"<body>{body}</body>"))).collect()}
    assert {k: v.severity for k, v in rows.items()} == {
        "RE-06-canvas": "high", "RE-07-media": "high", "RE-12-iframe": "medium", "RE-13-infinite": "medium", "RE-09-pseudotext": "low", "RE-08-pdf": "medium",
    }
    assert rows["RE-07-media"].title.startswith("1 ") and rows["RE-12-iframe"].title.startswith("1 ")


def test_rendered_pages(spark):
    pages = parsed(spark, ("https://s.example/", "<body><main>" + "plain words here " * 50 + "</main></body>"))
    dom = spark.createDataFrame([("https://s.example/", 300, "price is $5 today", 900, [("x-card", 80)], 1)], "url string, js_text_length long, js_preview string, ajax_delta long, shadow array<struct<tag: string, length: long>>, load_more long")
    assert found(render.compile_findings(pages, dom)) == [("RE-01-jsgap", "high"), ("RE-03-ajax", "medium"), ("RE-11-shadow", "medium"), ("RE-13-infinite", "medium")]


def test_no_structured_data_is_critical(spark):
    sites = spark.createDataFrame([("s.example", "https://s.example/", False, None, 0)], "site string, site_url string, llms_present boolean, llms_url string, llms_length int")
    rows = structured.compile_findings(parsed(spark, ("https://s.example/", "<title>A long enough title</title><body>x</body>")), sites, as_of()).collect()
    assert {r.check_id for r in rows if r.severity == "critical"} == {"SD-01-zero", "SD-01-home-identity"}
    there = sites.withColumn("llms_present", F.lit(True)).withColumn("llms_length", F.lit(150))
    assert found(structured.llms_rules(there)) == [("SD-06-llms-valid", "info")]


def ld(data):
    return f'<title>T</title><script type="application/ld+json">{json.dumps(data)}</script><body><h1>Big storm hits the coast</h1></body>'


NEWS = [
    {"@context": "https://schema.org", "@type": "NewsMediaOrganization", "name": "Daily", "url": "https://d.example", "sameAs": ["https://x.com/d"]},
    {"@context": "https://schema.org", "@type": "NewsArticle", "headline": "Big storm hits the coast", "datePublished": "2026-09-01T10:00:00Z", "author": {"@type": "Person", "name": "A"},
     "publisher": {"@type": "Organization", "name": "Daily"}, "speakable": {"@type": "SpeakableSpecification", "cssSelector": ["h1"]}},
]


def test_news_site(spark):
    rows = structured.validity_rules(parsed(spark, ("https://d.example/", ld(NEWS))), as_of()).collect()
    checks = {r.check_id for r in rows}
    assert {"SD-02-newsarticle-valid", "SD-02-speakable-valid"} <= checks
    assert not any("Organization" in r.title and "required" in r.title and "NewsMedia" not in r.title for r in rows)


def test_bad_blocks_and_placeholders(spark):
    pages = (
        ("https://a.example/1", '<script type="application/ld+json">{"a": 1,}</script>'),
        ("https://a.example/2", ld({"@type": "Organization", "name": "Acme Corp", "url": "u"})),
        ("https://a.example/3", ld({"@context": "https://other.org", "@graph": [{"@type": "WebSite"}]})),
        ("https://a.example/4", ld({"@context": {"@vocab": "http://schema.org/"}, "@type": "AggregateRating", "ratingValue": "7", "ratingCount": 3})),
    )
    rows = {(r.url[-1], r.check_id) for r in structured.validity_rules(parsed(spark, *pages), as_of()).collect()}
    assert ("1", "Malformed JSON in JSON-LD script block") in rows
    assert {("2", "Missing @context in JSON-LD script block"), ("2", "Placeholder dummy data detected in schema (name)")} <= rows
    assert {("3", "Invalid or non-Schema.org @context in JSON-LD"), ("3", "Missing required properties in WebSite schema")} <= rows
    assert ("4", "SD-02-aggregate-rating-semantic") in rows and not any(k == "4" and "context" in c for k, c in rows)


def test_offer_against_the_page(spark):
    offer = {"@context": "https://schema.org", "@type": "Product", "name": "Red chair", "offers": {"@type": "Offer", "price": "10.00", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}, "aggregateRating": {"@type": "AggregateRating", "ratingValue": "4.9", "ratingCount": 3}}
    page = f'<script type="application/ld+json">{json.dumps(offer)}</script><body><h1>Blue table large</h1><p>Price €25.00, sold out, rated 3.1</p></body>'
    checks = {r.check_id for r in structured.cross_rules(parsed(spark, ("https://a.example/p", page))).collect()}
    assert checks == {
        "Content discrepancy between Schema.org Product name and visible DOM", "SD-07-offer-price-consistency", "SD-07-offer-currency-consistency",
        "SD-07-offer-availability-consistency", "SD-07-rating-consistency",
    }


def test_open_graph_and_titles(spark):
    page = '<title>Home</title><meta property="og:title" content="x"><meta property="og:image" content="/a.png"><meta name="description" content="short"><body></body>'
    titles = {r.title for r in structured.tag_rules(parsed(spark, ("https://a.example/x", page))).collect()}
    assert titles == {
        "Incomplete Open Graph tags: missing og:description, og:url, og:type", "Open Graph image is not an absolute URL",
        "Missing Twitter Card tags (twitter:card, twitter:title, twitter:description)", "Generic boilerplate title tag ('Home')", "Meta description is too short",
    }


def fresh(spark, *pages, last_modified=None):
    rows = parsed(spark, *pages)
    if last_modified:
        rows = rows.withColumn("last_modified", F.lit(last_modified))
    sites = report.sites_of(rows)
    return freshness.compile_findings(rows, sites, as_of()).collect()


def test_short_brand_without_same_as(spark):
    rows = fresh(spark, ("https://ibm.example/", ld({"@type": "Organization", "name": "IBM", "url": "u"})))
    same = [r for r in rows if "sameAs" in r.title]
    assert [(r.check_id, r.severity) for r in same] == [("FC-04-sameas-missing", "medium")] and not any("collision" in r.title for r in rows)


def test_header_date_alone_is_not_fresh(spark):
    rows = fresh(spark, ("https://a.example/x", "<body>text</body>"), last_modified="Sat, 12 Sep 2026 00:00:00 GMT")
    assert not any("Active temporal" in r.title for r in rows)
    rows = fresh(spark, ("https://a.example/x", '<meta property="article:modified_time" content="2026-09-10"><body>text</body>'))
    assert any("Active temporal" in r.title for r in rows)


def test_dated_archive_is_not_stale(spark):
    rows = fresh(spark, ("https://a.example/news/2024/01/01/x", '<meta property="article:published_time" content="2024-01-01"><body>x</body>'))
    assert [r.severity for r in rows if "older than" in r.title] == []
    assert any(r.check_id == "FC-01-archived-editorial" for r in rows)


def test_stale_marks(spark):
    rows = {r.title: r.severity for r in fresh(spark, ("https://a.example/pricing", "<body>See 2022 pricing, coming in 2023. © 2019 Acme. Updated 2023-01-01</body>"))}
    assert rows["Outdated pricing year keywords detected in copy"] == "critical"
    assert rows["Past calendar events described with future-tense language"] == "high"
    assert rows["Stale footer copyright year (2019)"] == "medium"
    assert rows["Commercial pricing page dates exceed 24 months staleness threshold"] == "critical"


def test_claims_and_grounding(spark):
    entity = spark.createDataFrame([("s", "Acme Inc", [], "x")], "site string, brand string, same_as array<string>, y string")
    known = spark.createDataFrame([("wikidata", "ACME", "Q7", "a software company"), ("wikipedia", "Acme (band)", None, "a band")], "source string, title string, qid string, description string")
    row = freshness.grounding(entity, known).first()
    assert (row.has_wikipedia, row.has_wikidata, row.qid) == (False, True, "Q7")


def test_no_engagement_findings_on_blocked_or_failed_pages(spark):
    rows = page_rows(spark, ("https://a.example/", "<title>Just a moment...</title>"))
    assert engagement.compile_findings(rows).collect() == []
    assert engagement.compile_findings(rows.withColumn("status_code", F.lit(403)).withColumn("html", F.lit("<p>x"))).collect() == []


def test_engagement_of_a_bare_page(spark):
    page = "<body>" + "<a href='/a'>learn more</a><a href='/b'>click here</a><a href='/c'>read more</a><a href='/d'>more</a>" + "</body>"
    titles = {r.title for r in engagement.compile_findings(page_rows(spark, ("https://a.example/x", page))).collect()}
    assert {"Mobile viewport metadata is missing", "Pages lack a primary H1 orientation cue", "Calls to action are dominated by generic labels"} <= titles


def test_navigation_that_changes(spark):
    nav = lambda *names: "<nav>" + "".join(f"<a href='/{n}'>{n}</a>" for n in names) + "</nav><h1>x</h1>"
    pages = [("https://a.example/1", nav("one", "two")), ("https://a.example/2", nav("three", "four")), ("https://a.example/3", nav("five", "six")), ("https://a.example/4", nav("one", "two"))]
    rows = {r.title: r for r in engagement.compile_findings(page_rows(spark, *pages)).collect()}
    assert rows["Primary navigation changes substantially across pages"].observed.startswith("Compared with https://a.example/1, 2 page(s)")


def test_safe_addresses(spark):
    rows = spark.createDataFrame([("http://localhost/", False), ("https://h.example:443/", True), ("http://172.20.0.1/", False), ("http://[fd00::1]/", False), ("http://[2606:4700::1]/", True), ("https://h.example:8443/", False)], "u string, ok boolean")
    assert all(r.ok == r.got for r in rows.withColumn("got", urls.is_safe(F.col("u"))).collect())


def test_partitioning_does_not_change_findings(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20)
    got = [sorted(map(str, report.all_findings(report.with_sites(pages.repartition(n)), as_of()).collect())) for n in (1, 7)]
    assert got[0] == got[1] and got[0]


def test_text_helpers(spark):
    row = spark.range(1).select(text.squeeze(F.lit(" a  b\n")).alias("a"), text.headquarters(F.lit("Based in x. headquartered in Oslo, Norway.")).alias("b")).first()
    assert (row.a, row.b) == ("a b", "Oslo, Norway")


def test_stream(spark, sf_dir, tmp_path):
    from auditlake.streaming.incremental import audit_stream

    source = tmp_path / "in"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(6).withColumn("fetched_at", F.lit("2026-09-13 00:00:00").cast("timestamp"))
    pages.unionByName(pages).write.parquet(str(source))
    stream = spark.readStream.schema(pages.schema).parquet(str(source))
    audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), as_of=as_of()).awaitTermination(180)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() > 0 and rows.filter("title = 'Missing meta description tag'").count() == 6


HOSTILE = {
    "links": "<a href=x>" * 100_000, "menus": '<div class="menu">' * 100_000 + "<a href=x>x</a>" * 100, "figures": "<figure><img src=x>" * 100_000 + "<figcaption>c", "headings": "<h1>t" * 25_000,
    "headings deep": "<div><h2>t" * 12_000, "buttons": "<button class=search>x" * 12_000, "headers": "<header class='nav menu'>" * 12_000 + "<a href=y>" * 1000, "templates": "<template>x" * 12_000,
    "unmatched": "<div>" * 25_000 + "</p>" * 25_000, "footers": "<footer><nav>" * 12_000 + "<a href=q.pdf>z" * 8_000, "captions": "<figure><figcaption>x" * 12_000 + "<img>" * 8_000, "comments": "<!--" * 25_000 + "<p>",
    "comments apart": "<!--<p>" * 12_000, "sections": "<![CDATA[<p>" * 12_000, "end tags": "</x" * 25_000, "start tags": "<a " * 25_000, "script": "<script>" + "</" * 25_000, "media": "<video><track><a href=transcript>" * 8_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_parse_is_linear(name):
    page, seconds = HOSTILE[name], []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        assert html.facts("https://x.example/", part)["error"] is None
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 and seconds[1] < 8 * seconds[0] + 1  # four times the page; the square would be sixteen times


def test_unclosed_elements_and_ancestors():
    page = """<header><div class="menu nav"><a href="/1">one<a href="/1">again</div><a href=/h>h</a></header><nav><a href="/1#f">1</a><nav><a href="/2">2 <b>bold</b></nav></nav>
    <footer><nav><a href="/3">3</a></nav></footer><footer><nav><a href="mailto:x">m</a></nav></footer><h1>a<h1>b</h1><template><h1>t</h1></template>
    <figure><figure><img src=i></figure><figcaption>cap</figcaption></figure><script type=x>s < 1</script> tail < 3 <b"""
    found = html.signals("https://x.example/", page)
    of = lambda f: [a[f] for a in found["anchors"]]
    assert of("text") == ["one", "again", "h", "1", "2 bold", "3", "m"]
    assert of("nav") == [0, 0, 0, 1, 2, 0, 1] and of("menu") == [1, 1, 0, 0, 0, 0, 0]
    assert of("header") == [True] * 3 + [False] * 4 and of("footer") == [False] * 5 + [True, False]
    assert of("first") == [True, False, True, False, True, True, False]
    assert of("first_nav") == [False, False, False, True, True, False, False] and of("first_menu") == [True] + [False] * 6
    assert of("first_header") == [True, False, True] + [False] * 4
    assert found["h1"] == ["a", "b", "t"] and found["images"][0]["figcaption"] is None  # the caption stands outside the inner figure
    assert found["full_text"].endswith("cap tail < 3 <b") and found["script_text"] == "s < 1"


def test_hostile_pages(spark):
    """Pages that break careless parsers keep their row; 5,000 media take linear time."""
    import time

    from auditlake.sources import html

    pages = [
        (1, '<a href="http://[x">a</a>'), (2, '<link rel="canonical" href="//[1">'), (3, '<script type="application/ld+json">' + "[" * 50_000 + "</script>"),
        (4, '<script type="application/ld+json">{"@type": "Thing", "name": "\\ud800"}</script>'), (5, '<script type="application/ld+json">{"n": ' + "9" * 5_000 + "}</script>"),
        (6, "<video></video><a href=transcript>t</a>" * 5_000), (7, None), (8, "<div>" * 3_000 + "x"),
    ]
    made = spark.createDataFrame([(k, f"https://s.example/{k}", h) for k, h in pages], "page_id long, url string, html string")
    began = time.perf_counter()
    rows = {r.page_id: r.page for r in html.parse(made).collect()}
    assert time.perf_counter() - began < 30
    assert len(rows) == len(pages) and all(p.error is None for p in rows.values())
    assert rows[1].anchors[0].full == "http://[x" and rows[2].canonical == "//[1"
    assert rows[3].json_ld[0].error
    assert rows[5].json_ld[0].error and rows[4].json_ld[0].error is None
    assert len(rows[6].media) == 5_000 and rows[6].media[0].transcript


def test_a_page_that_cannot_be_parsed_is_reported(spark, monkeypatch):
    from auditlake.sources import html

    found = html.facts("http://[broken", "<a href='x'>x</a>")
    assert found["error"].startswith("ValueError") and found["anchors"] == []
    pages = spark.createDataFrame([(1, "https://s.example/", "<title>Home page of the site</title>"), (2, "https://s.example/x", "<title>Other page</title>")], "page_id long, url string, html string")
    real = report.parse_once
    broken = lambda own: real(own).withColumn("page", F.col("page").withField("error", F.when(F.col("url").endswith("/x"), F.lit("ValueError: no"))))
    monkeypatch.setattr(report, "parse_once", broken)
    _, reports = report.audit(pages, as_of(), "2026-09-13T00:00:00+00:00")
    row = reports.first()
    assert (row.pages_audited, row.coverage.pages_selected, row.coverage.pages_failed) == (1, 2, 1)
    assert row.coverage.errors == ["https://s.example/x: ValueError: no"]
    assert not any(f.evidence.url.endswith("/x") for f in row.findings)


def test_the_audit_runs_every_skill_and_says_what_it_covered(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "https://s.example/", "<title>x</title>"), (2, "https://s.example/login", "x"), (3, "https://s.example/docs/a", "<p>y</p>"), (4, "https://s.example/private", "z")], "page_id long, url string, html string")
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    inputs = report.Inputs(
        robots=table([("s.example", "https://s.example/robots.txt", 200, "User-agent: *\nDisallow: /\nDisallow: /a\\E(b")], "site string, robots_url string, status int, body string"),
        llms=table([("s.example", False, None, 0)], "site string, llms_present boolean, llms_url string, llms_length int"),
        homes=table([("s.example", "https://s.example/")], "site string, home string"),
        listed=table([(u,) for u in ("https://s.example/login", "https://s.example/docs/a", "https://s.example/private")], "url string"),
        blocked=table([("https://s.example/private",)], "url string"),
    )
    found, reports = report.audit(pages, as_of(), "2026-09-13T00:00:00+00:00", inputs)
    row = reports.first()
    assert row.coverage.checks_run == ["crawl-access-audit", "render-extraction-audit", "structured-data-audit", "freshness-corroboration-audit", "engagement-audit"]
    assert (row.coverage.pages_selected, row.coverage.skipped_auth_action, row.coverage.skipped_by_robots) == (2, 1, 1)
    titles = {f.title for f in row.findings}
    assert "robots.txt blocks all crawlers on every path" in titles and "Missing /llms.txt machine-facing summary file" in titles
    # without the file's record nothing is said of it; a skill that fails leaves the others alone
    monkeypatch.setattr(report.render, "compile_findings", lambda parsed: parsed.select(F.raise_error(F.lit("boom")).alias("site")))
    _, reports = report.audit(pages, as_of(), "2026-09-13T00:00:00+00:00")
    row = reports.first()
    assert "Missing /llms.txt machine-facing summary file" not in {f.title for f in row.findings}
    assert row.coverage.incomplete == ["render-extraction-audit"] and len(row.coverage.errors) == 1
    assert row.summary.total_findings == len(row.findings) > 0


def test_addresses(spark):
    urls_of = lambda f, *given: [r[0] for r in spark.createDataFrame([(u,) for u in given], "url string").select(f(F.col("url"))).collect()]
    closed = ("http://2130706433/", "http://127.1/", "http://0x7f000001/", "http://0177.0.0.1/", "http://a.localhost/", "http://localhost./", "http://999.1.1.1/", "http://127.0.0.1./")
    assert not any(urls_of(urls.is_safe, *closed))
    assert all(urls_of(urls.is_safe, "http://93.184.216.34/", "https://1password.com/", "https://3.example/"))
    assert urls_of(urls.normalize, "https://a.example/p?a=100%&b=1", "https://a.example/p?b=1") == ["https://a.example/p?a=100%25&b=1", "https://a.example/p?b=1"]


def test_the_issue_of_many_pages_names_six(spark):
    rows = [("s", i, "c", "low", "t", "a", f"https://s.example/{i}", "html", "o", "crawl-access-audit") for i in range(5_000)]
    made = findings.make(spark.createDataFrame(rows, "site string, seq long, check_id string, severity string, title string, action string, url string, source string, observed string, skill string"))
    row = findings.collapse(made).first()
    assert row.observed == "o  Affects 5000 pages: " + ", ".join(f"https://s.example/{i}" for i in range(6)) + " …."
    plan = findings.collapse(made)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dates_without_an_offset_are_utc(spark):
    given_dates = ("2026-01-02", "2026-01-02T03:04:05", "January 2, 2026", "2 Jan 2026", "2026-01-02T03:04:05+02:00", "Fri, 02 Jan 2026 03:04:05 GMT")
    rows = spark.createDataFrame([(d,) for d in given_dates], "d string")
    seconds = lambda: [tuple(r) for r in rows.select(F.unix_timestamp(text.parse_date(F.col("d"))), F.unix_timestamp(text.parse_lastmod(F.col("d")))).collect()]
    utc, zone = seconds(), spark.conf.get("spark.sql.session.timeZone")
    assert utc[0][0] == 1767312000 and utc[1][0] == utc[5][0] == 1767323045
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert seconds() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_parse_gives_the_facts_asked_for(spark):
    """Chosen facts are those of the whole parse, and no others are made."""
    page = '<html><head><title>T</title><link rel="canonical" href="/c"></head><body><h1>H</h1><script type="application/ld+json">{"@type":"A","name":"\\ud83d"}</script></body></html>'
    made = spark.createDataFrame([("https://x.example/", page)], "url string, html string")
    whole, few = html.parse(made).first().page.asDict(), html.parse(made, only=("title", "canonical", "json_ld")).first().page.asDict()
    assert few == {k: whole[k] for k in ("title", "canonical", "error", "json_ld")} and few["title"] == "T" and few["json_ld"][0]["entities"][0]["types"] == ["A"]


def test_small_tables_are_dealt_out_before_the_parse(spark):
    """A table of one small file is not one task of the parse."""
    from auditlake.plans import catalog

    sf = "/root/testdata/sf0.1"
    for pages in (catalog.crafted_pages(spark, sf, "h1"), catalog.product_parsed(spark, sf), catalog.sized_pages(spark, sf)):
        assert pages.rdd.getNumPartitions() >= 7


def test_rules_of_two_phases_take_one_parse(spark):
    from auditlake.plans import catalog

    found = structured.validity_rules(catalog.product_parsed(spark, "/root/testdata/sf0.001"), as_of())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.count() == found.select("seq").distinct().count()


def test_distinct_values_are_counted_without_a_list(spark):
    """Sites without a value count zero; a value of many pages counts once; null is no value."""
    rows = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["y", None]), ("b", 1, []), ("c", 1, None)], "site string, ord long, products array<string>")
    assert {tuple(r) for r in freshness.count_values(rows, "products").collect()} == {("a", 2), ("b", 0), ("c", 0)}


def page_query(spark, tmp_path, name, rows):
    """A query and its SQL over a pages table of these (page_id, url, html)."""
    import duckdb
    from auditlake.plans import catalog
    from oracle import compare

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    return compare(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])


def test_title_with_a_reference_cut_short(spark, tmp_path):
    rows = [(k, "https://x.example/", f"<html><title>{t}</title><body>x</body></html>") for k, t in enumerate(("a &amp;&amp", "&amp;lt;", "b &lt;i&gt; &#x27;", " c ", ""))]
    assert page_query(spark, tmp_path, "html_meta", rows) is None


def test_title_with_quotation_marks_as_its_sql_gives_it(spark, tmp_path):
    rows = [(k, "https://x.example/", f"<html><title>{t}</title><body>x</body></html>") for k, t in enumerate(("token = &quot;0b&quot;", "&amp;quot;", 'a "plain" one', "&quot"))]
    assert page_query(spark, tmp_path, "html_meta", rows) is None


def test_references_of_a_title_as_written(spark):
    made = spark.createDataFrame([("&quot;a&quot; &amp;amp &amp",)], "t string").select(text.plain_references(F.col("t")).alias("t"))
    assert made.first().t == '"a" &amp &amp'


def test_body_cap_within_a_character_and_of_long_pages(spark, tmp_path):
    """The cap cuts a character, and 4,000 times the second page pass what a string may hold."""
    rows = [(500, "https://x.example/", "aé" + "b" * 4), (1000, "https://x.example/", "é" * 300_000), (1500, "https://x.example/", ""), (7, "https://x.example/", "é")]
    assert page_query(spark, tmp_path, "src_body_cap", rows) is None
    cut = spark.createDataFrame([("aéé",)], "b string").select(tables.capped(F.col("b"), 4).alias("c")).first().c
    assert cut == "aé\ufffd"


def test_a_parsing_worker_is_given_few_pages_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pages = spark.range(0, 1_000, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.lit("<p>x</p>").alias("html"))
    parsed = html.parse(pages, only=("title",))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    found = [r.n for r in parsed.select("page_id").mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 1_000 and max(found) <= html.BATCH
