"""Further queries of the registry: sources, filters, signals and rules one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import fixed, text, urls
from auditlake.operators import findings, robots, selection, sitemaps
from auditlake.operators.store import fresh_path
from auditlake.sources import html, tables

from . import catalog, crawl, engagement, freshness, render, report, structured
from .catalog import _FETCH_SQL, _FINDINGS_SQL, _U, as_of, derived_findings, fetch_log, parsed_pages, product_parsed, query, read, robots_bodies, url_rows, values


def pages_of(spark, *rows):
    """Parsed pages of inline (page_id, url, html) rows."""
    made = spark.createDataFrame(list(rows), "page_id long, url string, html string")
    own = report.with_sites(made).select("page_id", "site", "ord", "url", F.col("html").alias("raw"), "html")
    return html.parse(own).withColumnRenamed("raw", "html")


def long_bodies(pages):
    """(page_id, body): of every 500th page a body of 4,000 times its html, written out no further than the first repeat beyond what is read."""
    enough = F.ceil(F.lit(tables.BODY_BYTES) / F.greatest(F.octet_length("html"), F.lit(1))) + 1
    times = F.when(F.col("page_id") % 500 == 0, F.least(F.lit(4000), enough)).otherwise(1).cast("int")
    return pages.select("page_id", F.repeat("html", times).alias("body"))


# --- sources and sinks --------------------------------------------------------------------------

query("src_audit_robots", "SELECT * FROM (VALUES ('a', 'enforced'), ('b', 'unavailable-allow'), ('c', 'unavailable-fail-closed'), ('d', 'unavailable-fail-closed'), ('e', 'unavailable-allow')) t(site, policy)")(
    lambda spark, sf: robots.policy(values(spark, "('a', 200, 'x'), ('b', 404, ''), ('c', 503, ''), ('d', null, ''), ('e', 403, '')", "site, status, body")).select("site", "policy"))
query("src_html_raw", "SELECT page_id, length(html) > 0 AS has_html, contains(html, '<article') AS has_article FROM pages")(
    lambda spark, sf: parsed_pages(spark, sf).select("page_id", (F.length("html") > 0).alias("has_html"), F.col("page.has_article").alias("has_article")))
query("src_body_cap", "SELECT page_id, least(strlen(html) * CASE WHEN page_id % 500 = 0 THEN 4000 ELSE 1 END, 3000000)::BIGINT AS n FROM pages WHERE html IS NOT NULL")(
    lambda spark, sf: long_bodies(read(spark, sf, "pages").filter("html is not null")).select("page_id", F.octet_length(tables.first_bytes(F.col("body"))).cast("long").alias("n")))
query("src_ref_json", "SELECT * FROM (VALUES ('search_bot', 10), ('training_bot', 12)) t(category, n)")(
    lambda spark, sf: robots.bots(spark).groupBy("category").agg(F.count("*").cast("int").alias("n")))
query("src_engagement", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY page_id) = 1")(
    lambda spark, sf: read(spark, sf, "pages").groupBy(urls.defrag(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id")).select("page_id", "url"))
query("sink_report_json", f"WITH {_FINDINGS_SQL} SELECT site, count(*) AS n, min(id) AS least_id FROM collapsed GROUP BY site")(
    lambda spark, sf: (lambda found: findings.report(found, found.select("site").distinct().withColumn("audited_at", F.lit("2026-09-13T00:00:00Z")).withColumn("pages_audited", F.lit(1))))(derived_findings(spark, sf))
    .select("site", F.from_json(F.to_json(F.struct("summary", "findings")), "summary struct<total_findings: bigint>, findings array<struct<id: string>>").alias("r"))
    .select("site", F.col("r.summary.total_findings").alias("n"), F.array_min("r.findings.id").alias("least_id")))
@query("src_json_files", "SELECT page_id, url, 200 AS status_code, strlen(html)::BIGINT AS size, last_modified IS NULL AS unset FROM (SELECT *, NULL AS last_modified FROM pages)")
def _(spark, sf):
    # the pages, written as JSON lines into the shared folder and read back by the reader of that kind
    path = fresh_path(spark)
    read(spark, sf, "pages").select("page_id", "url", F.lit(200).alias("status_code"), "html").write.json(path)
    return tables.read_json(spark, path, "pages", lines=True).select("page_id", "url", "status_code", F.octet_length("html").cast("long").alias("size"), F.col("last_modified").isNull().alias("unset"))


# --- filters and predicates ---------------------------------------------------------------------

_RESPONSES = "(1, 200, 'text/html'), (2, 200, ''), (3, 404, 'text/html'), (4, 200, 'image/png'), (5, 204, 'text/html'), (6, 200, 'application/xhtml+xml')"
query("flt_content_page", "SELECT * FROM (VALUES (1), (2), (6)) t(k)")(
    lambda spark, sf: report.content(values(spark, _RESPONSES, "k, status_code, content_type")).select("k"))
query("flt_content_page_eg", "SELECT * FROM (VALUES (1), (2), (5), (6)) t(k)")(
    lambda spark, sf: values(spark, _RESPONSES, "k, s, c").filter(engagement.fetch_status(F.col("s"), F.col("c"), F.lit("<p>x"), F.lit(9999)) == "success").select("k"))
query("flt_render_page", "SELECT * FROM (VALUES (1)) t(page_id)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", "<p role='x'>ok"), (2, "https://a/2", "<p role>bad")).filter(~F.col("page.render_failed")).select(F.col("page_id").cast("int").alias("page_id")))
query("prd_minimal_org", "SELECT * FROM (VALUES (1, true), (2, false)) t(page_id, minimal)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", '<script type="application/ld+json">{"@type":"Organization","name":"N","@id":"i","logo":""}</script>'), (2, "https://a/2", '<script type="application/ld+json">{"@type":"Organization","name":"N","logo":"l"}</script>'))
    .select(F.col("page_id").cast("int").alias("page_id"), structured.is_minimal_organization(F.element_at(structured.entities(), 1)).alias("minimal")))

# --- joins --------------------------------------------------------------------------------------

query("join_raw_rendered", "SELECT * FROM (VALUES (1, 'RE-01-jsgap'), (1, 'RE-03-ajax')) t(page_id, check_id)")(
    lambda spark, sf: render.compile_findings(pages_of(spark, (1, "https://a/1", "<main>" + "w " * 300 + "</main>"), (2, "https://a/2", "<main>" + "w " * 300 + "</main>")), spark.createDataFrame([("https://a/1", 90, "x", 600, [], 0)], "url string, js_text_length long, js_preview string, ajax_delta long, shadow array<struct<tag: string, length: long>>, load_more long"))
    .select(F.substring_index("url", "/", -1).cast("int").alias("page_id"), "check_id"))
query("join_entity_registry", "SELECT p_partkey AS page_id, t AS type FROM part, (VALUES ('Product'), ('Offer'), ('AggregateRating')) x(t) WHERE p_partkey % 7 <> 0")(
    lambda spark, sf: product_parsed(spark, sf).select("page_id", F.explode(F.flatten(F.transform(structured.entities(), lambda e: e["types"]))).alias("type")).join(F.broadcast(spark.createDataFrame([(t[0],) for t in fixed.SCHEMA_TYPES], "type string")), "type"))
query("join_selected_reachable", "SELECT * FROM (VALUES ('u1')) t(url)")(
    lambda spark, sf: selection.reachable(values(spark, "('u1'), ('u2'), ('u3')", "url"), values(spark, "('u1', 200), ('u2', 404)", "url, status_code")))
query("join_page_host", f"WITH {_U} SELECT url FROM p WHERE host IN ('x.example', 'www.x.example')")(
    lambda spark, sf: url_rows(spark, sf).join(F.broadcast(values(spark, "('x.example')", "site")), urls.registered_host(F.col("url")) == F.col("site")).select("url"))
query("join_signatures", "SELECT * FROM (VALUES (1, 'akamai', 'Body contains ''_abck'''), (2, 'cloudflare', 'Title contains ''attention required''')) t(k, provider, signal)")(
    lambda spark, sf: values(spark, "(1, 'x _abck g-recaptcha'), (2, '<title>Attention Required!</title>'), (3, 'fine')", "k, body").select("k", crawl.challenge(F.col("body"), F.create_map(F.lit("server"), F.lit(""), F.lit("cf-ray"), F.lit("")), F.lit(200)).alias("c")).filter("c.detected").select("k", "c.provider", "c.signal"))
query("join_spa", "SELECT * FROM (VALUES (1, 'React,Next.js'), (2, 'Angular'), (3, '')) t(k, found)")(
    lambda spark, sf: values(spark, "(1, '<script id=__NEXT_DATA__></script><div data-reactroot>', array('/_next/static/a.js')), (2, '<app ng-version=1>', array()), (3, '<p>x', array('main.js'))", "k, h, s").select("k", F.array_join(F.transform(render.frameworks(F.col("h"), F.col("s").cast("array<string>")), lambda f: f["framework"]), ",").alias("found")))
query("join_destinations", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(k, found)")(
    lambda spark, sf: values(spark, "(1, 'Our Products', '/x'), (2, 'Productsy', '/helper'), (3, 'x', '/docs/a')", "k, t, h").select("k", engagement._destination(F.array(F.struct(F.col("t").alias("text"), F.col("h").alias("href"))), fixed.OFFER_OR_SUPPORT).alias("found")))
query("join_canonical_target", "SELECT * FROM (VALUES ('CA-10-canonical-404'), ('CA-10-canonical-offsite'), ('CA-10-canonical-mismatch')) t(check_id)")(
    lambda spark, sf: crawl.page_rules(
        values(spark, "(1, 'https://a/1', 'https://a/x'), (2, 'https://a/2', 'https://b/2'), (3, 'https://a/3', 'https://a/y'), (4, 'https://a/4', 'https://a/4')", "ord, url, canonical_href")
        .join(values(spark, "('https://a/x', 404)", "canonical_href, canonical_status"), "canonical_href", "left")
        .select(F.lit("a").alias("site"), "ord", "url", F.lit(False).alias("skipped"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("is_soft_404"), F.lit("").alias("soft_404_rule"), F.lit(0).alias("redirect_chain_length"), F.lit("").alias("meta_robots"), F.lit("").alias("x_robots_tag"), "canonical_href", urls.canonical_match(F.col("canonical_href"), F.col("url")).alias("canonical_matches"), "canonical_status", F.lit(1.0).alias("ttfb_ms"), F.struct(F.lit(False).alias("detected"), F.lit("").alias("provider"), F.lit("").alias("signal")).alias("challenge"), F.lit("x").alias("hsts_header"))
    ).select("check_id"))


def _offer_page(price, code, state, rating, body):
    ld = f'{{"@context":"https://schema.org","@type":"Product","name":"Chair","offers":{{"@type":"Offer","price":"{price}","priceCurrency":"{code}","availability":"https://schema.org/{state}"}},"aggregateRating":{{"@type":"AggregateRating","ratingValue":"{rating}","ratingCount":3}}}}'
    return f'<script type="application/ld+json">{ld}</script><body>{body}</body>'


_CROSS = (
    (1, "https://a/1", _offer_page("10.00", "USD", "InStock", "4.5", "Only 10 USD, in stock, rated 4.5")),
    (2, "https://a/2", _offer_page("12.00", "USD", "InStock", "4.5", "€25.00")),
    (3, "https://a/3", _offer_page("25.00", "EUR", "InStock", "4.9", "€25.00, sold out, 4.5 stars")),
)
query("join_offer_visible", "SELECT * FROM (VALUES (2, 'SD-07-offer-price-consistency'), (2, 'SD-07-offer-currency-consistency'), (3, 'SD-07-offer-availability-consistency')) t(page_id, check_id)")(
    lambda spark, sf: structured.cross_rules(pages_of(spark, *_CROSS)).filter("check_id like 'SD-07-offer%'").select(F.substring_index("url", "/", -1).cast("int").alias("page_id"), "check_id"))
query("join_rating_visible", "SELECT * FROM (VALUES (3, 'SD-07-rating-consistency')) t(page_id, check_id)")(
    lambda spark, sf: structured.cross_rules(pages_of(spark, *_CROSS)).filter("check_id like 'SD-07-rating%'").select(F.substring_index("url", "/", -1).cast("int").alias("page_id"), "check_id"))
query("html_visible_cues", "SELECT * FROM (VALUES (1, '10 USD', 'USD', 'in stock', '4.5'), (2, '€25.00', 'EUR', '', ''), (3, '€25.00', 'EUR', 'sold out', '4.5')) t(page_id, prices, currencies, availability, ratings)")(
    lambda spark, sf: pages_of(spark, *_CROSS).select(F.col("page_id").cast("int").alias("page_id"), *[F.array_join(v, "|").alias(k) for k, v in structured.visible_cues(F.col("page.body_text")).items() if k != "dates"]))

# --- aggregations and windows -------------------------------------------------------------------

query("agg_hsts_missing", f"WITH {_FETCH_SQL} SELECT site, arg_min(url, event_id) AS url, count(*) || ' page(s) without HSTS' AS observed FROM fetched WHERE error IS NULL AND hsts IS NULL GROUP BY site")(
    lambda spark, sf: crawl.page_rules(fetch_log(spark, sf)).filter("check_id = 'CA-13-hsts'").select("site", "url", "observed"))
query("agg_blocked_bots", "SELECT * FROM (VALUES ('b', 'chatgpt-user')) t(site, bots)")(
    lambda spark, sf: robots.analysis(values(spark, "('b', 'User-agent: ChatGPT-User\\nDisallow: /')", "site, body")).select("site", F.array_join("search_blocked", ", ").alias("bots")))
query("agg_bot_paths", "SELECT * FROM (VALUES ('Blocked crawler/path pairs: bingbot: /docs, /pricing')) t(observed)")(
    lambda spark, sf: crawl.robots_rules(robots.analysis(spark.createDataFrame([("s", "User-agent: bingbot\nDisallow: /pricing\nDisallow: /docs\nDisallow: /search")], "site string, body string")).withColumn("robots_url", F.lit("r"))).filter("check_id = 'CA-02-critpath'").select("observed"))
query("agg_text_ratio", "SELECT * FROM (VALUES (1, 17, 9, 7, 0.529)) t(page_id, full_length, main_length, boilerplate_length, ratio)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", "<title>no</title><nav>menu bar</nav><main>the text.</main><script>x</script>".replace("menu bar", "menubar"))).select(F.col("page_id").cast("int").alias("page_id"), *[v.alias(k) for k, v in render.text_ratio().items() if k != "main_identified"]))
query("agg_cta_counts", "SELECT * FROM (VALUES (1, 4, 2, 1)) t(page_id, ctas, ctas_generic, ctas_acting)")(
    lambda spark, sf: engagement.extract(pages_of(spark, (1, "https://a/1", "<a href=/a>Learn more</a><a href=/b>Buy now</a><button>Go</button><a class=btn>x</a><a href=/c>plain</a>")).withColumn("at", F.col("url"))).select(F.col("ord").cast("int").alias("page_id"), *[F.col(c).cast("int").alias(c) for c in ("ctas", "ctas_generic", "ctas_acting")]))
query("agg_perf_counts", "SELECT * FROM (VALUES (1, 1, 1, 2, 2, 3, 1, 1)) t(page_id, blocking_scripts, stylesheets, third_parties, images_bare, images, images_later, images_eager)")(
    lambda spark, sf: engagement.extract(pages_of(spark, (1, "https://a.example/1", "<head><script src=https://cdn.example/a.js></script><script async src=/b.js></script><script type=module src=/c.js></script><link rel=stylesheet href=https://f.example/x.css></head><img src=/1><img src=/2 width=1 height=1><img src=https://s.a.example/3>")).withColumn("at", F.col("url")))
    .select(F.col("ord").cast("int").alias("page_id"), *[F.col(c).cast("int").alias(c) for c in ("blocking_scripts", "stylesheets", "third_parties", "images_bare", "images", "images_later", "images_eager")]))
query("win_section_diversity", "SELECT * FROM (VALUES ('https://a/blog/1', 1), ('https://a/news/1', 2), ('https://a/blog/2', 3)) t(url, place)")(
    lambda spark, sf: selection.ranked(values(spark, "('https://a/blog/1'), ('https://a/blog/2'), ('https://a/news/1')", "url").withColumn("site", F.lit("a"))).select("url", F.col("place").cast("int").alias("place")))
query("win_longest_match", "SELECT * FROM (VALUES ('/a/b', true), ('/a/b/c', false), ('/x', false)) t(path, blocked)")(
    lambda spark, sf: robots.blocked(*robots.tables(spark.createDataFrame([("s", "User-agent: *\nDisallow: /a\nAllow: /a/b/c\nDisallow: /a/b/*$\nAllow: /x\nDisallow: /x")], "site string, body string"))[:2], values(spark, "('anybot')", "bot"), values(spark, "('/a/b'), ('/a/b/c'), ('/x')", "path")).select("path", "blocked"))
query("win_freshest_date", "SELECT * FROM (VALUES (1, 'meta:date', '2024-05-06'), (2, 'visible_text', 'March 3, 2025'), (3, NULL, NULL)) t(page_id, source, raw)")(
    lambda spark, sf: freshness.date_signals(pages_of(spark, (1, "https://a/1", '<meta name=date content="2024-05-06"><body>on 2024-05-06</body>'), (2, "https://a/2", '<meta name=date content="2024-05-06"><body>March 3, 2025</body>'), (3, "https://a/3", "<body>x</body>"))).select(F.col("page_id").cast("int").alias("page_id"), "freshest.source", "freshest.raw"))
query("json_date_signals", "SELECT * FROM (VALUES (1, 'schema:datePublished,schema:dateModified')) t(page_id, sources)")(
    lambda spark, sf: freshness.date_signals(pages_of(spark, (1, "https://a/1", '<script type="application/ld+json">{"@type":"Article","datePublished":"2024-01-02","dateModified":"2024-02-03T00:00:00Z","x":1}</script>'))).select(F.col("page_id").cast("int").alias("page_id"), F.array_join(F.transform("dates", lambda d: d["source"]), ",").alias("sources")))
query("win_nav_baseline", "SELECT * FROM (VALUES ('EG-01-nav-consistency', 'https://a.example/2')) t(check_id, url)")(
    lambda spark, sf: engagement.site_rules(engagement.extract(pages_of(spark, *[(i, f"https://a.example/{i}", "<nav>" + "".join(f"<a href=/{n}>{n}</a>" for n in names) + "</nav>") for i, names in enumerate([("a", "b"), ("a", "b"), ("c", "d"), ("e", "f")])]).withColumn("at", F.col("url")))).filter("check_id = 'EG-01-nav-consistency'").select("check_id", "url"))
query("win_profile_argmax", "SELECT * FROM (VALUES (1, 'editorial'), (2, 'documentation')) t(k, kind)")(
    lambda spark, sf: values(spark, "(1, 'blog docs', false), (2, 'docs shop', false)", "k, hints, article").select("k", engagement.profile(F.col("hints"), F.col("article"))[0].alias("kind")))

# --- samples, sets, scalars ---------------------------------------------------------------------

query("limit_samples", f"WITH {_FINDINGS_SQL} SELECT site, skill, severity, title, action, string_agg(url, ',' ORDER BY seen) AS urls FROM urlranks WHERE r <= 5 GROUP BY ALL")(
    lambda spark, sf: (lambda d: d.groupBy("site", "skill", "severity", "title", "action", "url").agg(F.min("seq").alias("seen")).groupBy("site", "skill", "severity", "title", "action").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seen", "url"))), lambda x: x["url"]), 1, 5), ",").alias("urls")))(findings.dedupe(derived_findings(spark, sf))))
query("trunc_text", "SELECT doc_id, substr(text, 1, 300) AS head FROM documents")(
    lambda spark, sf: read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 300).alias("head")))
query("set_union_skills", f"WITH {_FINDINGS_SQL} SELECT skill, count(*) AS n, min(seq) AS first_seq FROM made GROUP BY skill")(
    lambda spark, sf: _union([derived_findings(spark, sf).filter(F.col("skill") == s) for s in list(fixed.SKILL_PREFIXES)[:5]]).groupBy("skill").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")))
query("set_overlap_name", "SELECT * FROM (VALUES (1, true), (2, false)) t(page_id, differs)")(
    lambda spark, sf: (lambda p: p.select("page_id", "url").join(structured.cross_rules(p).filter("title like 'Content discrepancy%'").select("url", F.lit(True).alias("d")), "url", "left").select(F.col("page_id").cast("int").alias("page_id"), F.coalesce("d", F.lit(False)).alias("differs")))(pages_of(spark, *[(i, f"https://a/{i}", f'<title>{t}</title><script type="application/ld+json">{{"@type":"Product","name":"Oak garden table"}}</script><body><h1>x</h1></body>') for i, t in ((1, "Steel lamp"), (2, "Garden table sale"))])))
query("set_disjoint_avail", "SELECT * FROM (VALUES ('instock', 'in stock', true), ('instock', 'sold out', false)) t(state, cue, shared)")(
    lambda spark, sf: values(spark, "('instock', 'in stock'), ('instock', 'sold out')", "state, cue").withColumn("shared", F.arrays_overlap(F.array(*[F.lit(x) for x in fixed.AVAILABILITY_CUES["instock"]]), F.array("cue"))))
query("str_hq", "SELECT * FROM (VALUES ('headquartered in Oslo, Norway. x', 'Oslo, Norway'), ('none', '')) t(body, hq)")(
    lambda spark, sf: values(spark, "('headquartered in Oslo, Norway. x'), ('none')", "body").withColumn("hq", text.headquarters(F.col("body"))))
query("html_og", "SELECT * FROM (VALUES (1, 'og:image,og:title', 'a|b')) t(page_id, keys, images)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", '<meta property="og:title" content="t"><meta property="OG:image" content="a"><meta name="og:image" content=" b ">')).select(F.col("page_id").cast("int").alias("page_id"), F.array_join(F.array_sort(F.map_keys(structured.tag_values("og:"))), ",").alias("keys"), F.array_join(structured.tag_values("og:")["og:image"], "|").alias("images")))
query("html_twitter", "SELECT * FROM (VALUES (1, 'twitter:card')) t(page_id, keys)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", '<meta name="twitter:card" content="summary"><meta name="x" content="y">')).select(F.col("page_id").cast("int").alias("page_id"), F.array_join(F.map_keys(structured.tag_values("twitter:")), ",").alias("keys")))
query("html_css_content", "SELECT * FROM (VALUES ('p:after{content: \"New offer\"} q{content:\"x\"} i{content:''normal''}', 'New offer')) t(css, texts)")(
    lambda spark, sf: values(spark, "('p:after{content: \"New offer\"} q{content:\"x\"} i{content:\\'normal\\'}')", "css").withColumn("texts", F.array_join(render.css_texts(F.col("css")), "|")))
query("html_icon_font", "SELECT * FROM (VALUES ('material-icons big', 'material_icons'), ('default', 'font_awesome'), ('x', NULL)) t(class, library)")(
    lambda spark, sf: values(spark, "('material-icons big'), ('default'), ('x')", "class").withColumn("library", render.icon_library(F.col("class"))))
query("html_decorative", "SELECT * FROM (VALUES (1, true), (2, true), (3, false)) t(k, flag)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", "<img role=presentation src=a>"), (2, "https://a/2", "<img width=1 height=1 src=a>"), (3, "https://a/3", "<img src=a.jpg width=500>")).select(F.col("page_id").cast("int").alias("k"), render.is_decorative(F.element_at("page.images", 1)).alias("flag")))
query("html_site_search", "SELECT page_id, contains(lower(html), 'type=\"search\"') AS has_search FROM pages")(
    lambda spark, sf: parsed_pages(spark, sf).select("page_id", (F.col("page.search.inputs") > 0).alias("has_search")))
query("html_spa_shell", "SELECT * FROM (VALUES (1, 'high')) t(page_id, severity)")(
    lambda spark, sf: render.compile_findings(pages_of(spark, (1, "https://a/1", "<script src=/a.js></script><div id=root></div>"), (2, "https://a/2", "<div id=root>" + "w " * 200 + "</div>"))).filter("check_id = 'RE-02-shell'").select(F.substring_index("url", "/", -1).cast("int").alias("page_id"), "severity"))
query("html_context_retention", "SELECT * FROM (VALUES (1, true), (2, true), (3, false)) t(k, retains)")(
    lambda spark, sf: engagement.extract(pages_of(spark, (1, "https://a/1", "<a href=/w>Wishlist</a>"), (2, "https://a/2", "<script>localStorage.x=1</script>"), (3, "https://a/3", "<a href=/x>y</a>")).withColumn("at", F.col("url"))).select(F.col("ord").cast("int").alias("k"), "retains"))
query("json_context_valid", "SELECT * FROM (VALUES (1, 1), (2, 0), (3, 0)) t(page_id, n)")(
    lambda spark, sf: (lambda p: p.select("page_id", "url").join(structured.validity_rules(p, as_of()).filter("title like 'Invalid or non-Schema%'").groupBy("url").count(), "url", "left").select(F.col("page_id").cast("int").alias("page_id"), F.coalesce("count", F.lit(0)).cast("int").alias("n")))(pages_of(spark, *[(i, f"https://a/{i}", f'<script type="application/ld+json">{{"@context":{c},"@type":"Thing"}}</script>') for i, c in ((1, '"https://other.org"'), (2, '["x", {"@vocab": "http://schema.org/"}]'), (3, '"http://www.schema.org"'))])))
query("json_entity_data", "SELECT * FROM (VALUES (1, '555', 'https://x.com/a', 'Ann,Bob')) t(page_id, telephone, same_as, leaders)")(
    lambda spark, sf: freshness.entity_data(pages_of(spark, (1, "https://a/1", '<script type="application/ld+json">{"@type":"Organization","name":"N","telephone":"555","sameAs":["https://x.com/a"],"founders":[{"name":"Ann"},"Bob"]}</script>'))).select(F.col("ord").cast("int").alias("page_id"), "telephone", F.array_join("same_as", ",").alias("same_as"), F.array_join("leaders", ",").alias("leaders")))
query("json_ld_entities", "SELECT * FROM (VALUES (1, 'WebPage,Article,Person'), (2, 'Article,Person')) t(page_id, types)")(
    lambda spark, sf: pages_of(spark, (1, "https://a/1", '<script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":"Article","author":[{"@type":"Person"}]}}</script>'), (2, "https://a/2", '<script type="application/ld+json">{"@type":"WebPage","@graph":[{"@type":"Article","author":{"@type":"Person"}}]}</script>')).select(F.col("page_id").cast("int").alias("page_id"), F.array_join(F.flatten(F.transform(structured.entities("loose"), lambda e: e["types"])), ",").alias("types")))
query("graph_sitemap_tree", catalog._SITEMAP_TREE.format(most=7))(lambda spark, sf: sitemaps.expand(*catalog.sitemap_tree(spark, sf), 7))
query("fc_entity_rules", "SELECT * FROM (VALUES ('Core brand claims exist in isolation with no independent corroboration (1 claims)', 'high'), ('External sources report conflicting information for core brand facts', 'medium')) t(title, severity)")(
    lambda spark, sf: freshness.compile_findings(p := pages_of(spark, (1, "https://a.example/", "<title>A</title><body>x</body>")), report.sites_of(p), as_of(), claims=values(spark, "('a.example', 1, 'hq', 'Oslo', 'isolated', ''), ('a.example', 2, 'year', '1999', 'Inconsistent', '2001')", "site, ord, type, value, status, external_value")).filter("title like 'Core brand%' or title like 'External sources%'").select("title", "severity"))
query("ca_sitemap_graph_rules", "SELECT * FROM (VALUES ('CA-05-malformed'), ('CA-05-status'), ('CA-06-depth'), ('CA-06-broken'), ('CA-06-orphans'), ('CA-05-notdeclared'), ('CA-05-duplicates'), ('CA-05-params'), ('CA-05-deadurls')) t(check_id)")(
    lambda spark, sf: crawl.sitemap_rules(
        spark.createDataFrame([("s", "https://s/", "", 1, ["m"], ["u (404)"], False, 2, ["d"], ["/p"], ["?a=..."], [])], "site string, site_root string, robots_url string, n_sitemaps int, first_sitemaps array<string>, dead_urls array<string>, declared boolean, duplicate_count int, duplicate_examples array<string>, param_paths array<string>, param_keys array<string>, errors array<string>"),
        spark.createDataFrame([("s", 0, "m", 200, False, ["e"]), ("s", 1, "n", 503, False, ["e"])], "site string, ord long, url string, status int, xml_valid boolean, errors array<string>"),
    ).unionByName(crawl.graph_rules(spark.createDataFrame([("s", "https://s/", [("u", 4)], [("v", 404)], 3, ["o"], "high")], "site string, site_root string, deep_pages array<struct<url: string, depth: int>>, broken array<struct<url: string, status: int>>, n_orphans int, orphan_urls array<string>, confidence string"))).select("check_id"))


def _union(parts):
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
