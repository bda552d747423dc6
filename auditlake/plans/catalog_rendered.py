"""Queries over renderings, knowledge bases, claims, folding sections and report documents, all derived from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators import documents, findings
from auditlake.operators.store import spread
from auditlake.sources import html

from . import freshness, render, rendered, report
from .catalog import as_of, query, read


def parse(made: DataFrame, *only: str) -> DataFrame:
    """pages (page_id, url, html) with their site, order and the facts asked for."""
    return html.parse(report.with_sites(made).select("page_id", "site", "ord", "url", "html"), only=only)


def skill_findings(pages: DataFrame, skill: str, inputs: report.Inputs) -> DataFrame:
    """One skill's findings, from the report's own wiring of its inputs."""
    return findings.make(report.skills(report.parse_once(pages), as_of(), inputs)[skill]())


# --- rendered words that the raw text lacks ------------------------------------------------------------


@query("win_text_segments", r"""
WITH d AS (SELECT a.doc_id, a.text AS raw, b.text AS shown FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
said AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(shown, '')), '\s+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split_regex(lower(coalesce(shown, '')), '\s+'), lambda w: w <> ''), 1) AS pos FROM d),
known AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(coalesce(raw, '')), '\s+')) AS word FROM d),
fresh AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM said ANTI JOIN known USING (doc_id, word)),
runs AS (SELECT doc_id, min(pos) AS first, string_agg(word, ' ' ORDER BY pos) AS run FROM fresh GROUP BY doc_id, island),
texts AS (SELECT doc_id, string_agg(run, ' [...] ' ORDER BY first) AS t FROM runs WHERE length(run) > 3 GROUP BY doc_id)
SELECT doc_id, length(coalesce(t, ''))::BIGINT AS js_chars, sha256(coalesce(t, '')) AS js_sha256 FROM d LEFT JOIN texts USING (doc_id)""")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    shown = docs.select((F.col("doc_id") - 1).alias("url"), "text")
    found = rendered.merged(docs.select(F.col("doc_id").alias("url"), "text"), shown).filter("has_raw")
    return found.select(F.col("url").alias("doc_id"), F.length("js_text").cast("long").alias("js_chars"), F.sha2("js_text", 256).alias("js_sha256"))


_RENDERED_SQL = """p AS (SELECT p_partkey AS k, 'https://r' || (p_partkey % 5) || '.example/p/' || p_partkey AS url, p_name AS name FROM part),
r AS (SELECT k, url, (k * 7) % 1000 AS late, k % 90 AS shadow, k % 4 AS more, CASE WHEN k % 2 = 1 THEN 'price' ELSE 'fresh' END || repeat(' js words', k % 40) || ' [...] tail [...] tail' AS js FROM p)"""


def rendered_site(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(pages, snapshots): a page a part, whose last rendering adds words, late text, a shadow tree and buttons by rule."""
    k = F.col("p_partkey").cast("long")
    url = F.concat(F.lit("https://r"), k % 5, F.lit(".example/p/"), k)
    base = spread(read(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    pages = base.select(k.alias("page_id"), url.alias("url"), F.concat(F.lit("<html><head><title>Part "), k, F.lit("</title></head><body><main><p>"), F.col("p_name"), F.lit(" item n"), k, F.lit("</p></main></body></html>")).alias("html"))
    # the words of the title are outside the body, so none of them is said again
    lead = F.when(k % 2 == 1, "price").otherwise("fresh")
    text = F.concat(F.col("p_name"), F.lit(" "), lead, F.repeat(F.lit(" js words"), (k % 40).cast("int")), F.lit(" item tail n"), k, F.lit(" tail"))
    kind = "array<struct<tag: string, length: long>>"
    shadow = F.array(F.struct(F.lit("x-card").alias("tag"), (k % 90).alias("length"))).cast(kind)
    last = base.select(url.alias("url"), F.lit(2).cast("long").alias("seq"), text.alias("text"), (F.length(text) - (k * 7) % 1000).cast("long").alias("content_length"), shadow.alias("shadow"), (k % 4).alias("load_more"))
    older = base.filter(k % 3 == 0).select(url.alias("url"), F.lit(1).cast("long").alias("seq"), F.lit("an older rendering " * 20).alias("text"), F.lit(None).cast("long").alias("content_length"), F.lit(None).cast(kind).alias("shadow"), F.lit(9).cast("long").alias("load_more"))
    return pages, last.unionByName(older)


@query("src_rendered_dom", f"""WITH {_RENDERED_SQL}
SELECT url, length(js)::BIGINT AS js_text_length, js AS js_preview, late AS ajax_delta, shadow, more AS load_more FROM r""")
def _(spark, sf):
    pages, snapshots = rendered_site(spark, sf)
    return rendered.pages(parse(pages, "full_text"), snapshots).withColumn("shadow", F.element_at("shadow", 1)["length"])


@query("src_rendered_set", f"""WITH {_RENDERED_SQL}
SELECT url, 'Content appears only after JavaScript execution' AS title, CASE WHEN k % 2 = 1 AND length(js) >= 200 THEN 'high' ELSE 'medium' END AS severity,
  length(js) || ' chars only in rendered DOM.' || CASE WHEN k % 2 = 1 THEN ' key facts: Pricing / Cost' ELSE '' END || ' e.g. ''' || substr(js, 1, 160) || '''' AS observed FROM r WHERE length(js) > 50
UNION ALL SELECT url, 'Large content block loads late via AJAX', 'medium', late || ' chars arrived after DOMContentLoaded' FROM r WHERE late > 500
UNION ALL SELECT url, 'Key content lives inside Shadow DOM', 'medium', '<x-card> shadowRoot has ' || shadow || ' chars' FROM r WHERE shadow > 50
UNION ALL SELECT url, 'Listing content is gated behind scroll/Load-More', 'medium', '0 static marker(s), ' || more || ' rendered load-more/sentinel element(s)' FROM r WHERE more > 0""")
def _(spark, sf):
    pages, snapshots = rendered_site(spark, sf)
    return skill_findings(report.with_sites(pages), render.SKILL, report.Inputs(snapshots=snapshots)).filter("source = 'rendered_dom'").select("url", "title", "severity", "observed")


# --- tabs and folding sections -----------------------------------------------------------------------


@query("html_tab_accordion", """SELECT p_partkey AS page_id, (k % 4)::BIGINT AS tabs, (k % 3)::BIGINT AS panels, (2 * (k % 2) + k % 6)::BIGINT AS by_class_or_toggle, (2 * (k % 5) + k % 2)::BIGINT AS details,
  (CASE WHEN k % 3 > 0 THEN k % 4 ELSE 0 END)::BIGINT AS resolved, (CASE WHEN k % 3 = 0 THEN k % 4 ELSE 0 END + k % 6)::BIGINT AS dangling FROM (SELECT p_partkey, p_partkey AS k FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey").cast("long")
    some = lambda n, *parts: F.repeat(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), n.cast("int"))
    body = [
        some(k % 4, '<a role="TAB" aria-controls="p', k, '">t</a>'), some(k % 3, '<div role="tabpanel" id="p', k, '" class="tab-pane" aria-hidden="true">x</div>'),
        some(k % 2, '<div class="card Accordion-Item">y</div>'), some(k % 5, "<details open><summary>s</summary>b</details>"),
        some(k % 6, '<button data-toggle="collapse" data-target="#gone">b</button>'), some(k % 2, '<details data-bs-toggle="tab">z</details>'), F.lit('<span data-toggle="tooltip" class="tip">no</span>'),
    ]
    pages = spread(read(spark, sf, "part").select("p_partkey"), "p_partkey").select(k.alias("page_id"), F.concat(F.lit("https://t.example/"), k).alias("url"), F.concat(F.lit("<html><body>"), *body, F.lit("</body></html>")).alias("html"))
    found = parse(pages, "folds").select("page_id", render.folds(F.col("page.folds")).alias("f"))
    of = lambda when: F.size(F.filter("f", when)).cast("long")
    return found.select(
        "page_id", of(lambda x: x["type"] == "tab").alias("tabs"), of(lambda x: x["type"] == "tabpanel").alias("panels"), of(lambda x: x["type"] == "tab_accordion").alias("by_class_or_toggle"), of(lambda x: x["type"] == "details_summary").alias("details"),
        of(lambda x: x["target_tag"].isNotNull()).alias("resolved"), of(lambda x: x["target"].isNotNull() & x["target_tag"].isNull()).alias("dangling"),
    )


# --- knowledge bases: titles and aliases of organisations -----------------------------------------------

_WIKI_SQL = """cand AS (SELECT p_partkey AS c, p_partkey % 50 AS b, p_partkey % 9 AS f FROM part WHERE p_partkey % 5 <> 0),
names AS (SELECT c, 'brand ' || b AS key, 0 AS rank, 'The Brand ' || b || ' Corp' AS title FROM cand WHERE c % 3 = 0
  UNION ALL SELECT c, 'brand ' || b, 1, 'Old name ' || c FROM cand WHERE c % 3 = 2 UNION ALL SELECT c, 'firm ' || f, 1, 'Old name ' || c FROM cand WHERE c % 3 = 2),
w AS (SELECT key, arg_min(title, (rank, title)) AS w_title FROM names WHERE c % 2 = 0 GROUP BY key),
d AS (SELECT key, arg_min('Q' || c, (rank, 'Q' || c)) AS d_qid FROM names WHERE c % 2 = 1 GROUP BY key),
known AS (SELECT key, w_title, d_qid FROM w FULL JOIN d USING (key)),
brands AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN 'Firm ' || (c_custkey % 9) ELSE 'Brand ' || (c_custkey % 60) || ' Inc' END AS brand, CASE WHEN c_custkey % 8 = 0 THEN 'firm ' || (c_custkey % 9) ELSE 'brand ' || (c_custkey % 60) END AS key FROM customer),
grounded AS (SELECT k, brand, CASE WHEN k % 4 = 3 THEN 'Acme Co' ELSE w_title END AS w, CASE WHEN k % 4 = 2 THEN 'Q42' ELSE d_qid END AS q, CASE WHEN k % 4 <> 2 AND d_qid IS NOT NULL THEN 'A software company' END AS said FROM brands LEFT JOIN known USING (key))"""


def candidates(spark, sf) -> DataFrame:
    """Entries of two knowledge bases, one a part: every third goes by an alias, every fifth is no organisation."""
    c = F.col("p_partkey").cast("long")
    named = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return spread(read(spark, sf, "part").select("p_partkey"), "p_partkey", 20_000).select(
        F.when(c % 2 == 0, "wikipedia").otherwise("wikidata").alias("source"),
        F.when(c % 3 == 0, named("The Brand ", c % 50, " Corp")).when(c % 3 == 1, named("Other ", c)).otherwise(named("Old name ", c)).alias("title"),
        F.when(c % 3 == 2, F.array(named("Brand ", c % 50, " Ltd"), named("Firm ", c % 9))).when(c % 3 == 0, F.array().cast("array<string>")).alias("aliases"),
        F.concat(F.lit("Q"), c).alias("qid"),
        F.when(c % 5 == 0, "a river in the north").otherwise("A software company").alias("description"),
    )


def _brand() -> Column:
    k = F.col("c_custkey").cast("long")
    return F.when(k % 8 == 0, F.concat(F.lit("Firm "), k % 9)).otherwise(F.concat(F.lit("Brand "), k % 60, F.lit(" Inc")))


_PROFILES = ((), ("https://www.linkedin.com/x",), ("https://www.linkedin.com/x", "https://www.crunchbase.com/y", "https://www.wikidata.org/wiki/Q42"), ("https://www.linkedin.com/x", "https://en.wikipedia.org/wiki/Acme_Co"))


@query("src_wiki", f"WITH {_WIKI_SQL} SELECT k AS site, w IS NOT NULL AS has_wikipedia, w AS wikipedia_title, q IS NOT NULL AS has_wikidata, q AS qid, said AS description FROM grounded")
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    links = F.element_at(F.array(*[F.array(*map(F.lit, p)).cast("array<string>") for p in _PROFILES]), (k % 4 + 1).cast("int"))
    entity = read(spark, sf, "customer").select(k.alias("site"), _brand().alias("brand"), links.alias("same_as"))
    return freshness.grounding(entity, candidates(spark, sf))


@query("join_wiki_name", f"WITH {_WIKI_SQL} SELECT k AS site, c, rank::BIGINT AS rank FROM brands JOIN names USING (key)")
def _(spark, sf):
    c = F.regexp_extract("qid", r"(\d+)", 1).cast("long")
    named = freshness.name_entries(candidates(spark, sf)).select(c.alias("c"), "key", F.col("rank").cast("long").alias("rank"))
    customers = spread(read(spark, sf, "customer").select("c_custkey"), "c_custkey")
    brands = customers.select(F.col("c_custkey").cast("long").alias("site"), freshness.name_key(_brand()).alias("key"))
    return freshness.by_name(brands, named).select("site", "c", "rank")


# --- freshness and corroboration rules: a site of two pages a customer ------------------------------------

_FC = (
    ("'No sameAs disambiguation links in organization identity schema'", "'medium'", "k % 4 = 0"),
    ("'sameAs markup missing authoritative professional/entity profiles'", "'medium'", "k % 4 IN (1, 3)"),
    ("'Robust entity disambiguation links detected in sameAs schema'", "'info'", "k % 4 = 2"),
    ("'Strong knowledge graph grounding verified on Wikipedia and Wikidata'", "'info'", "w IS NOT NULL AND q IS NOT NULL"),
    ("'Wikidata entity present but no dedicated Wikipedia article found'", "'low'", "w IS NULL AND q IS NOT NULL"),
    ("'No Wikipedia or Wikidata knowledge graph presence found for ''' || brand || ''''", "'low'", "w IS NULL AND q IS NULL"),
    ("'Core brand claims exist in isolation with no independent corroboration (2 claims)'", "'high'", "k % 7 = 0"),
    ("'External sources report conflicting information for core brand facts'", "'medium'", "k % 7 = 1"),
    ("'External corroboration of core claims not yet verified'", "'info'", "k % 7 > 1 AND k % 2 = 0"),
    ("'Incomplete NAP (Name-Address-Phone) markup on https://fc' || k || '.example/'", "'medium'", "k % 3 = 1"),
    ("'Outdated pricing year keywords detected in copy'", "'critical'", "k % 5 = 0"),
    ("'Past calendar events described with future-tense language'", "'high'", "k % 5 = 1"),
    ("'Stale footer copyright year (2019)'", "'medium'", "k % 2 = 1"),
    ("'Broken outbound reference links detected (' || CASE WHEN k % 6 = 0 THEN 3 ELSE 1 END || ' links)'", "CASE WHEN k % 6 = 0 THEN 'medium' ELSE 'low' END", "k % 6 < 2"),
    ("'Commercial pricing page dates exceed 24 months staleness threshold'", "'critical'", "k % 9 = 0"),
    ("'Active temporal freshness signals verified on key pages'", "'info'", "k % 9 = 1"),
    ("'Page timestamps indicate content older than 12 months'", "'high'", "k % 9 = 2"),
    ("'Pricing/product pages lack published or modified date signals'", "'high'", "k % 9 > 2"),
    ("'Key content pages lack temporal metadata signals'", "'medium'", "true"),
    ("'Server does not emit Last-Modified HTTP header'", "'low'", "true"),
)


@query("fc_rules", f"WITH {_WIKI_SQL} " + " UNION ALL ".join(f"SELECT k AS site, {title} AS title, {severity} AS severity FROM grounded WHERE {when}" for title, severity, when in _FC))
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    customers = spread(read(spark, sf, "customer").select("c_custkey"), "c_custkey", 1_000).select(k.alias("k"), _brand().alias("brand"), F.concat(F.lit("https://fc"), k, F.lit(".example")).alias("root"))
    k = F.col("k")
    links = F.element_at(F.array(*[F.lit("[" + ",".join(f'"{u}"' for u in p) + "]") for p in _PROFILES]), (k % 4 + 1).cast("int"))
    extra = F.concat(F.when(k % 3 > 0, ',"telephone":"+1 555 0100"').otherwise(""), F.when(k % 3 == 2, ',"address":"1 Main Street"').otherwise(""), F.when(k % 2 == 0, ',"foundingDate":"1999"').otherwise(""))
    home = F.concat(F.lit('<html><head><title>Home</title><script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"'), "brand", F.lit('","sameAs":'), links, extra, F.lit("}</script></head><body><p>Words.</p></body></html>"))
    dated = F.when(k % 9 == 0, "2023-01-01").when(k % 9 == 1, "2026-09-01").when(k % 9 == 2, "2025-01-01")
    meta = F.coalesce(F.concat(F.lit('<meta property="article:modified_time" content="'), dated, F.lit('">')), F.lit(""))
    copy = F.when(k % 5 == 0, "<p>See our 2023 pricing.</p>").when(k % 5 == 1, "<p>More is coming in 2022.</p>").otherwise("<p>Plans.</p>")
    shop = F.concat(F.lit("<html><head><title>Plans</title>"), meta, F.lit("</head><body>"), copy, F.when(k % 2 == 1, "<footer>© 2019 Firm</footer>").otherwise(""), F.lit("</body></html>"))
    both = F.inline(F.array(F.struct((k * 2).alias("page_id"), F.concat("root", F.lit("/")).alias("url"), home.alias("html")), F.struct((k * 2 + 1).alias("page_id"), F.concat("root", F.lit("/pricing")).alias("url"), shop.alias("html"))))
    pages = report.with_sites(customers.select(both))
    site = F.substring("root", 9, 100).alias("site")
    claim = lambda n, status: F.struct(F.lit(n).alias("ord"), F.lit("founding_year").alias("type"), F.lit("1999").alias("value"), F.lit(status).alias("status"), F.lit("1998").alias("external_value"))
    claims = customers.select(site, F.inline(F.when(k % 7 == 0, F.array(claim(0, "isolated"), claim(1, "isolated"))).when(k % 7 == 1, F.array(claim(0, "inconsistent")))))
    gone = F.struct(F.lit("https://gone.example/").alias("url"), F.lit(404).cast("long").alias("status"))
    dead = customers.filter("k % 6 < 2").select(site, (k * 2 + 1).alias("ord"), F.when(k % 6 == 0, F.array(gone, gone, gone)).otherwise(F.array(gone)).alias("links"))
    found = skill_findings(pages, freshness.SKILL, report.Inputs(candidates=candidates(spark, sf), claims=claims, dead=dead))
    return found.select(F.regexp_extract("site", r"fc(\d+)", 1).cast("long").alias("site"), "title", "severity")


# --- report documents ----------------------------------------------------------------------------------

#: (kind, rule, path) of what document k breaks, by kind k modulo 16; kinds not named hold
_BROKEN = (
    (1, "json", "$"), (2, "required", "$.site"), (3, "type", "$.coverage"), (4, "enum", "$.findings[0].severity"), (5, "required", "$.findings[1].evidence.url"),
    (6, "unique", "$.findings[id=a]"), (7, "time", "$.audited_at"), (8, "minimum", "$.summary.low"), (9, "count", "$.summary.total_findings"), (10, "type", "$.pages_audited"),
    (11, "minLength", "$.findings[0].title"), (12, "type", "$.findings[1]"), (13, "type", "$"), (14, "count", "$.summary.high"), (14, "time", "$.audited_at"),
)


@query("json_schema_validate", "SELECT o_orderkey AS k, rule, path FROM orders JOIN (VALUES " + ", ".join(map(str, _BROKEN)) + ") t(kind, rule, path) ON o_orderkey % 16 = kind")
def _(spark, sf):
    k = F.col("o_orderkey") % 16
    pick = lambda kind, broken, right: F.when(k == kind, F.lit(broken)).otherwise(F.lit(right))
    item = lambda identity, title, severity, url: F.concat(F.lit('{"id":"'), identity, F.lit('","title":"'), title, F.lit('","severity":"'), severity, F.lit('","evidence":{'), url, F.lit('"source":"html","observed":"o"},"suggested_action":{"summary":"s","priority":"P1"}}'))
    first = item(F.lit("a"), pick(11, "", "t"), pick(4, "grave", "high"), F.lit('"url":"u",'))
    second = F.when(k == 12, F.lit("7")).otherwise(item(pick(6, "a", "b"), F.lit("t"), F.lit("low"), pick(5, "", '"url":"u",')))
    at = F.when(k == 7, "soon").when(k == 14, "2026-09-13T00:00:00").otherwise("2026-09-13T00:00:00Z")
    made = F.concat(
        F.lit("{"), pick(2, "", '"site":"s",'), F.lit('"audited_at":"'), at, F.lit('","pages_audited":'), pick(10, "1.5", "1.0"), F.lit(',"coverage":'), pick(3, "[]", "{}"),
        F.lit(',"summary":{"total_findings":'), pick(9, "3", "2"), F.lit(',"critical":0,"medium":0,"high":'), pick(14, "2", "1"), F.lit(',"low":'), pick(8, "-1", "1"), F.lit('},"findings":['), first, F.lit(","), second, F.lit("]}"),
    )
    text = F.when(k == 1, F.lit('{"site":')).when(k == 13, F.lit("[]")).otherwise(made)
    return documents.violations(spread(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 20_000).select(F.col("o_orderkey").alias("k"), text.alias("json")))
