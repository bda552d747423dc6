"""Freshness and corroboration: dates, staleness, entity, grounding, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import fixed, text as words, urls

from .rules import affected, emit, rule, text
from .structured import by_severity, entities, has_type, value

SKILL = "freshness-corroboration-audit"
_IDENTITIES = {"NewsMediaOrganization": 50, "Corporation": 45, "LocalBusiness": 45, "Organization": 30, "WebSite": 15}
_WEIGHTS = {"name": 8, "url": 8, "sameAs": 10, "logo": 3, "description": 2, "contactPoint": 2, "address": 2}
_ORGANIZATION_WORDS = (
    "company", "corporation", "organisation", "organization", "business", "publisher", "newspaper", "news agency", "media", "brand",
    "enterprise", "software", "manufacturer", "nonprofit", "non-profit", "institution", "conglomerate", "retailer", "airline", "bank",
    "university", "foundation",
)


def dated(source: Column, raw: Column) -> Column:
    return F.struct(source.alias("source"), raw.alias("raw"), words.parse_date(raw).alias("at"))


def date_signals(pages: DataFrame) -> DataFrame:
    """Pages with `dates` (source, raw, at) of header, meta tags, schema and text, and the freshest of them (first on a tie)."""
    have = "last_modified" in pages.columns
    header = F.col("last_modified") if have else F.lit(None).cast("string")
    key = lambda m: F.lower(F.trim(F.coalesce(F.nullif(m["name"], F.lit("")), m["property"], F.lit(""))))
    metas = F.filter("page.metas", lambda m: key(m).isin(*fixed.META_DATES) & (m["content"] != ""))
    of_meta = F.transform(metas, lambda m: dated(F.concat(F.lit("meta:"), key(m)), m["content"]))
    props = F.array(*[F.lit(p) for p in fixed.SCHEMA_DATES])
    of_schema = F.flatten(F.transform(entities("loose"), lambda e: F.transform(
        F.filter(e["strings"], lambda s: F.array_contains(props, s["key"]) & (s["value"] != "")), lambda s: dated(F.concat(F.lit("schema:"), s["key"]), s["value"])
    )))
    of_text = F.transform(words.visible_dates(F.col("page.body_text")), lambda d: dated(F.lit("visible_text"), d))
    of_header = F.when(header.isNotNull(), F.array(dated(F.lit("header:last-modified"), header))).otherwise(F.array().cast("array<struct<source: string, raw: string, at: timestamp>>"))
    known = F.filter(F.concat(of_header, of_meta, of_schema, of_text), lambda d: d["at"].isNotNull())
    with_dates = pages.withColumn("dates", known).withColumn("has_header", header.isNotNull())
    top = F.array_max(F.transform("dates", lambda d: d["at"]))
    return with_dates.withColumn("freshest", F.try_element_at(F.filter("dates", lambda d: d["at"] == top), F.lit(1)))


def staleness(body: Column, as_of: Column) -> dict[str, Column]:
    year = words.copyright_year(body)
    return {
        "pricing": words.present(body, fixed.OUTDATED_PRICING),
        "future": words.present(body, fixed.FUTURE_PAST),
        "copyright": F.when(year < F.year(as_of) - 1, year),
    }


def link_budget(links: DataFrame, per_page: int = 4, per_site: int = 8) -> DataFrame:
    """Outbound links (site, ord, pos, link) to check: the first of each page, each once, the first of each site."""
    first = links.groupBy("site", "ord", "link").agg(F.min("pos").alias("pos"))
    on_page = first.withColumn("r", F.row_number().over(Window.partitionBy("site", "ord").orderBy("pos"))).filter(F.col("r") <= per_page)
    once = on_page.groupBy("site", "link").agg(F.min(F.struct("ord", "r")).alias("at"))
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter(F.col("k") <= per_site)
    return ranked.select("site", "at.ord", "link", F.col("k").alias("place"))


def outbound(pages: DataFrame) -> DataFrame:
    own = F.lower(urls.netloc(F.col("url")))
    links = pages.select("site", "ord", F.posexplode("page.anchors").alias("pos", "a"), own.alias("own")).select("site", "ord", "pos", F.col("a.href").alias("link"), "own")
    other = F.lower(urls.netloc(F.col("link")))
    return links.filter(F.col("link").startswith("http") & (other != "") & (other != F.col("own"))).drop("own")


def identity_score(e: Column) -> Column:
    """Specificity of the type, completeness, and a penalty for a bare reference."""
    kind = F.greatest(F.lit(0), *[F.when(F.array_contains(e["types"], t), w).otherwise(0) for t, w in _IDENTITIES.items()])
    filled = F.lit(0)
    for key, weight in _WEIGHTS.items():
        filled = filled + F.when(F.array_contains(e["filled"], key), weight).otherwise(0)
    rest = F.array_except(e["filled"], F.array(*[F.lit(k) for k in ("@type", "@context", "@id", "name")]))
    return kind + filled - F.when(F.size(rest) == 0, 18).otherwise(0)


def entity_data(pages: DataFrame) -> DataFrame:
    """Per page: brand, sameAs links, telephone, address, founding year, headquarters, products, leaders."""
    own = F.filter(entities("loose"), lambda e: has_type(e, *_IDENTITIES))
    named = F.filter(own, lambda e: F.length(F.trim(value(e, "name"))) > 0)
    best = F.array_max(F.transform(named, identity_score))
    primary = F.trim(value(F.try_element_at(F.filter(named, lambda e: identity_score(e) == best), F.lit(1)), "name"))
    site_name = F.try_element_at(F.filter("page.metas", lambda m: m["property"] == "og:site_name"), F.lit(1))["content"]
    title = F.nullif(words.brand_from_title(F.col("page.title")), F.lit(""))
    fallback = F.initcap(F.substring_index(F.replace(F.lower(urls.netloc(F.col("url"))), F.lit("www."), F.lit("")), ".", 1))
    brand = F.coalesce(F.nullif(primary, F.lit("")), F.nullif(site_name, F.lit("")), title, fallback)
    listed = lambda t: F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<string>"))
    last = lambda key: F.try_element_at(F.array_compact(F.transform(F.filter(own, lambda e: F.array_contains(e["filled"], key)), lambda e: value(e, key))), F.lit(-1))
    products = F.filter(entities("loose"), lambda e: has_type(e, "Product"))
    leader = lambda e, k: F.when(value(e, k).startswith("{"), F.array(value(e, f"{k}.name"))).when(value(e, k).startswith("["), F.transform(F.from_json(value(e, k), "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))).otherwise(F.array().cast("array<string>"))
    body = F.col("page.body_text")
    return pages.select(
        "site", "ord", "url", brand.alias("brand"),
        F.array_distinct(F.flatten(F.transform(own, lambda e: listed(value(e, "sameAs"))))).alias("same_as"),
        last("telephone").alias("telephone"), last("address").alias("address"),
        F.coalesce(last("foundingDate"), F.nullif(words.founding_year(body), F.lit(""))).alias("founding_year"),
        F.nullif(words.headquarters(body), F.lit("")).alias("hq"),
        F.array_distinct(F.array_compact(F.transform(products, lambda e: value(e, "name")))).alias("products"),
        F.array_compact(F.flatten(F.transform(own, lambda e: F.concat(*[leader(e, k) for k in ("founder", "founders", "employee", "alumni")])))).alias("leaders"),
    )


def _values(data: DataFrame, column: str) -> DataFrame:
    """(site, v, at): each distinct value of a site's pages, with its first place."""
    return data.select("site", "ord", F.posexplode(column).alias("pos", "v")).groupBy("site", "v").agg(F.min(F.struct("ord", "pos")).alias("at"))


def count_values(data: DataFrame, column: str) -> DataFrame:
    """(site, n) of every site of entity_data rows: the distinct values of one of its lists, which no row gathers.

    Two sums: values stand once a site after the first, so that a site with very many is spread over all tasks. A
    page is parsed once: its site counts by a row without a value.
    """
    each = data.select("site", F.explode_outer(column).alias("v")).groupBy("site", "v").agg(F.lit(1).alias("one"))
    return each.groupBy("site").agg(F.count("v").alias("n"))


def site_entity(data: DataFrame) -> DataFrame:
    """Per site: the first page's brand, the first year and place, the links, products and leaders of all pages.

    A list holds a site's distinct values, in the order of their first pages; each page's values meet
    those of others only as partial aggregates of (site, value).
    """
    scalar = data.groupBy("site").agg(
        F.min_by("brand", "ord").alias("brand"),
        F.min_by("founding_year", F.when(F.col("founding_year").isNotNull(), F.col("ord"))).alias("founding_year"),
        F.min_by("hq", F.when(F.col("hq").isNotNull(), F.col("ord"))).alias("hq"),
    )
    out = scalar
    for column in ("same_as", "products", "leaders"):
        listed = _values(data, column).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(column))
        out = out.join(listed, "site", "left")
    empty = F.array().cast("array<string>")
    return out.select("site", "brand", "founding_year", "hq", *[F.coalesce(c, empty).alias(c) for c in ("same_as", "products", "leaders")])


def looks_like_organization(description: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.coalesce(description, F.lit("")), r"<[^>]+>", " "))
    return urls.contains_any(plain, _ORGANIZATION_WORDS) & ~F.contains(plain, F.lit("disambiguation page"))


def name_key(name: Column) -> Column:
    """The form under which names are equal: normalised, without a leading article; may be empty."""
    return F.regexp_replace(words.normalize_name(name), r"^the\s+", "")


def name_entries(candidates: DataFrame) -> DataFrame:
    """(key, rank, source, title, qid, description): a row for each name of an entry; rank 0 is its title, 1 an alias.

    candidates: (source, title, qid, description[, aliases array<string>]); entries that do not describe an
    organisation are left out.
    """
    aliases = F.col("aliases") if "aliases" in candidates.columns else F.array().cast("array<string>")
    named = F.concat(F.array("title"), F.coalesce(aliases, F.array().cast("array<string>")))
    good = candidates.filter(looks_like_organization(F.col("description")))
    keyed = good.select("source", "title", "qid", "description", F.posexplode(named).alias("place", "name"))
    return keyed.select(name_key(F.col("name")).alias("key"), F.least("place", F.lit(1)).alias("rank"), "source", "title", "qid", "description").filter("key <> ''")


#: Blocks of a key's entries at most: a named row is sent as often.
BLOCKS = 256


def by_name(named: DataFrame, entries: DataFrame, block: int = 1_000) -> DataFrame:
    """named (key, ...) beside each row of entries (key, ...) of its key: a row a pair, none left out.

    A key's entries stand in blocks of about `block`, larger ones beyond BLOCKS, and a named row meets each block of its
    key once, so that the pairs of a key that very many share are dealt to as many tasks as it has blocks, and none holds
    more than one of them. Rows of keys that the other side lacks are not sent. A task gives a block's entries over and
    over for its named rows, few blocks in all, which keeps the files of the pairs short.
    """
    count = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias(name))
    both = count(named, "_n").join(count(entries, "_m"), "key")
    sizes = both.select("key", F.least(F.ceil(F.col("_m") / block), F.lit(BLOCKS)).cast("long").alias("_blocks"))
    pairs = both.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0
    tasks = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2_000, int(pairs / 1e7)))
    rest = [c for c in entries.columns if c != "key"]
    blocks = entries.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64(*rest), "_blocks").alias("_block")).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    asked = named.join(sizes, "key").select(*named.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    dealt = lambda rows: rows.repartition(tasks, "key", "_block")
    return dealt(asked).hint("merge").join(dealt(blocks), ["key", "_block"]).select(*named.columns, F.inline("_rows"))


def alias_index(candidates: DataFrame) -> DataFrame:
    """(key, w_title, d struct<rank, qid, description>): for each key of a title or alias, its best entries.

    Titles go before aliases, then the smallest title, or the smallest QID with its description. Both are minima,
    combined before the shuffle, so that a name that many entries share is one row.
    """
    return name_entries(candidates).groupBy("key").agg(
        F.min(F.when(F.col("source") == "wikipedia", F.struct("rank", "title")))["title"].alias("w_title"),
        F.min(F.when(F.col("source") == "wikidata", F.struct("rank", "qid", "description"))).alias("d"),
    )


def grounding(entity: DataFrame, candidates: DataFrame) -> DataFrame:
    """(site, has_wikipedia, wikipedia_title, has_wikidata, qid, description): from sameAs links, else by name or alias.

    Each key of the index is one row, so a brand that very many sites bear meets one row in a skewed join, which
    adaptive execution splits.
    """
    index = alias_index(candidates)
    by_name = entity.select("site", name_key(F.col("brand")).alias("key")).filter("key <> ''").join(index, "key").drop("key")
    link = lambda part: F.try_element_at(F.filter("same_as", lambda s: F.contains(s, F.lit(part))), F.lit(-1))
    wiki, data = link("wikipedia.org/wiki/"), link("wikidata.org/wiki/Q")
    joined = entity.join(by_name, "site", "left")
    return joined.select(
        "site",
        F.coalesce(F.replace(F.substring_index(wiki, "/wiki/", -1), F.lit("_"), F.lit(" ")), F.col("w_title")).alias("wikipedia_title"),
        F.coalesce(F.nullif(F.regexp_extract(data, r"(Q\d+)", 1), F.lit("")), F.col("d.qid")).alias("qid"),
        F.when(data.isNull(), F.col("d.description")).alias("description"),
    ).select("site", F.col("wikipedia_title").isNotNull().alias("has_wikipedia"), "wikipedia_title", F.col("qid").isNotNull().alias("has_wikidata"), "qid", "description")


def corroboration_templates(entity: DataFrame) -> DataFrame:
    """(site, ord, claim_type, claim_value, search_query, target_sources): one to seven queries a brand."""
    brand = F.col("brand")
    item = lambda kind, v, query, target: F.struct(F.lit(kind).alias("claim_type"), v.cast("string").alias("claim_value"), query.alias("search_query"), F.lit(target).alias("target_sources"))
    none, q = F.lit(None), F.concat(F.lit('"'), brand, F.lit('"'))
    year = F.col("founding_year")
    items = F.concat(
        F.array(item("brand_identity", brand, F.concat(q, F.lit(' "company" OR "about"')), "Corporate registries, Crunchbase, Bloomberg")),
        F.array(F.when(F.length(year) > 0, item("founding_year", year, F.concat(q, F.lit(' "founded" OR "established" "'), year, F.lit('"')), "News articles, industry profiles, Wikidata"))
                .otherwise(item("founding_year", none, F.concat(q, F.lit(' "founded" OR "established in"')), "Business registries, Wikipedia, Crunchbase"))),
        F.array(F.when(F.length("hq") > 0, item("hq_location", F.col("hq"), F.concat(q, F.lit(' headquarters "'), F.col("hq"), F.lit('"')), "Corporate directory, Google Maps, Crunchbase"))),
        F.transform(F.slice("products", 1, 2), lambda p: item("flagship_product", p, F.concat(q, F.lit(' "'), p, F.lit('" review OR pricing')), "G2, Capterra, TechCrunch, product reviews")),
        F.transform(F.slice("leaders", 1, 2), lambda p: item("leadership", p, F.concat(q, F.lit(' "'), p, F.lit('" CEO OR founder')), "LinkedIn, Forbes, Reuters, executive bios")),
    )
    return entity.filter(F.length("brand") > 0).select("site", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("ord", "t")).select("site", "ord", "t.*")


def date_rules(dates: DataFrame, sites: DataFrame, as_of: Column) -> DataFrame:
    """Site-level rules over date_signals rows; sites (site, site_url)."""
    c = F.col
    months = words.age_months(c("freshest.at"), as_of)
    year = F.year(as_of)
    use, shop, ever = ~urls.is_utility_freshness(c("url")), urls.is_commercial_freshness(c("url")), urls.is_evergreen(c("url"))
    base = dates.withColumn("months", months).withColumn("use", use).withColumn("shop", shop).withColumn("has", F.size("dates") > 0)
    archived = urls.is_archived_editorial(c("url"), c("months"), year)
    undated_archive = urls.is_archived_editorial(c("url"), F.lit(None).cast("double"), year)
    on, old = c("use"), F.coalesce(c("months"), F.lit(-1.0))
    aged = on & c("has") & ~(c("shop") & (old >= 24)) & (old >= 12) & ~ever
    source = F.substring_index("freshest.source", ":", 1)
    ago = F.floor("months").cast("long")
    tests = {
        "critical": (on & c("has") & c("shop") & (old >= 24), text(c("url"), " (", c("freshest.raw"), ", ~", ago, " mos ago)"), F.lit(0)),
        "shop": (on & ~c("has") & ~ever & ~undated_archive & c("shop"), c("url"), F.lit(0)),
        "other": (on & ~c("has") & ~ever & ~undated_archive & ~c("shop"), F.lit(""), F.lit(0)),
        "stale": (aged & ~archived, text(c("url"), " (~", ago, " mos)"), c("shop").cast("int")),
        "archive": (aged & archived, F.lit(""), F.lit(0)),
        "fresh": (on & c("has") & (old <= 1) & source.isin("meta", "schema", "visible_text"), F.lit(""), F.lit(0)),
        "headless": (on & ~c("has_header"), F.lit(""), F.lit(0)),
    }
    found = affected(base, tests).join(base.groupBy("site").agg(F.count("*").alias("pages")), "site").join(sites.select("site", "site_url"), "site", "left").withColumn("ord", F.lit(0))
    n = c("n")
    more = F.when(n > 1, F.concat(F.lit(" (affected: "), F.array_join("urls", ", "), F.when(n > 6, F.lit(" …")).otherwise(F.lit("")), F.lit(")"))).otherwise(F.lit(""))
    all_of = F.concat(F.array_join("details", "; "), F.when(n > 6, F.lit("; …")).otherwise(F.lit("")))
    first = F.element_at("urls", 1)
    is_ = lambda name: c("name") == name
    r = lambda when, sev, title, action, observed, check=None, url=first: rule(check or title, when, sev, title, action, observed=observed, url=url)
    rules = [
        r(is_("critical"), "critical", "Commercial pricing page dates exceed 24 months staleness threshold", "Update visible 'last updated' text and add dateModified schema with current timestamp to confirm pricing accuracy.", text("Pricing or commercial page(s) exhibit timestamps over 24 months old: ", all_of, ". AI shopping assistants and citation engines treat outdated pricing as untrustworthy or quote obsolete tier amounts.", more)),
        r(is_("shop"), "high", "Pricing/product pages lack published or modified date signals", "Add dateModified in JSON-LD and include a visible 'Last updated' stamp in page headers or footers.", text("The commercial page(s) ", F.array_join("details", ", "), F.when(n > 6, ", …"), " contain no Last-Modified HTTP header, meta dates, Schema.org dateModified, or visible timestamp. AI models cannot evaluate whether pricing and terms are current.", more)),
        r(is_("other"), "medium", "Key content pages lack temporal metadata signals", "Implement datePublished and dateModified schema across key editorial and documentation pages.", text(n, " page(s) have no published or modified date signals. AI search systems (e.g., Perplexity, Google SGE) require freshness cues for recency weighting.", more)),
        r(is_("stale"), F.when(c("top") > 0, "high").otherwise("medium"), "Page timestamps indicate content older than 12 months", "Review and re-verify page claims, then refresh dateModified timestamps upon content review.", text("Content on ", n, " page(s) was last modified more than 12 months ago: ", F.array_join(F.slice("details", 1, 4), ", "), ". May lead AI assistants to classify facts as dated.", more)),
        r(is_("archive"), "info", "Historical editorial archive dates detected", "Preserve original publication dates; use dateModified only when archived content is substantively corrected.", text("Detected ", n, " news/blog page(s) older than the archival threshold. Their publication age is expected and is not treated as an active-content freshness defect.", more), "FC-01-archived-editorial"),
        r(is_("headless") & (n == c("pages")), "low", "Server does not emit Last-Modified HTTP header", "Configure web server or CDN (Cloudflare, Fastly, CloudFront) to include Last-Modified headers on HTML responses.", "Web server does not provide Last-Modified HTTP headers on audited responses. Prevents crawlers from utilizing conditional GET requests (If-Modified-Since) to detect updates efficiently.", url=c("site_url")),
        r(is_("fresh"), "info", "Active temporal freshness signals verified on key pages", "Maintain regular update cadence and keep dateModified timestamps synchronized with changes.", text("Recent timestamps (<30 days) successfully detected on ", n, " page(s).", F.when(n > 1, F.concat(F.lit(" (affected: "), F.array_join(F.slice("urls", 1, 5), ", "), F.lit(")"))))),
    ]
    # the rules' order is that of the tests, one row each
    place = F.coalesce(*[F.when(is_(name), i) for i, name in enumerate(("critical", "shop", "other", "stale", "archive", "headless", "fresh"))])
    return emit(found.withColumn("ord", place), SKILL, rules, 0)


def stale_rules(dates: DataFrame, dead: DataFrame | None, as_of: Column) -> DataFrame:
    """Page-level staleness; dead (site, ord, links array<struct<url, status>>)."""
    c = F.col
    base = dates.filter(~urls.is_utility_freshness(c("url")))
    marks = staleness(c("page.body_text"), as_of)
    base = base.select("*", *[v.alias(f"_{k}") for k, v in marks.items()], words.age_months(c("freshest.at"), as_of).alias("_months"))
    if dead is None:
        base = base.withColumn("_dead", F.array().cast("array<struct<url: string, status: long>>"))
    else:
        base = base.join(dead.select("site", "ord", F.col("links").alias("_dead")), ["site", "ord"], "left")
    archive, shop = urls.is_archived_editorial(c("url"), c("_months"), F.year(as_of)), urls.is_commercial_freshness(c("url"))
    behind, url = F.year(as_of) - c("_copyright"), c("url")
    join = lambda a: F.array_join(a, ", ")
    links = F.size("_dead")
    sample = F.array_join(F.transform(F.slice("_dead", 1, 3), lambda d: F.concat(d["url"], F.lit(" (status: "), d["status"].cast("string"), F.lit(")"))), "; ")
    r = lambda when, sev, title, action, observed: rule(title, when, sev, title, action, observed=observed)
    rules = [
        r(F.size("_pricing") > 0, F.when(archive, "low").when(shop, "critical").otherwise("high"), F.when(archive, "Historical pricing references detected in archived editorial copy").otherwise("Outdated pricing year keywords detected in copy"), "Remove outdated year designations from pricing copy and affirm current pricing schedule.", text("Page copy on ", url, " contains historical pricing phrasing: ", join("_pricing"), ". AI models quoting this page will identify prices as dated or inaccurate.")),
        r(F.size("_future") > 0, F.when(archive, "low").otherwise("high"), F.when(archive, "Historical future-tense event copy retained in archive").otherwise("Past calendar events described with future-tense language"), "Update copy to past tense or replace with current upcoming roadmap milestones.", text("Page copy on ", url, " references historical years using future-tense phrasing: ", join("_future"), ". Indicates unmaintained copy that degrades AI confidence scoring.")),
        r(c("_copyright").isNotNull(), F.when(archive, "low").when(behind >= 2, "medium").otherwise("low"), text("Stale footer copyright year (", c("_copyright"), ")"), text("Update copyright year notice to ", F.year(as_of), " or utilize dynamic current-year templating."), text("Footer on ", url, " states copyright ", c("_copyright"), ", which is ", behind, " year(s) behind the current year (", F.year(as_of), "). Signals site maintenance neglect to crawlers.")),
        r(links > 0, F.when(archive, "low").when(links >= 3, "medium").otherwise("low"), text("Broken outbound reference links detected (", links, " links)"), "Fix or remove dead outbound links, replacing them with updated authoritative destinations.", text("Page ", url, " contains dead outbound hyperlinks: ", sample, ". AI models following citations detect dead-end references and reduce authority ratings.")),
    ]
    return emit(base, SKILL, rules, 1)


def entity_rules(sites: DataFrame, data: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """sites: site_entity joined with site_url, grounding and n_templates; data: entity_data; claims (site, ord, type, value, status, external_value)."""
    c = F.col
    at = {"url": c("site_url")}
    base = sites.withColumn("ord", F.lit(0))
    if claims is None:
        told = base.withColumn("isolated", F.array().cast("array<string>")).withColumn("inconsistent", F.array().cast("array<string>")).withColumn("n_claims", F.lit(0))
    else:
        said = lambda s, v: F.transform(F.array_sort(F.collect_list(F.when(F.lower("status") == s, F.struct("ord", v.alias("t"))))), lambda x: x["t"])
        grouped = claims.groupBy("site").agg(
            said("isolated", text(c("type"), ": '", c("value"), "'")).alias("isolated"),
            said("inconsistent", text(c("type"), ": site says '", c("value"), "', external sources say '", c("external_value"), "'")).alias("inconsistent"),
            F.count("*").alias("n_claims"),
        )
        told = base.join(grouped, "site", "left")
    n_claims = F.coalesce(c("n_claims"), F.lit(0))
    kinds = F.array_compact(F.array(
        F.when(F.length("founding_year") > 0, text("founding year (", c("founding_year"), ")")), F.when(F.length("hq") > 0, text("headquarters (", c("hq"), ")")),
        F.when(F.size("products") > 0, text("products (", F.array_join(F.slice("products", 1, 2), ", "), ")")), F.when(F.size("leaders") > 0, text("leadership (", F.array_join(F.slice("leaders", 1, 2), ", "), ")")),
    ))
    hosts = F.transform("same_as", lambda s: F.replace(F.lower(urls.netloc(s)), F.lit("www."), F.lit("")))
    present = F.filter(F.array(*[F.lit(d) for d in fixed.SAMEAS_DOMAINS]), lambda d: F.exists(hosts, lambda h: F.contains(h, d)))
    lacking = F.filter(F.array(*[F.lit(d) for d in fixed.SAMEAS_ANCHORS]), lambda d: ~F.array_contains(present, d))
    n, brand = F.size("same_as"), c("brand")
    wiki, data_item = F.coalesce(c("has_wikipedia"), F.lit(False)), F.coalesce(c("has_wikidata"), F.lit(False))
    r = lambda when, sev, title, action, observed, check=None, source="html", locator="": rule(check or title, when, sev, title, action, source, observed, locator, **at)
    rules = [
        r(F.size("isolated") > 0, "high", text("Core brand claims exist in isolation with no independent corroboration (", F.size("isolated"), " claims)"), "Publish press releases, establish directory profiles (Crunchbase, LinkedIn, G2), and seek media coverage.", text("The following brand claims appear only on ", c("site_url"), " and could not be corroborated on third-party sources: ", F.array_join("isolated", "; "), ". AI assistants hesitate to assert uncorroborated facts in zero-shot answers.")),
        r(F.size("inconsistent") > 0, "medium", "External sources report conflicting information for core brand facts", "Align company profiles across external directories, Wikipedia, and registries to eliminate conflicting signals.", text("Factual discrepancy detected between website claims and external citations: ", F.array_join("inconsistent", "; "), ".")),
        r((n_claims == 0) & (F.size(kinds) > 0) & (c("n_templates") > 0), "info", "External corroboration of core claims not yet verified", "Run the generated corroboration queries and confirm each claim appears consistently on at least one independent authoritative source.", text("Detected ", F.size(kinds), " core claim(s) (", F.array_join(kinds, ", "), "). ", c("n_templates"), " search queries were generated to confirm them against independent sources; supply --corroboration-data to record the results."), "FC-03-pending", "external"),
        r(n == 0, "medium", "No sameAs disambiguation links in organization identity schema", "Add a sameAs array to the Organization or NewsMediaOrganization schema linking to official profiles: Wikipedia, Wikidata, LinkedIn, Crunchbase, and verified social channels.", text("Brand '", brand, "' does not declare any sameAs links in JSON-LD. AI search engines cannot disambiguate the brand from identically named or similar entities."), "FC-04-sameas-missing", locator="Organization.sameAs | NewsMediaOrganization.sameAs"),
        r((n > 0) & (F.size(lacking) > 0), "medium", "sameAs markup missing authoritative professional/entity profiles", text("Add links to your ", F.array_join(lacking, ", "), " profiles in the sameAs array."), text("sameAs schema declares ", n, " links but lacks key grounding profiles: ", F.array_join(lacking, ", "), ". These sources serve as primary entity resolution anchors.")),
        r((n > 0) & (F.size(lacking) == 0), "info", "Robust entity disambiguation links detected in sameAs schema", "Keep sameAs social and registry URLs updated as company expands footprint.", text("Found ", n, " disambiguation links covering major directories (", F.array_join(F.array_sort(present), ", "), ").")),
    ]
    known = [
        r(wiki & data_item, "info", "Strong knowledge graph grounding verified on Wikipedia and Wikidata", "Ensure Wikidata statements (official website, CEO, headquarters) remain in sync with site content.", text("Entity '", brand, "' is grounded in both Wikipedia (", c("wikipedia_title"), ") and Wikidata (", c("qid"), ": ", F.coalesce("description", F.lit("Entity")), "). Provides top-tier grounding for AI citations.")),
        r(data_item & ~wiki, "low", "Wikidata entity present but no dedicated Wikipedia article found", "Maintain comprehensive Wikidata properties and seek notable independent coverage if seeking Wikipedia inclusion.", text("Entity '", brand, "' has an active Wikidata item (", c("qid"), ") providing machine grounding, but lacks an English Wikipedia article.")),
        r(~wiki & ~data_item, "low", text("No Wikipedia or Wikidata knowledge graph presence found for '", brand, "'"), "Create a Wikidata item for the organization (Wikidata has lower notability hurdles than Wikipedia), and link it in JSON-LD sameAs.", text("Could not locate an English Wikipedia article or Wikidata item for '", brand, "'. AI search models (Google SGE, Perplexity, ChatGPT Search) rely heavily on Wikidata for zero-shot entity grounding.")),
    ]
    phone, address = F.length("telephone") > 0, F.length("address") > 0
    one = F.coalesce(phone, F.lit(False)) != F.coalesce(address, F.lit(False))
    part = F.when(F.coalesce(phone, F.lit(False)), "address").otherwise("telephone")
    title = text("Incomplete NAP (Name-Address-Phone) markup on ", c("url"))
    nap = rule(title, one, "medium", title, "Provide complete postalAddress and telephone fields in LocalBusiness schema.", observed=text("Page declares local entity data but lacks explicit ", part, " properties in schema."))
    return emit(told, SKILL, rules, 2).unionByName(emit(data, SKILL, [nap], 3)).unionByName(emit(told, SKILL, known, 4))


def compile_findings(pages: DataFrame, sites: DataFrame, as_of: Column, candidates: DataFrame | None = None, claims: DataFrame | None = None, dead: DataFrame | None = None) -> DataFrame:
    """Rows for findings.make of parsed content pages (site, ord, url, page[, last_modified]); sites (site, site_url)."""
    dates = date_signals(pages)
    data = entity_data(pages)
    entity = site_entity(data)
    if candidates is None:
        candidates = pages.sparkSession.createDataFrame([], "source string, title string, qid string, description string")
    counted = corroboration_templates(entity).groupBy("site").agg(F.count("*").alias("n_templates"))
    whole = entity.join(sites.select("site", "site_url"), "site", "left").join(grounding(entity, candidates), "site", "left").join(counted, "site", "left")
    rows = date_rules(dates, sites, as_of).unionByName(stale_rules(dates, dead, as_of)).unionByName(entity_rules(whole, data, claims))
    return by_severity(rows)
