"""Structured-data signals and rules: JSON-LD, Open Graph, Twitter cards, title and meta, llms.txt, cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fixed, text as words, urls
from auditlake.operators import findings

from .rules import emit, emit_lists, rule, text

SKILL = "structured-data-audit"
_LD = "script[type=application/ld+json]"
_PRICE = r"(?i)((?:[$€£¥₹]\s*\d[\d,]*(?:\.\d{1,2})?|\b\d[\d,]*(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\b))"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"


def _all(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(1))


def visible_cues(body: Column) -> dict[str, Column]:
    """Prices, currencies, availability, ratings and dates in a page's text, first ones of each."""
    tokens = _all(body, r"(?i)(\b(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\b|[$€£¥₹])")
    codes = F.array_compact(F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z]+$"), F.upper(t)).otherwise(words.currency(t))))
    rated = F.array_compact(F.flatten(F.transform(
        _all(body, r"(?i)(\b[0-5](?:\.\d+)?\s*(?:/\s*5|out of 5|stars?)\b|\b(?:rated|rating)\s*[:\-]?\s*[0-5](?:\.\d+)?\b)"),
        lambda m: F.slice(F.regexp_extract_all(m, F.lit(r"([0-5](?:\.\d+)?)"), F.lit(1)), 1, 1),
    )))
    dates = _all(body, rf"(\b(?:{_MONTH})\s+\d{{1,2}},\s+\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b)")
    return {
        "prices": F.slice(F.array_distinct(_all(body, _PRICE)), 1, 10),
        "currencies": F.slice(F.array_distinct(codes), 1, 8),
        "availability": F.slice(F.array_distinct(F.transform(_all(body, r"(?i)\b(in stock|out of stock|sold out|pre-?order|back-?order|available online|unavailable)\b"), F.lower)), 1, 8),
        "ratings": F.slice(F.array_distinct(rated), 1, 8),
        "dates": F.slice(F.array_sort(F.array_distinct(dates)), 1, 5),
    }


def tag_values(prefix: str) -> Column:
    """map<string, array<string>> of the page's meta tags whose name or property starts with prefix."""
    order = ("property", "name") if prefix == "og:" else ("name", "property")
    key = lambda m: F.lower(F.trim(F.coalesce(F.nullif(m[order[0]], F.lit("")), m[order[1]], F.lit(""))))
    held = F.filter("page.metas", lambda m: key(m).startswith(prefix))
    keys = F.array_distinct(F.transform(held, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(held, lambda m: key(m) == k), lambda m: m["content"])))


def named_meta(name: str) -> Column:
    """Content of the last meta tag of that name or property."""
    key = lambda m: F.lower(F.trim(F.coalesce(F.nullif(m["name"], F.lit("")), m["property"], F.lit(""))))
    return F.coalesce(F.try_element_at(F.filter("page.metas", lambda m: key(m) == name), F.lit(-1))["content"], F.lit(""))


def entities(column: str = "entities") -> Column:
    return F.flatten(F.transform(F.filter("page.json_ld", lambda b: b["has_data"]), lambda b: b[column]))


def value(entity: Column, path: str) -> Column:
    return F.get_json_object(entity["json"], f"$.{path}")


def has_type(entity: Column, *names: str) -> Column:
    return F.arrays_overlap(entity["types"], F.array(*[F.lit(n) for n in names]))


def is_minimal_organization(entity: Column) -> Column:
    """Nothing but a name, id and URL: a reference, not the site's own declaration."""
    rest = F.array_except(entity["filled"], F.array(*[F.lit(k) for k in ("@type", "@context", "@id", "name", "url")]))
    return F.size(rest) == 0


def presence_rules(pages: DataFrame) -> DataFrame:
    """Whether the types that a page's kind calls for are there. Site totals come from a partial aggregate."""
    c = F.col
    totals = pages.groupBy("site").agg(F.sum(F.size(entities())).alias("total"), F.count("*").alias("n_pages"))
    all_types = F.array_distinct(F.flatten(F.transform(entities(), lambda e: e["types"])))
    cues = visible_cues(F.col("page.body_text"))
    specific = F.exists(entities(), lambda e: has_type(e, *fixed.SPECIFIC_ORGANIZATIONS))
    home_types = F.array(*[F.lit(t) for t in fixed.HOME_TYPES])
    own = F.transform(entities(), lambda e: F.array_intersect(F.when(specific & is_minimal_organization(e), F.array_remove(e["types"], "Organization")).otherwise(e["types"]), home_types))
    base = pages.join(totals, "site").withColumn("types", all_types).withColumn("identity", F.array_sort(F.array_distinct(F.flatten(own)))).withColumn("prices", cues["prices"])
    home, lower, url = urls.is_home(c("url")), F.lower("url"), c("url")
    sample = F.lower(F.substring("page.body_text", 1, 2000))
    commerce = (F.size("prices") > 0) & urls.contains_any(sample, ("cart", "buy", "price", "checkout"))
    lacks = lambda *names: ~F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]))
    asks = (c("page.details") >= 2) | F.exists(F.concat("page.h1", "page.h2"), lambda h: h.rlike("(?i)" + fixed.FAQ_HEADING))
    rules = [
        rule("SD-01-home-identity", home & (F.size("identity") == 0), F.when(c("total") == 0, "critical").otherwise("high"), "Missing organization identity or WebSite schema on homepage", "Add a JSON-LD block with an appropriate Organization subtype or WebSite, including name, url, logo, and sameAs properties.", observed=text("The homepage (", url, ") lacks Organization, NewsMediaOrganization, WebSite, or LocalBusiness JSON-LD schema. AI assistants cannot reliably ground entity identity, official links, or logo."), locator=f"{_LD} @type", expected="Organization | NewsMediaOrganization | WebSite | LocalBusiness"),
        rule("SD-01-home-identity", home & (F.size("identity") > 0), "info", "Valid organization identity or WebSite schema detected on homepage", "Keep Organization schema up to date with official social channels and contact details.", observed=text("The homepage (", url, ") declares valid identity schema (", F.array_join("identity", ", "), ")."), locator=f"{_LD} @type"),
        rule("SD-01-product", (urls.contains_any(lower, fixed.COMMERCIAL_STRUCTURED) | commerce) & lacks("Product", "Offer", "SoftwareApplication", "Service"), F.when(commerce, "high").otherwise("medium"), "Missing Product or Offer schema on commercial page", "Add Product and Offer JSON-LD schema with name, price, priceCurrency, and availability properties.", observed=text("The page (", url, ") appears to be a commercial product/pricing page but lacks Product, Offer, SoftwareApplication, or Service structured markup."), locator=f"{_LD} @type", expected="Product | Offer | SoftwareApplication | Service"),
        rule("SD-01-article", urls.contains_any(lower, fixed.EDITORIAL_STRUCTURED) & lacks("Article", "BlogPosting", "NewsArticle"), "medium", "Missing Article schema on editorial page", "Add Article or BlogPosting JSON-LD schema including headline, author, datePublished, and dateModified.", observed=text("The page (", url, ") appears to be an editorial article or post but has no Article, BlogPosting, or NewsArticle schema markup."), locator=f"{_LD} @type"),
        rule("SD-01-faq", (urls.contains_any(lower, fixed.FAQ_STRUCTURED) | asks) & lacks("FAQPage"), "medium", "Missing FAQPage schema on FAQ/support page", "Add FAQPage JSON-LD schema with mainEntity array containing Question and acceptedAnswer entities.", observed=text("The page (", url, ") contains FAQ or support content but lacks FAQPage structured markup. AI assistants cannot directly ingest structured question-and-answer pairs for zero-click answer synthesis."), locator=f"{_LD} @type"),
    ]
    from .rules import affected  # the site-wide findings

    found = affected(base, {"zero": (c("total") == 0, F.lit(""), F.lit(0)), "crumb": (~home & lacks("BreadcrumbList"), F.lit(""), F.lit(0))})
    shown = F.when(c("n") > 1, F.concat(F.lit(" (affected: "), F.array_join("urls", ", "), F.when(c("n") > 6, F.lit(" …")).otherwise(F.lit("")), F.lit(")"))).otherwise(F.lit(""))
    wide = found.join(totals, "site").withColumn("ord", F.lit(0))
    first = F.element_at("urls", 1)
    zero = rule("SD-01-zero", c("name") == "zero", "critical", "Zero JSON-LD structured data detected across website", "Implement baseline JSON-LD schema starting with Organization on the homepage, and page-specific schema (Product, Article, FAQPage) across interior pages.", observed=text("None of the ", c("n_pages"), " successfully-fetched pages on ", c("site"), " contain valid JSON-LD Schema.org markup. AI search engines, citation agents, and answer bots cannot extract structured brand identity, commercial offers, or content metadata.", shown), locator=_LD, url=first)
    crumb = rule("SD-01-breadcrumb", c("name") == "crumb", "low", text("BreadcrumbList schema missing on ", c("n"), " interior page(s)"), "Include BreadcrumbList JSON-LD markup declaring parent-child navigation on interior pages.", observed=text("Interior pages do not declare BreadcrumbList schema, missing an opportunity to convey site hierarchy to AI crawler graphs.", shown), locator=f"{_LD} @type=BreadcrumbList", url=first)
    return emit(wide, SKILL, [zero], 0).unionByName(emit(base, SKILL, rules, 1)).unionByName(emit(wide, SKILL, [crumb], 2))


def _list_words(names: Column, most: int | None = None) -> Column:
    return F.array_join(F.slice(names, 1, most) if most else names, ", ")


def validity_rules(pages: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    url = c("url")
    blocks = "page.json_ld"
    allowed = lambda b: F.exists(b["contexts"], lambda s: s.rlike("(?i)" + fixed.CONTEXT))
    per_block = F.flatten(F.transform(blocks, lambda b: F.array(
        rule("Malformed JSON in JSON-LD script block", b["error"].isNotNull(), "high", "Malformed JSON in JSON-LD script block", 'Fix the JSON syntax inside the <script type="application/ld+json"> tag. Remove trailing commas or unescaped characters.', observed=text("JSON-LD block #", b["index"], " on ", url, " failed to parse: ", b["error"], " at line ", b["line"], ", col ", b["col"], ".")),
        rule("Missing @context in JSON-LD script block", b["has_data"] & ~b["has_context"], "high", "Missing @context in JSON-LD script block", "Add '@context': 'https://schema.org' to the root of the JSON-LD object.", observed=text("JSON-LD block #", b["index"], " on ", url, " lacks the required '@context': 'https://schema.org' declaration (Anti-Pattern AP-01). Machines cannot disambiguate entity vocabulary.")),
        rule("Invalid or non-Schema.org @context in JSON-LD", b["has_data"] & b["has_context"] & ~allowed(b), "high", "Invalid or non-Schema.org @context in JSON-LD", "Ensure '@context' points to 'https://schema.org'.", observed=text("JSON-LD block #", b["index"], " on ", url, " declares @context '", b["context"], "', which does not point to Schema.org (https://schema.org). AI search engines and crawler agents may ignore this markup.")),
    )))
    specific = F.exists(entities(), lambda e: has_type(e, *fixed.SPECIFIC_ORGANIZATIONS))
    registry = F.array(*[
        F.struct(F.lit(n).alias("name"), *[F.array(*[F.lit(x) for x in part]).cast("array<string>").alias(label) for label, part in (("need", need), ("one_of", one), ("nice", nice))])
        for n, need, one, nice in fixed.SCHEMA_TYPES
    ])

    def typed(e: Column, t: Column) -> Column:
        """Rules of one entity under one registered type."""
        need, nice = F.array_except(t["need"], e["filled"]), F.array_except(t["nice"], e["filled"])
        lacks_any = (F.size(t["one_of"]) > 0) & ~F.arrays_overlap(t["one_of"], e["filled"])
        name, missing, some = t["name"], _list_words(need), _list_words(nice, 4)
        return F.array(
            rule(text("Missing required properties in ", name, " schema"), F.size(need) > 0, "high", text("Missing required properties in ", name, " schema"), text("Add missing properties (", missing, ") to the ", name, " markup."), observed=text(name, " schema on ", url, " is missing required properties: ", missing, ".")),
            rule(text("SD-02-", F.lower(name), "-required-any"), lacks_any, "high", text("Missing alternative required property in ", name, " schema"), text("Add one of (", _list_words(t["one_of"]), ") to the ", name, " markup."), observed=text(name, " schema on ", url, " requires at least one of: ", _list_words(t["one_of"]), ".")),
            rule(text("Recommended properties missing in ", name, " schema"), F.size(nice) >= 2, "medium", text("Recommended properties missing in ", name, " schema"), text("Consider enhancing ", name, " with recommended properties: ", some, "."), observed=text(name, " schema on ", url, " is missing recommended properties for AI citation: ", some, ".")),
        )

    def of_entity(e: Column) -> Column:
        passed = lambda t: (t["name"] == "Organization") & specific & is_minimal_organization(e)
        known = F.filter(registry, lambda t: F.array_contains(e["types"], t["name"]) & ~passed(t))
        dummy = F.transform(F.filter(e["strings"], lambda s: words.is_placeholder(s["value"])), lambda s: rule(
            text("Placeholder dummy data detected in schema (", s["key"], ")"), F.lit(True), "high", text("Placeholder dummy data detected in schema (", s["key"], ")"), "Replace template or placeholder values with actual production brand data.", observed=text("Field '", s["key"], "' on ", url, " contains dummy or placeholder text: '", F.substring(s["value"], 1, 100), "'.")))
        untyped = rule("Schema entity missing @type", F.size(e["types"]) == 0, "high", "Schema entity missing @type", "Specify a valid Schema.org @type for all structured data entities.", observed=text("A JSON-LD entity on ", url, " lacks the required '@type' property: ", F.substring(e["json"], 1, 150), "."))
        return F.concat(F.array(untyped), F.flatten(F.transform(known, lambda t: typed(e, t))), dummy)

    shape, meaning = F.flatten(F.transform(entities(), of_entity)), F.flatten(F.transform(entities(), lambda e: semantic(e, as_of)))
    return emit_lists(pages, SKILL, {3: F.concat(per_block, shape), 4: meaning})


def semantic(e: Column, as_of: Column) -> Column:
    """Checks of values: news dates, speakable selectors, offers, ratings."""
    url = F.col("url")
    filled = lambda k: F.array_contains(e["filled"], k)
    v = lambda k: value(e, k)
    told = lambda *errors: F.array_compact(F.array(*errors))
    # news articles
    published, modified = words.parse_iso_date(v("datePublished")), words.parse_iso_date(v("dateModified"))
    named = lambda k: F.coalesce(F.length(v(f"{k}.name")) > 0, F.lit(False)) | F.coalesce(F.length(v(f"{k}['@id']")) > 0, F.lit(False))
    is_object, is_list = v("author").startswith("{"), v("author").startswith("[")
    author = filled("author") & (~is_object | named("author") | is_list)
    publisher = v("publisher").startswith("{") & named("publisher")
    news_errors = told(
        F.when(filled("datePublished") & published.isNull(), F.lit("datePublished is not a valid ISO-8601 date")),
        F.when(filled("dateModified") & modified.isNull(), F.lit("dateModified is not a valid ISO-8601 date")),
        F.when(modified < published, F.lit("dateModified precedes datePublished")),
        F.when(filled("author") & ~author, F.lit("author lacks a usable name or @id")),
        F.when(filled("publisher") & ~F.coalesce(publisher, F.lit(False)), F.lit("publisher lacks a usable name or @id")),
    )
    news = has_type(e, "NewsArticle")
    complete = filled("headline") & filled("datePublished") & filled("author") & filled("publisher") & published.isNotNull() & author & publisher
    # speakable
    listed = lambda k: F.when(v(k).startswith("["), F.from_json(v(k), "array<string>")).otherwise(F.array(v(k)))
    selectors = F.filter(F.concat(*[F.coalesce(listed(k), F.array().cast("array<string>")) for k in ("cssSelector", "xpath")]), lambda s: F.length(F.trim(s)) > 0)
    speakable = has_type(e, "SpeakableSpecification")
    # products and offers
    offers = v("offers")
    items = F.when(offers.startswith("["), F.from_json(offers, "array<string>")).when(offers.startswith("{"), F.array(offers)).otherwise(F.array().cast("array<string>"))
    usable = F.exists(items, lambda o: F.get_json_object(o, "$['@type']").rlike(r'^Offer$|"Offer"') | F.get_json_object(o, "$.price").isNotNull())
    price, until = words.decimal(v("price")), words.parse_iso_date(v("priceValidUntil"))
    state = F.substring_index(F.regexp_replace(F.coalesce(v("availability"), F.lit("")), "/+$", ""), "/", -1)
    offer_errors = told(
        F.when(v("price").isNotNull() & (price.isNull() | (price < 0)), F.lit("price must be a non-negative number")),
        F.when(filled("priceCurrency") & ~v("priceCurrency").rlike("^[A-Z]{3}$"), F.lit("priceCurrency must be an uppercase three-letter ISO 4217 code")),
        F.when((state != "") & ~state.isin(*fixed.AVAILABILITIES), text("availability '", state, "' is not a recognized ItemAvailability value")),
        F.when(filled("priceValidUntil") & until.isNull(), F.lit("priceValidUntil is not a valid ISO-8601 date")).when(until < F.to_date(as_of), text("priceValidUntil expired on ", until)),
    )
    # ratings
    count_raw = F.coalesce(v("ratingCount"), v("reviewCount"))
    rating, count = words.decimal(v("ratingValue")), words.decimal(count_raw)
    best = F.when(v("bestRating").isNull(), F.lit(5).cast("decimal(38,10)")).otherwise(words.decimal(v("bestRating")))
    worst = F.when(v("worstRating").isNull(), F.lit(1).cast("decimal(38,10)")).otherwise(words.decimal(v("worstRating")))
    plain = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    rating_errors = told(
        F.when(v("ratingValue").isNotNull() & rating.isNull(), F.lit("ratingValue must be numeric")),
        F.when(v("bestRating").isNotNull() & best.isNull(), F.lit("bestRating must be numeric")),
        F.when(v("worstRating").isNotNull() & worst.isNull(), F.lit("worstRating must be numeric")),
        F.when(count_raw.isNotNull() & count.isNull(), F.lit("ratingCount/reviewCount must be numeric")),
        F.when((rating < worst) | (rating > best), text("ratingValue ", plain(rating), " is outside the declared ", plain(worst), "-", plain(best), " range")),
        F.when((count <= 0) | (count != F.floor(count)), F.lit("ratingCount/reviewCount must be a positive integer")),
    )
    bad = lambda errors: F.array_join(errors, "; ")
    return F.array(
        rule("SD-02-newsarticle-semantic", news & (F.size(news_errors) > 0), "high", "Invalid NewsArticle publication metadata", "Use ISO-8601 publication dates and identify author and publisher with names or stable @id values.", observed=text("NewsArticle on ", url, ": ", bad(news_errors), "."), locator="NewsArticle"),
        rule("SD-02-newsarticle-valid", news & (F.size(news_errors) == 0) & complete, "info", "Valid NewsArticle publication metadata detected", "Keep dateModified synchronized with substantive editorial updates.", observed="NewsArticle has a headline, valid publication date, identified author, and identified publisher.", locator="NewsArticle"),
        rule("SD-02-speakable-valid", speakable & (F.size(selectors) > 0), "info", "Valid SpeakableSpecification selectors detected", "Keep selectors limited to concise text that remains visible on the page.", observed=text("SpeakableSpecification provides ", F.size(selectors), " non-empty CSS/XPath selector(s)."), locator="SpeakableSpecification.cssSelector|xpath"),
        rule("SD-02-speakable-invalid", speakable & (F.size(selectors) == 0) & (filled("cssSelector") | filled("xpath")), "high", "Invalid SpeakableSpecification selector values", "Provide one or more non-empty cssSelector or xpath strings.", observed="Speakable selectors must be a non-empty string or list of non-empty strings.", locator="SpeakableSpecification.cssSelector|xpath"),
        rule("SD-02-product-offers", has_type(e, "Product") & (F.size(items) > 0) & ~F.coalesce(usable, F.lit(False)), "high", "Product offers do not contain a usable Offer", "Nest a valid Offer with price, priceCurrency, availability, and URL under Product.offers.", observed=text("Product '", v("name"), "' has offers markup without an Offer type or price."), locator="Product.offers"),
        rule("SD-02-offer-semantic", has_type(e, "Offer") & (F.size(offer_errors) > 0), "high", "Invalid or stale Offer pricing metadata", "Publish a numeric current price, ISO currency, valid ItemAvailability URL/value, and a non-expired priceValidUntil.", observed=text("Offer on ", url, ": ", bad(offer_errors), "."), locator="Offer"),
        rule("SD-02-aggregate-rating-semantic", has_type(e, "AggregateRating") & (F.size(rating_errors) > 0), "high", "Invalid AggregateRating values", "Keep ratingValue within bestRating/worstRating and provide a positive integer ratingCount or reviewCount.", observed=text("AggregateRating on ", url, ": ", bad(rating_errors), "."), locator="AggregateRating"),
    )


def tag_rules(pages: DataFrame) -> DataFrame:
    """Open Graph, Twitter cards, title, description, favicon."""
    c, url = F.col, F.col("url")
    base = pages.select("site", "ord", "url", tag_values("og:").alias("og"), tag_values("twitter:").alias("tw"), F.trim("page.title").alias("title"), named_meta("description").alias("desc"), F.size("page.icons").alias("icons"))
    missing = lambda tags, required: F.filter(F.array(*[F.lit(t) for t in required]), lambda t: F.coalesce(F.array_join(tags[t], "") == "", F.lit(True)))
    og, tw = missing(c("og"), fixed.OG_REQUIRED), missing(c("tw"), fixed.TWITTER_REQUIRED)
    utility = urls.is_utility_social(url)
    image = F.try_element_at(c("og")["og:image"], F.lit(1))
    title, n, d = c("title"), F.length("title"), F.length("desc")
    generic = words.is_generic_title(title)
    none = n == 0
    r = lambda when, severity, name, action, observed, check=None, locator="": rule(check or name, when, severity, name, action, observed=observed, locator=locator)
    og_rules = [
        r(~utility & (F.size(og) == 5), "medium", "Missing all essential Open Graph meta tags", f"Add Open Graph meta tags to <head>: {', '.join(fixed.OG_REQUIRED)}.", text("The page (", url, ") does not define any Open Graph tags. AI social and citation parsers cannot construct rich previews.")),
        r(~utility & F.size(og).between(1, 4), "medium", text("Incomplete Open Graph tags: missing ", _list_words(og)), text("Add the missing Open Graph tags: ", _list_words(og), "."), text("The page (", url, ") is missing key Open Graph properties: ", _list_words(og), ".")),
        r((F.length(image) > 0) & ~image.rlike("^https?://"), "low", "Open Graph image is not an absolute URL", "Specify a fully-qualified absolute HTTPS URL for og:image.", text("The og:image tag on ", url, " specifies a relative path '", image, "', which breaks across external AI preview cards.")),
    ]
    tw_rules = [r(~utility & (F.size(tw) > 0), "low", text("Missing Twitter Card tags (", _list_words(tw), ")"), "Add twitter:card (summary_large_image), twitter:title, and twitter:description.", text("The page (", url, ") lacks Twitter Card directives: ", _list_words(tw), "."))]
    low, high = fixed.TITLE_LENGTHS
    short, long = fixed.DESCRIPTION_LENGTHS
    meta_rules = [
        r(none, "high", "Missing <title> tag", "Add a descriptive <title> tag (10-60 characters) summarizing page intent and brand.", text("The page (", url, ") has no <title> tag, preventing AI search engines and citation bots from determining page context.")),
        r(~none & generic, "medium", text("Generic boilerplate title tag ('", title, "')"), "Use a specific title format: [Page Topic / Action] — [Brand Name].", text("The page (", url, ") uses a generic title '", title, "' with no distinguishing brand or topic identifier.")),
        r(~none & ~generic & (n < low), "low", text("Title tag is unusually short (", n, " chars)"), "Expand the title tag to 10–60 characters with relevant brand context.", text("The title '", title, "' on ", url, " is only ", n, " characters; it may lack sufficient context for AI answer grounding.")),
        r(~none & ~generic & (n > high), "low", text("Title tag exceeds recommended length (", n, " chars)"), "Keep title tags under 65 characters to prevent truncation.", text("The title on ", url, " is ", n, " characters and may be truncated in search snippets.")),
        r(d == 0, "medium", "Missing meta description tag", "Add a concise meta description (50–160 characters) summarizing the page.", text("The page (", url, ') lacks a <meta name="description"> tag.')),
        r((d > 0) & (d < short), "low", "Meta description is too short", f"Expand meta description to at least {short} characters of substantive summary.", text("Meta description on ", url, " is only ", d, f" characters (recommended: {short}–{long} characters).")),
        r(d > long, "low", "Meta description exceeds recommended length", f"Keep meta descriptions under {long} characters to avoid truncation.", text("Meta description on ", url, " is ", d, f" characters (recommended: {short}–{long} characters) and may be truncated in search snippets.")),
        r((c("icons") == 0) & urls.is_home(url), "low", "Missing favicon link declaration", 'Add <link rel="icon" href="/favicon.ico"> to the <head>.', text("The homepage (", url, ') does not declare a <link rel="icon"> or apple-touch-icon tag.'), "SD-05-favicon", "link[rel=icon]"),
    ]
    return emit(base, SKILL, og_rules, 5).unionByName(emit(base, SKILL, tw_rules, 6)).unionByName(emit(base, SKILL, meta_rules, 7))


def llms_record(files: DataFrame) -> DataFrame:
    """Of llms.txt responses (site, url, status_code, content_type, body): present, length and what sections it has."""
    lower = F.lower(F.coalesce("body", F.lit("")))
    is_html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html")) | F.trim(lower).startswith("<!doctype html") | F.trim(lower).startswith("<html")
    return files.select(
        "site", "url",
        ((F.col("status_code") == 200) & ~is_html & (F.length(F.trim("body")) > 0)).alias("present"),
        F.length("body").alias("length_chars"),
        F.col("body").rlike(r"(?m)^#\s+").alias("has_title"), F.col("body").rlike(r"(?m)^>\s+").alias("has_summary"), F.col("body").rlike(r"(?m)^##\s+").alias("has_sections"),
    )


def llms_rules(sites: DataFrame) -> DataFrame:
    """sites (site, site_url, llms_present, llms_url, llms_length); where presence is null nothing was looked for."""
    c = F.col
    root = F.concat(F.regexp_replace("site_url", "/+$", ""), F.lit("/llms.txt"))
    at = F.coalesce("llms_url", root)
    there, n = F.coalesce(c("llms_present"), F.lit(False)), F.coalesce(c("llms_length"), F.lit(0))
    rules = [
        rule("SD-06-llms", c("llms_present").isNotNull() & ~there, "low", "Missing /llms.txt machine-facing summary file", "Create an /llms.txt markdown file at the domain root with an H1 brand title, a blockquote summary, and links to core docs.", "llms_txt", text("No /llms.txt file was found at ", root, ". Emerging AI web agents use llms.txt to quickly parse site purpose, structure, and documentation."), url=root),
        rule("SD-06-llms-thin", there & (n < 50), "low", "/llms.txt file is too brief or empty", "Expand /llms.txt with a project summary, key product offerings, and curated links.", "llms_txt", text("An /llms.txt file was found at ", c("site_url"), "/llms.txt, but it only contains ", n, " characters."), url=root),
        rule("SD-06-llms-valid", there & (n >= 50), "info", "Valid /llms.txt machine-facing summary detected", "Keep /llms.txt updated with current brand, product, and canonical doc references.", "llms_txt", text("Valid /llms.txt found at ", at, " (", n, " characters). Provides structured context for AI agents."), url=at),
    ]
    return emit(sites.withColumn("ord", F.lit(0)), SKILL, rules, 8)


def cross_rules(pages: DataFrame) -> DataFrame:
    """Structured values against what the page shows."""
    c, url = F.col, F.col("url")
    cues = visible_cues(c("page.body_text"))
    base = pages.select("site", "ord", "url", "page", *[v.alias(k) for k, v in cues.items()])
    body = F.lower(F.substring("page.body_text", 1, 2000))
    visible = F.flatten(F.transform("prices", words.numbers))
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), F.lit(1)))
    target = tokens(F.concat_ws(" ", F.array_join("page.h1", " "), c("page.title")))
    shown = F.coalesce(F.try_element_at("page.h1", F.lit(1)), c("page.title"))
    first_type = lambda e, names: F.try_element_at(F.filter(e["types"], lambda t: t.isin(*names)), F.lit(1))

    def of_entity(e: Column) -> Column:
        kind = first_type(e, ("Product", "Article", "BlogPosting", "NewsArticle", "SoftwareApplication", "Service"))
        name = F.coalesce(F.nullif(value(e, "name"), F.lit("")), value(e, "headline"))
        share = F.size(F.array_intersect(tokens(name), target)) / F.size(tokens(name))
        differs = kind.isNotNull() & (F.size(tokens(name)) > 1) & (F.size(target) > 0) & (share < 0.35)
        is_offer = has_type(e, "Offer")
        nested = has_type(e, "Product") & ~is_offer & value(e, "offers").startswith("{") & ~F.coalesce(value(e, "offers['@type']") == "Offer", F.lit(False))
        offer = lambda k: F.when(is_offer, value(e, k)).when(nested, value(e, f"offers.{k}"))
        price = F.try_element_at(words.numbers(offer("price")), F.lit(1)).cast("double")
        near = F.exists(visible, lambda p: F.abs(p.cast("double") - price) < 0.01)
        written = F.contains(body, F.format_string("%.2f", price)) | F.contains(body, price.cast("long").cast("string"))
        code = offer("priceCurrency")
        state = F.lower(F.substring_index(F.regexp_replace(F.coalesce(offer("availability"), F.lit("")), "/+$", ""), "/", -1))
        groups = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(x) for x in v]).alias("v")) for k, v in fixed.AVAILABILITY_CUES.items()])
        states = F.transform(F.filter(groups, lambda g: F.arrays_overlap(g["v"], c("availability"))), lambda g: g["k"])
        rating = words.decimal(value(e, "ratingValue"))
        apart = (F.size("ratings") > 0) & ~F.exists("ratings", lambda r: F.abs(words.decimal(r) - rating) <= 0.05)
        article = first_type(e, ("Article", "BlogPosting", "NewsArticle"))
        year = F.regexp_extract(value(e, "datePublished"), r"\b(19\d\d|20\d\d)\b", 1)
        years = F.flatten(F.transform("dates", lambda d: F.regexp_extract_all(d, F.lit(r"\b(19\d\d|20\d\d)\b"), F.lit(1))))
        title = text("Content discrepancy between Schema.org ", kind, " name and visible DOM")
        return F.array(
            rule(title, differs, "high", title, text("Align Schema.org ", kind, " name with the primary visible heading or title on the page."), observed=text("Schema ", kind, " declares name/headline '", name, "', but visible heading/title shows '", shown, "'. Low token match (", F.floor(share * 100).cast("long"), "%) creates conflicting entity signals for AI models (Anti-Pattern AP-05).")),
            rule("SD-07-offer-price-consistency", price.isNotNull() & (F.size(visible) > 0) & ~near & ~written, "high", "Pricing discrepancy between Schema Offer and visible DOM text", "Ensure Schema.org Offer price exactly matches the visible price displayed to visitors.", observed=text("Schema Offer declares price '", offer("price"), "' ", code, ", but visible page prices are ", _list_words(c("prices"), 4), ". Conflicting prices damage AI confidence and cause inaccurate citations.")),
            rule("SD-07-offer-currency-consistency", price.isNotNull() & (F.length(code) > 0) & (F.size("currencies") > 0) & ~F.array_contains("currencies", F.upper(code)), "high", "Currency discrepancy between Schema Offer and visible content", "Align Offer.priceCurrency with the currency visibly attached to the advertised price.", observed=text("Schema Offer declares ", code, ", while visible pricing uses ", _list_words(F.array_sort("currencies")), ".")),
            rule("SD-07-offer-availability-consistency", state.isin(*fixed.AVAILABILITY_CUES) & (F.size("availability") > 0) & (F.size(states) == 1) & ~F.array_contains(states, state), "high", "Availability discrepancy between Schema Offer and visible content", "Update Offer.availability whenever the visible stock state changes.", observed=text("Schema Offer declares '", offer("availability"), "', while visible content says ", _list_words(F.array_sort("availability")), ".")),
            rule("SD-07-rating-consistency", has_type(e, "AggregateRating") & rating.isNotNull() & apart, "high", "AggregateRating discrepancy between schema and visible content", "Keep AggregateRating.ratingValue and rating/review counts synchronized with the visible rating summary.", observed=text("Schema declares ratingValue '", value(e, "ratingValue"), "', while visible rating text contains ", _list_words(F.array_sort("ratings")), ".")),
            rule("Publication date conflict between Schema and visible page text", article.isNotNull() & (year != "") & (F.size(years) > 0) & ~F.array_contains(years, year), "medium", "Publication date conflict between Schema and visible page text", "Synchronize Schema datePublished and dateModified with visible article timestamps.", observed=text("Schema ", article, " specifies datePublished '", value(e, "datePublished"), "' (year ", year, "), but visible date text references ", _list_words(c("dates")), ". AI engines rely on synchronized timestamps for freshness scoring.")),
        )

    return emit_lists(base, SKILL, {9: F.flatten(F.transform(entities(), of_entity))})


def by_severity(rows: DataFrame) -> DataFrame:
    """A skill's rows in stable order of severity: the rank goes in front of the emission order."""
    return rows.withColumn("seq", F.col("seq") + findings.severity_rank(F.col("severity")) * F.lit(10**17))


def compile_findings(pages: DataFrame, sites: DataFrame, as_of: Column) -> DataFrame:
    """Rows for findings.make of parsed content pages (site, ord, url, page) and sites."""
    parts = [presence_rules(pages), validity_rules(pages, as_of), tag_rules(pages), llms_rules(sites), cross_rules(pages)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return by_severity(out)
