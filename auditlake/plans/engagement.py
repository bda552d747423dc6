"""Engagement signals and rules: navigation, orientation, performance, mobile, actions, search, continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fixed, urls
from auditlake.operators import findings
from auditlake.sources import html

from .rules import PART, affected, percent, text

SKILL = "engagement-audit"


def fetch_status(status: Column, content_type: Column, body: Column, text_length: Column) -> Column:
    """What a response is: success, blocked, http_error, non_html or empty."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    marked = urls.contains_any(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 200_000)), fixed.BLOCK_MARKERS)
    ok = status.between(200, 299)
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.when(status.isin(*fixed.BLOCKED_STATUSES), "blocked").otherwise("http_error"))
        .when((kind != "") & ~F.contains(kind, F.lit("html")), "non_html")
        .when(F.length(F.trim(F.coalesce(body, F.lit("")))) == 0, "empty")
        .when(marked & (text_length < 5000), "blocked")
        .otherwise("success")
    )


def _destination(links: Column, terms: tuple[str, ...]) -> Column:
    words = "|".join(t.replace("-", r"\-") for t in terms)
    pattern = rf"(?iU)(?:^|[\W_-])(?:{words})(?:$|[\W_-])"
    return F.exists(links, lambda a: a["text"].rlike(pattern) | a["href"].rlike(pattern))


def profile(hints: Column, has_article: Column) -> tuple[Column, dict[str, Column]]:
    """(kind, scores): editorial before documentation before commercial on a tie."""
    score = {}
    for kind, terms in fixed.PROFILE_TERMS.items():
        total = F.lit(0)
        for term in terms:
            total = total + F.contains(hints, F.lit(term)).cast("int")
        score[kind] = total
    score["editorial"] = score["editorial"] + has_article.cast("int")
    top = F.greatest(*score.values())
    kind = F.when(top == 0, "general").when(score["editorial"] == top, "editorial").when(score["documentation"] == top, "documentation").otherwise("commercial")
    return kind, score


def viewport(content: Column) -> dict[str, Column]:
    lower = F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"\s+", "")
    most = F.regexp_extract(lower, r"maximum-scale=([0-9]+(?:\.[0-9]+)?)", 1)
    fixed_scale = lower.rlike(r"user-scalable=(?:no|0)(?:[,;]|$)")
    return {
        "has_viewport": F.coalesce(F.length(content) > 0, F.lit(False)),
        "has_width": lower.rlike(r"(?:^|[,;])width=device-width(?:[,;]|$)"),
        "no_zoom": fixed_scale | F.coalesce((most != "") & (most.cast("double") < 2), F.lit(False)),
    }


def performance() -> dict[str, Column]:
    """Counts of a parsed page's blocking scripts, style sheets and images; images_later are those after the first two."""
    images, later = F.col("page.images"), F.slice("page.images", F.lit(3), F.greatest(F.size("page.images"), F.lit(0)))
    bare = F.filter(images, lambda i: ~((F.length(i["width"]) > 0) & (F.length(i["height"]) > 0)) | i["width"].isNull() | i["height"].isNull())
    eager = F.filter(later, lambda i: F.lower(F.coalesce(i["loading"], F.lit(""))) != "lazy")
    blocking = F.filter("page.head_scripts", lambda s: ~s["deferred"] & ~s["type"].isin("application/ld+json", "application/json", "module"))
    lists = {"blocking_scripts": blocking, "stylesheets": F.col("page.head_styles"), "images": images, "images_bare": bare, "images_later": later, "images_eager": eager}
    return {name: F.size(held).cast("long") for name, held in lists.items()}


def extract(parsed: DataFrame) -> DataFrame:
    """Engagement columns of parsed pages (site, ord, url, at, page): one row a page."""
    p = lambda c: F.col(f"page.{c}")
    url = F.col("at")
    hints = F.concat_ws(" ", F.lower(urls.path(url)), p("body_class"), F.lower(p("title")))
    kind, _ = profile(hints, p("has_article"))
    # the containers are landmarks if there are any, else menus by class, else the header's links; the parse marks each target's first link there
    of = lambda flag: F.filter(p("anchors"), lambda a: a[flag])
    held = F.when(p("nav_landmarks") > 0, F.exists(p("anchors"), lambda a: a["nav"] > 0)).otherwise(F.exists(p("anchors"), lambda a: a["menu"] > 0))
    primary = F.when(held, F.when(p("nav_landmarks") > 0, of("first_nav")).otherwise(of("first_menu"))).otherwise(of("first_header"))
    quick = performance()
    plain = lambda u: F.regexp_replace(F.lower(urls.netloc(u)), r"^www\.", "")
    own = plain(url)
    hosts = F.array_distinct(F.filter(F.transform(p("resources"), plain), lambda h: (h != "") & (h != own) & ~h.endswith(F.concat(F.lit("."), own))))
    acts = lambda c: urls.contains_any(F.lower(c["text"]), fixed.ACTION_CTAS)
    vague = "^(?:" + "|".join(fixed.GENERIC_CTAS) + ")(?: |$)"
    control = lambda c: (c["tag"] == "button") | (c["role"] == "button") | ((c["tag"] == "input") & c["type"].isin("submit", "button"))
    styled = lambda c: c["class"].rlike(r"(?i)(?:^|[-_ ])(?:btn|button|cta|action)(?:$|[-_ ])")
    generic = lambda c: F.lower(c["text"]).rlike(vague)
    ctas = F.filter(p("controls"), lambda c: (F.length(c["text"]).between(1, 80)) & (styled(c) | control(c) | acts(c) | generic(c)))
    retention = "|".join(x.replace("-", "[-_ ]?") for x in fixed.RETENTION)
    account = F.exists(p("anchors"), lambda a: a["href"].rlike(r"(?i)/(?:account|profile|login|signin)(?:/|$)"))
    view = viewport(p("viewport"))
    first = parsed.select("site", "ord", "url", "at", "page", of("first").alias("_links"), primary.alias("_primary"), ctas.alias("_ctas"))
    n = lambda c: F.size(c).cast("long")
    labels = F.array_sort(F.array_distinct(F.filter(F.transform("_primary", lambda a: F.lower(F.trim(a["text"]))), lambda t: t != "")))
    return first.select(
        "site", "ord", F.col("at").alias("url"),
        kind.alias("kind"),
        ((F.when(p("nav_landmarks") > 0, p("nav_landmarks")).otherwise(p("nav_menus")) > 0) | (F.size("_primary") >= 2)).alias("has_nav"),
        (p("nav_landmarks") > 0).alias("has_landmark"),
        n("_primary").alias("nav_links"), n("_links").alias("total_links"),
        n(F.filter("_links", lambda a: urls.same_site(a["full"], F.col("at")))).alias("internal_links"),
        F.slice(labels, 1, 40).alias("nav_labels"),
        _destination(F.col("_links"), fixed.OFFER_OR_SUPPORT).alias("has_path"),
        urls.depth(url).cast("long").alias("depth"),
        n(p("h1")).alias("h1_count"), F.length(p("intro")).cast("long").alias("intro_chars"),
        (p("breadcrumb") | p("breadcrumb_schema")).alias("has_breadcrumb"),
        quick["blocking_scripts"].alias("blocking_scripts"), quick["stylesheets"].alias("stylesheets"), n(hosts).alias("third_parties"),
        *[quick[c].alias(c) for c in ("images", "images_bare", "images_later", "images_eager")],
        *[v.alias(k) for k, v in view.items()], F.coalesce(p("viewport"), F.lit("")).alias("viewport"),
        n("_ctas").alias("ctas"), n(F.filter("_ctas", generic)).alias("ctas_generic"),
        F.slice(F.transform(F.filter("_ctas", generic), lambda c: c["text"]), 1, 4).alias("generic_sample"),
        n(F.array_distinct(F.transform(F.filter("_ctas", acts), lambda c: F.lower(c["text"])))).alias("ctas_acting"),
        ((p("search.inputs") > 0) | (p("search.forms") > 0) | (p("search.roles") > 0) | (p("search.labels") > 0) | (p("search.icons") > 0)).alias("has_search"),
        p("search.silent_icons").alias("silent_icons"),
        (F.exists(p("retention"), lambda t: t.rlike(rf"(?:^|\b)(?:{retention})(?:\b|$)")) | urls.contains_any(p("script_text"), fixed.STORAGE) | account).alias("retains"),
        (urls.is_utility_engagement(url)).alias("utility"),
        urls.is_editorial_permalink(url, kind).alias("permalink"),
    )


def is_marked() -> Column:
    return urls.contains_any(F.lower(F.substring("html", 1, 200_000)), fixed.BLOCK_MARKERS)


def unblocked(parsed: DataFrame) -> DataFrame:
    """Parsed pages (with `marked`) without those that are a short page of a gatekeeper."""
    return parsed.filter(~(F.col("marked") & (F.length("page.full_text") < 5000))).drop("marked").withColumn("at", F.col("url"))


def pages_in(pages: DataFrame) -> DataFrame:
    """Pages (site, ord, url[, final_url, status_code, content_type], html) that count as content, parsed."""
    have = set(pages.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    # the text's length is not known before the parse, so that interstitial pages are dropped after it
    gated = pages.filter(fetch_status(col("status_code", 200), col("content_type", "text/html"), F.col("html"), F.lit(10**9)) == "success")
    at = F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in have else F.col("url")
    return unblocked(html.parse(gated.select("site", "ord", at.alias("url"), is_marked().alias("marked"), "html")))


# name: severity, title, action, locator, expected. Fixed texts of findings.
TEXTS = {
    "EG-01-nav-structure": ("medium", "Primary navigation structure not detected", "Provide a consistent primary navigation region with descriptive internal links.", "nav, [role=navigation], header navigation", "A primary navigation structure on each standard content page"),
    "EG-01-nav-landmark": ("low", "Primary navigation lacks a semantic landmark", "Wrap primary navigation in <nav> or assign role=navigation and an accessible label.", "nav, [role=navigation]", None),
    "EG-01-nav-consistency": ("medium", "Primary navigation changes substantially across pages", "Keep core navigation labels and destinations consistent across standard page templates.", "primary navigation link text", ">=35% label overlap with the sampled baseline navigation"),
    "EG-01-commercial-path": ("medium", "Commercial pages lack an offering or support navigation path", "Add a relevant route to offerings, documentation, help, or contact; use labels appropriate to the site.", "a[href] text/href in page navigation", "At least one context-appropriate offering or support destination"),
    "EG-02-h1-missing": ("medium", "Pages lack a primary H1 orientation cue", "Add a descriptive H1 that states the page topic or purpose.", "h1", "At least one non-empty H1"),
    "EG-02-h1-hierarchy": ("low", "Page heading hierarchy has several primary headings", "Review the heading outline and reserve H1 for primary page topics where practical.", "h1", "A concise primary heading hierarchy"),
    "EG-02-intro-copy": ("medium", "Landing pages lack measurable introductory copy", "Add concise introductory copy near the primary heading explaining the page's purpose or offering.", "main p, main h2, hero/intro container", "At least 20 characters of introductory text near the page start"),
    "EG-02-breadcrumb": ("low", "Hierarchical interior pages lack breadcrumb cues", "Add visible breadcrumbs on genuinely hierarchical templates and optionally mirror them with BreadcrumbList data.", ".breadcrumb, [aria-label*=breadcrumb], BreadcrumbList", "Breadcrumbs on deep hierarchical pages"),
    "EG-03-blocking-scripts": ("medium", "Synchronous head scripts create structural render delay risk", "Defer or make non-critical scripts asynchronous.", "script[src] in head without async/defer", "At most 3"),
    "EG-03-stylesheets": ("medium", "Many render-blocking stylesheets are requested from head", "Consolidate stylesheets or inline only measured critical CSS where appropriate.", "head link[rel=stylesheet]", "At most 4"),
    "EG-03-third-parties": ("medium", "Many third-party resource domains are referenced", "Audit and consolidate non-essential third-party resources.", "external script/link/iframe/img/source hosts", "At most 10"),
    "EG-03-image-dimensions": ("medium", "Most images lack intrinsic dimensions", "Provide intrinsic width/height or an equivalent reserved aspect ratio to reduce layout-shift risk.", "img:not([width][height])", "Dimensions on at least half of sampled images"),
    "EG-03-image-loading": ("low", "Later document images load eagerly", "Consider native lazy loading for non-critical images after verifying actual viewport placement.", "img after the first two document images", "loading=lazy on non-critical later images"),
    "EG-04-viewport-missing": ("critical", "Mobile viewport metadata is missing", "Add <meta name=viewport content='width=device-width, initial-scale=1'> in head.", "meta[name=viewport]", "width=device-width viewport metadata"),
    "EG-04-viewport-width": ("high", "Viewport does not use device width", "Set width=device-width while preserving any justified scale directives.", "meta[name=viewport] content", "width=device-width"),
    "EG-04-zoom": ("high", "Viewport configuration restricts user zoom", "Remove user-scalable restrictions and allow at least 200% zoom.", "meta[name=viewport] content", "No user-scalable=no and maximum-scale >= 2 when specified"),
    "EG-05-commercial-cta": ("high", "Commercial pages expose no measurable action control", "Provide a context-specific next action such as purchasing, evaluation, contact, or documentation.", "button, [role=button], styled/action-labelled links", "At least one context-appropriate action control"),
    "EG-05-generic-cta": ("low", "Calls to action are dominated by generic labels", "Replace repeated generic labels with destination-specific action text.", "button/link control text", "Fewer than 3 generic labels or under 60% of measured controls"),
    "EG-05-cta-density": ("low", "Many distinct high-intent actions compete on a page", "Prioritize one primary action and present secondary actions with lower visual emphasis.", "recognized actionable button/link labels", "At most 3 distinct actionable CTA labels"),
    "EG-06-search-label": ("low", "Search icon triggers lack an accessible name", "Give icon-only search triggers an aria-label such as 'Search'.", "search trigger accessible name", "Text, aria-label, or title"),
    "EG-06-search-absent": ("medium", "No site-search control found in a content-rich page sample", "Add discoverable site search when the full content inventory warrants it.", "input/form/[role=search]/labelled search trigger", "A search control in a >=5-page or content-rich >=3-page sample"),
    "EG-07-continuity-absent": ("low", "No continuity feature found across a commercial page sample", "Consider saved items, recently viewed content, or account continuity only when useful to the visitor journey.", "account/save/history controls or storage hooks", "A relevant continuity mechanism on stateful commercial journeys"),
}


def site_rules(signals: DataFrame) -> DataFrame:
    """Rows for findings.make: at most one finding of each rule and site, over `extract` rows."""
    c = F.col
    use, kind = ~c("utility"), c("kind")
    # the first page of a site with two labels or more is the baseline of its navigation
    nav = signals.filter(use & (F.size("nav_labels") >= 2))
    base = nav.groupBy("site").agg(F.min_by(F.struct("ord", "url", "nav_labels"), "ord").alias("b"), F.count("*").alias("n_nav"))
    compared = signals.join(base, "site", "left")
    shared = F.size(F.array_intersect("nav_labels", c("b.nav_labels"))) / F.size(F.array_union("nav_labels", c("b.nav_labels")))
    drifts = use & (F.size("nav_labels") >= 2) & (c("n_nav") >= 3) & (c("ord") != c("b.ord")) & (shared < 0.35)
    landing = (F.regexp_replace(urls.path(c("url")), r"^/+|/+$", "") == "") | (kind == "commercial")
    deep = (c("depth") >= 2) & (kind.isin("documentation", "commercial") | (c("depth") >= 3)) & ~c("permalink") & ~c("has_breadcrumb")
    none, ratio = F.lit(""), F.bround(c("ctas_generic") / F.greatest("ctas", F.lit(1)), 3)
    counted = lambda v: text(c("url"), ": ", v)
    over = lambda a, b: text(c("url"), ": ", a, "/", b)
    tests = {
        "EG-01-nav-structure": (use & ~c("has_nav"), none, F.lit(0)),
        "EG-01-nav-landmark": (use & c("has_nav") & ~c("has_landmark"), none, F.lit(0)),
        "EG-01-nav-consistency": (drifts, text(c("url"), " (", percent(F.bround(shared, 2)), " label overlap)"), shared),
        "EG-01-commercial-path": (use & (kind == "commercial") & ~c("has_path"), none, F.lit(0)),
        "EG-02-h1-missing": (use & (c("h1_count") == 0), none, F.lit(0)),
        "EG-02-h1-hierarchy": (use & (c("h1_count") > 2), none, c("h1_count")),
        "EG-02-intro-copy": (use & landing & (c("h1_count") > 0) & (c("intro_chars") < 20), none, F.lit(0)),
        "EG-02-breadcrumb": (use & deep, none, F.lit(0)),
        "EG-03-blocking-scripts": (c("blocking_scripts") > 3, counted(c("blocking_scripts")), F.lit(0)),
        "EG-03-stylesheets": (c("stylesheets") > 4, counted(c("stylesheets")), F.lit(0)),
        "EG-03-third-parties": (c("third_parties") > 10, counted(c("third_parties")), F.lit(0)),
        "EG-03-image-dimensions": ((c("images") >= 2) & (c("images_bare") >= 2) & (2 * c("images_bare") >= c("images")), over(c("images_bare"), c("images")), F.lit(0)),
        "EG-03-image-loading": ((c("images_later") >= 3) & (c("images_eager") >= 3), over(c("images_eager"), c("images_later")), F.lit(0)),
        "EG-04-viewport-missing": (~c("has_viewport"), none, F.lit(0)),
        "EG-04-viewport-width": (c("has_viewport") & ~c("has_width"), none, F.lit(0)),
        "EG-04-zoom": (c("no_zoom"), counted(c("viewport")), F.lit(0)),
        "EG-05-commercial-cta": (use & (kind == "commercial") & (c("ctas") == 0), none, F.lit(0)),
        "EG-05-generic-cta": (use & (kind != "editorial") & (c("ctas_generic") >= 3) & (ratio >= 0.6), text(c("ctas_generic"), " (", percent(ratio), "), samples: ", F.array_join("generic_sample", ", ")), c("ctas_generic")),
        "EG-05-cta-density": (use & (c("ctas_acting") > 3), counted(c("ctas_acting")), F.lit(0)),
        "EG-06-search-label": (use & c("has_search") & (c("silent_icons") > 0), none, c("silent_icons")),
        "EG-06-search-absent": (use, none, F.lit(0)),
        "EG-07-continuity-absent": (use, none, F.lit(0)),
    }
    found = affected(compared, tests)
    totals = signals.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(use).alias("eligible"), F.count_if(use & (kind == "commercial")).alias("commercial"),
        F.count_if(use & kind.isin("documentation", "editorial")).alias("rich"), F.count_if(use & c("has_search")).alias("searchable"),
        F.count_if(use & c("retains")).alias("retaining"),
    )
    worst = signals.filter(use & (kind != "editorial") & (c("ctas_generic") >= 3) & (ratio >= 0.6)).groupBy("site").agg(
        F.max_by(text(c("ctas_generic"), " (", percent(ratio), "), samples: ", F.array_join("generic_sample", ", ")), F.struct("ctas_generic", -c("ord"))).alias("worst")
    )
    joined = found.join(totals, "site").join(base.select("site", c("b.url").alias("base_url")), "site", "left").join(worst, "site", "left")
    holds = (
        F.when(c("name") == "EG-01-nav-consistency", c("n") >= 2)
        .when(c("name") == "EG-06-search-absent", ((c("eligible") >= 5) | ((c("eligible") >= 3) & (c("rich") >= 3))) & (c("searchable") == 0))
        .when(c("name") == "EG-07-continuity-absent", (c("retaining") == 0) & (c("eligible") >= 3) & (c("commercial") >= 2))
        .otherwise(True)
    )
    n, four = c("n"), F.array_join(F.slice("details", 1, 4), ", ")
    over3 = lambda k: text(f"Measured threshold >{k}; observed ", four, ".")
    details = {
        "EG-01-nav-structure": text(n, " of ", c("eligible"), " eligible HTML page(s) expose neither a navigation container nor header navigation links."),
        "EG-01-nav-landmark": text(n, " page(s) have inferred header/menu navigation but no <nav> or role=navigation landmark."),
        "EG-01-nav-consistency": text("Compared with ", c("base_url"), ", ", n, " page(s) have under 35% navigation-label overlap: ", four, "."),
        "EG-01-commercial-path": text(n, " commercial-profile page(s) contain no measured link matching product/service or contact/support aliases. Pricing and company links are not required by this check."),
        "EG-02-h1-missing": text(n, " of ", c("eligible"), " eligible HTML page(s) have zero non-empty <h1> elements."),
        "EG-02-h1-hierarchy": text(n, " page(s) have more than two H1s; highest measured count is ", c("top").cast("long"), "."),
        "EG-02-intro-copy": text(n, " homepage/commercial landing page(s) have an H1 but no introductory paragraph or H2 of at least 20 characters near the start of <main>."),
        "EG-02-breadcrumb": text(n, " deep documentation/commercial or 3+ segment page(s) expose neither visible nor structured breadcrumbs; editorial permalinks are excluded."),
        "EG-03-blocking-scripts": over3(3),
        "EG-03-stylesheets": over3(4),
        "EG-03-third-parties": over3(10),
        "EG-03-image-dimensions": text("At least 50% and at least two images lack both width and height on ", n, " page(s): ", four, "."),
        "EG-03-image-loading": text("Using document order as a static proxy for below-initial content, at least three later images omit loading=lazy: ", four, "."),
        "EG-04-viewport-missing": text(n, " of ", c("pages"), " successful HTML page(s) have no non-empty viewport meta tag."),
        "EG-04-viewport-width": text(n, " page(s) declare viewport metadata without an exact width=device-width directive."),
        "EG-04-zoom": text(n, " page(s) use user-scalable=no/0 or maximum-scale below 2: ", F.array_join(F.slice("details", 1, 3), "; "), "."),
        "EG-05-commercial-cta": text(n, " commercial-profile page(s) have zero buttons, styled action links, or recognized action labels."),
        "EG-05-generic-cta": text(n, " non-editorial page(s) have at least three generic CTAs comprising >=60% of measured controls; worst page has ", c("worst"), "."),
        "EG-05-cta-density": text("Measured actionable CTA count exceeds 3: ", four, "."),
        "EG-06-search-label": text(n, " page(s) contain icon-class search triggers with no text, aria-label, or title; highest count is ", c("top").cast("long"), "."),
        "EG-06-search-absent": text("Search inputs/forms/roles/triggers were absent from ", c("eligible"), " eligible successful pages; ", c("rich"), " were classified as documentation/editorial. Small sites and utility pages are suppressed."),
        "EG-07-continuity-absent": text("Across ", c("eligible"), " successful pages (", c("commercial"), " commercial-profile), no account link, saved/favorite/history feature, or client-storage hook was detected. General, news, and documentation sites are not required to provide these features."),
    }
    pick = lambda values: F.coalesce(*[F.when(c("name") == k, v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()])
    column = lambda i: pick({k: v[i] for k, v in TEXTS.items() if v[i] is not None})
    sample = F.when(n > 1, F.concat(F.lit(" Affected sample: "), F.array_join(F.slice("urls", 1, 5), ", "), F.when(n > 5, F.lit(" …")).otherwise(F.lit("")), F.lit("."))).otherwise(F.lit(""))
    rows = joined.filter(holds).select(
        "site", F.lit(SKILL).alias("skill"), c("name").alias("check_id"), column(0).alias("severity"), column(1).alias("title"), column(2).alias("action"),
        F.element_at("urls", 1).alias("url"), F.lit("html").alias("source"), F.concat(pick(details), sample).alias("observed"), column(3).alias("locator"), column(4).alias("expected"),
    )
    rank = findings.severity_rank(c("severity"))
    made = findings.finding_id(c("skill"), c("check_id"), c("locator"), c("url"))
    order = F.conv(F.substring(made, 4, 6), 16, 10).cast("long")
    return rows.withColumn("seq", F.lit(40 * PART) + rank * 10**10 + order)


def compile_findings(pages: DataFrame) -> DataFrame:
    """Engagement findings of pages (site, ord, url, html, ...)."""
    return findings.make(site_rules(extract(pages_in(pages))))
