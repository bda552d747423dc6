"""Render-extraction signals and rules: text ratio, shells, media without text, key facts, text diff."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fixed, text as words, urls

from .rules import emit, rule, text

SKILL = "render-extraction-audit"

# Key facts by category, icon fonts, frameworks, image and iframe lists.
KEY_FACTS = (
    ("pricing", "Pricing / Cost", r"\$\d|€\d|£\d|¥\d|₹\d|\bprice\b|\bpricing\b|\bcost\b|\bfee\b|\bplan\b|\bsubscription\b|per month|/mo|/yr|/year|starting at|starts at|from \$|free trial|free tier|free plan|\bquote\b|\bestimate\b|add to cart|buy now|purchase"),
    ("contact", "Contact Information", r"\bphone\b|\bemail\b|\bcontact\b|\baddress\b|\bhours\b|\bschedule\b|call us|reach us|get in touch|\bsupport\b|\bhelpline\b|\bhelpdesk\b|\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b|@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|tel:|mailto:|office hours|business hours|opening hours|mon(day)?\s*[-–]\s*(fri|sun)|\bam\b.*\bpm\b"),
    ("product_identity", "Product / Service Identity", r"\bproduct\b|\bfeatures?\b|\bspecifications?\b|\bspecs?\b|\bmodel\b|\bversion\b|\bedition\b|\bdimensions?\b|\bweight\b|\bcapacity\b|\bwarranty\b|\bguarantee\b|\bavailab(le|ility)\b|in stock|out of stock|\bsku\b|\bpart number\b|\bmpn\b|\bingredients?\b|\bnutrition\b|\bcompatib(le|ility)\b|\brequirements?\b"),
    ("reviews_ratings", "Reviews / Ratings", r"\breview\b|\brating\b|\bstars?\b|\btestimonial\b|customer says|out of 5|out of 10|★|☆|⭐|verified purchase|verified buyer|\brecommend\b|\bhelpful\b|\d+\s+reviews?"),
    ("faq", "FAQ / Help Content", r"\bfaq\b|frequently asked|\bq\s*[&:]\s*a\b|questions? and answers?|how (do|does|can|to)|what (is|are)|\btroubleshoot\b|\bknowledge base\b"),
    ("location", "Location / Directions", r"\blocation\b|\bdirections?\b|\bmap\b|\bfind us\b|\bvisit us\b|\bstore locator\b|\bnearby\b|\bzip\s*code\b|\bpostal\s*code\b|\blatitude\b|\blongitude\b"),
)
ICON_FONTS = (
    ("material_icons", True, ("material-icons", "material-icons-outlined", "material-icons-round", "material-icons-sharp", "material-symbols-outlined", "material-symbols-rounded", "material-symbols-sharp")),
    ("font_awesome", False, ("fa", "fas", "far", "fab", "fal", "fad", "fa-solid", "fa-regular", "fa-brands", "fa-light", "fa-duotone", "fa-thin")),
    ("bootstrap_icons", False, ("bi", "bi-")),
    ("glyphicons", False, ("glyphicon", "glyphicon-")),
    ("icomoon", False, ("icon-", "icomoon")),
)
# label, markers in the page (2 each), in script sources (1 each), more in the page (1 each)
FRAMEWORKS = (
    ("React", ("data-reactroot", "data-reactid", "__react", "react-root"), ("react.production.min.js", "react-dom", "react.development.js"), ("__next_data__", "_next/static", "_next/image")),
    ("Next.js", ("__next_data__", "__next", "data-nextjs-page"), ("_next/static", "_next/webpack", "next/dist"), ("__next_data__",)),
    ("Vue", ("data-v-", "__vue__", "data-server-rendered"), ("vue.min.js", "vue.runtime", "vue.global"), ("__nuxt__", "_nuxt/")),
    ("Nuxt", ("__nuxt__", "__nuxt", "data-n-head"), ("_nuxt/", "nuxt.js"), ("__nuxt__",)),
    ("Angular", ("ng-version", "_nghost", "_ngcontent", "ng-app"), ("angular.min.js", "polyfills", "runtime.js", "main.js"), ()),
    ("Svelte/SvelteKit", ("svelte-", "__svelte"), ("svelte/internal", ".svelte-kit"), ()),
    ("Gatsby", ("___gatsby", "gatsby-"), ("gatsby-", "commons.js", "app.js"), ("___gatsby",)),
    ("Astro", ("astro-island", "data-astro-cid"), ("astro/",), ()),
    ("Remix", ("__remix", "__remixcontext"), ("remix", "__remixmanifest"), ("__remixcontext",)),
)
SCROLL_DATA = ("data-infinite-scroll", "data-load-more", "infinite-scroll-component", "data-infinite", "data-paginate", "data-next-page")
SCROLL_CLASSES = (
    "infinite-scroll", "infinite-scroll-container", "load-more", "load-more-btn", "load-more-button", "infinite-loader",
    "scroll-sentinel", "waypoint", "lazy-load-trigger", "pagination-more", "show-more",
)
GENERIC_ALTS = (
    "image", "photo", "picture", "img", "untitled", "placeholder", "banner", "hero", "screenshot", "graphic", "icon", "logo", "default",
    "thumbnail", "thumb", "pic", "figure",
)
FILE_ALT = r"(?i)\.(jpe?g|png|gif|webp|svg|bmp|tiff?|avif)$"
PIXELS = ("spacer", "pixel", "blank", "transparent", "1x1", "tracking", "beacon", "analytics")
CLOSED_FRAMES = (
    "google.com/maps", "youtube.com", "youtube-nocookie.com", "vimeo.com", "player.vimeo.com", "facebook.com/plugins", "facebook.com/v",
    "twitter.com", "x.com", "platform.twitter.com", "instagram.com", "linkedin.com", "googletagmanager.com", "google-analytics.com",
    "doubleclick.net", "googlesyndication.com", "disqus.com", "spot.im", "recaptcha", "hcaptcha.com", "typeform.com", "calendly.com", "intercom.io", "drift.com", "crisp.chat",
    "hotjar.com", "clarity.ms",
)


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
    return [*parts, pattern[start:]]


def mentions(lower: Column, tokens: Column, pattern: str) -> Column:
    """As lower.rlike(pattern): single words are looked up among the text's words, plain strings searched for, and
    only what is left is a regular expression."""
    single, plain, rest = [], [], []
    for part in _alternatives(pattern):
        if bare := re.fullmatch(r"\\b([a-z]+)\\b", part):
            single.append(bare[1])
        elif optional := re.fullmatch(r"\\b([a-z]+)\?\\b", part):
            single += [optional[1], optional[1][:-1]]
        elif re.fullmatch(r"(?:[^\\.^$*+?{}\[\]|()]|\\\$)+", part):
            plain.append(part.replace("\\$", "$"))
        else:
            rest.append(part)
    out = F.arrays_overlap(tokens, F.array(*map(F.lit, single))) if single else F.lit(False)
    for text in plain:
        out = out | F.contains(lower, F.lit(text))
    return out | lower.rlike("|".join(rest)) if rest else out


def key_facts(body: Column) -> Column:
    """Labels of the fact categories that the text mentions, in the list's order."""
    lower = F.lower(F.coalesce(body, F.lit("")))
    tokens = F.split(lower, r"[^\p{L}\p{N}_]+")
    return F.array_compact(F.array(*[F.when(mentions(lower, tokens, pattern), F.lit(label)) for _, label, pattern in KEY_FACTS]))


def alt_quality(alt: Column, decorative: Column) -> Column:
    lower = F.lower(words.strip(alt))
    return (
        F.when(alt.isNull(), "missing")
        .when(alt == "", F.when(decorative, "empty_decorative").otherwise("empty"))
        .when(lower.isin(*GENERIC_ALTS, *(f"{a}s" for a in GENERIC_ALTS)), "generic")
        .when(words.strip(alt).rlike(FILE_ALT), "filename")
        .when(F.length(alt) < 5, "too_short")
        .when(F.length(alt) > 300, "too_long")
        .otherwise("descriptive")
    )


def is_decorative(image: Column) -> Column:
    small = lambda side: F.when(side.rlike(r"^\d+$"), side.cast("long")).otherwise(9999) <= 5
    pixel = urls.contains_any(F.lower(F.coalesce(image["src"], F.lit(""))), PIXELS) | (small(F.coalesce(image["width"], F.lit(""))) & small(F.coalesce(image["height"], F.lit(""))))
    return F.coalesce(image["role"], F.lit("")).isin("presentation", "none") | (F.lower(F.coalesce(image["aria_hidden"], F.lit(""))) == "true") | pixel


def frameworks(page_html: Column, sources: Column) -> Column:
    """array<struct<framework, score>> of the frameworks with a score of two or more."""
    lower, scripts = F.lower(page_html), F.lower(F.array_join(sources, "\n"))
    out = []
    for label, in_page, in_script, more in FRAMEWORKS:
        score = F.lit(0)
        for marker, where, weight in [*((m, lower, 2) for m in in_page), *((m, scripts, 1) for m in in_script), *((m, lower, 1) for m in more)]:
            score = score + F.contains(where, F.lit(marker)).cast("int") * weight
        out.append(F.struct(F.lit(label).alias("framework"), score.alias("score")))
    return F.filter(F.array(*out), lambda x: x["score"] >= 2)


def css_texts(css: Column) -> Column:
    found = F.regexp_extract_all(css, F.lit(r"(?i)content\s*:\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(F.transform(found, words.strip), lambda t: t.rlike("[a-zA-Z]{2,}") & ~t.isin("none", "normal"))


def icon_library(classes: Column) -> Column:
    lower = F.lower(F.coalesce(classes, F.lit("")))
    return F.coalesce(*[F.when(urls.contains_any(lower, names), F.lit(library)) for library, _, names in ICON_FONTS])


def is_scroll_marker(element: Column) -> Column:
    by_data = F.exists(element["data"], lambda d: d.isin(*SCROLL_DATA))
    return by_data | urls.contains_any(F.lower(F.coalesce(element["class"], F.lit(""))), SCROLL_CLASSES)


def folds(elements: Column) -> Column:
    """array<struct<type, tag, id, open, target, target_tag>> of tabs, panels and folding sections.

    An element counts by its role, else its class, else as details or summary and by its toggle attribute, which may
    both hold; target is the id that it controls and target_tag the element of that id, null if the page has none.
    """

    def named(e: Column) -> Column:
        by_toggle = F.coalesce(e["toggle"].isin(*fixed.FOLD_TOGGLES), F.lit(False)) | F.coalesce(e["bs_toggle"].isin(*fixed.FOLD_TOGGLES), F.lit(False))
        kinds = F.array_compact(F.array(F.when(e["tag"].isin(*fixed.FOLD_TAGS), F.lit("details_summary")), F.when(by_toggle, F.lit("tab_accordion"))))
        role = F.when(e["role"] == "tabpanel", F.array(F.lit("tabpanel"))).when(e["role"].isin("tablist", "tab"), F.array(F.lit("tab")))
        return F.coalesce(role, F.when(urls.contains_any(e["class"], tuple(c.lower() for c in fixed.FOLD_CLASSES)), F.array(F.lit("tab_accordion"))), kinds)

    row = lambda e: F.transform(named(e), lambda k: F.struct(k.alias("type"), e["tag"].alias("tag"), e["id"].alias("id"), e["open"].alias("open"), e["target"].alias("target"), e["target_tag"].alias("target_tag")))
    return F.flatten(F.transform(elements, row))


def is_background(medium: Column) -> Column:
    """A video that only decorates."""
    return (medium["kind"] == "video") & medium["autoplay"] & medium["muted"] & medium["loop"] & ~medium["controls"]


def content_frames() -> Column:
    """Frames that may hold content: not those of known players, maps, widgets and trackers."""
    return F.filter("page.iframes", lambda f: (F.length(f["src"]) > 0) & ~urls.contains_any(F.lower(f["src"]), CLOSED_FRAMES))


def is_cross_origin(frames: Column) -> Column:
    own = F.lower(urls.netloc(F.col("url")))
    return F.exists(frames, lambda f: F.when(urls.netloc(f["src"]) != "", F.lower(urls.netloc(f["src"])) != own).otherwise(f["src"].rlike("^(about|javascript):")))


def text_ratio() -> dict[str, Column]:
    full, main = F.length("page.full_text"), F.col("page.main_length")
    return {
        "full_length": full.cast("long"),
        "main_length": main,
        "boilerplate_length": F.col("page.boilerplate_length"),
        "ratio": words.ratio3(main, full),
        "main_identified": (full > 0) & (main > 100),
    }


def compile_findings(pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Rows for findings.make of parsed pages (site, ord, url, html, page) and rendered pages
    (url, js_text_length, js_preview, ajax_delta, shadow array<struct<tag, length>>, load_more)."""
    p = lambda c: F.col(f"page.{c}")
    c = F.col
    base = pages.filter(~p("render_failed"))
    if rendered is None:
        kinds = {"js_text_length": "long", "js_preview": "string", "ajax_delta": "long", "shadow": "array<struct<tag: string, length: long>>", "load_more": "long"}
        base = base.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    else:
        base = base.join(rendered, "url", "left")
    ratio = text_ratio()
    shell = (ratio["full_length"] < 200) & (F.size(p("script_sources")) > 0) & (F.size(p("containers")) > 0)
    quality = F.when(F.length(p("noscript")) >= 100, "adequate").when(p("has_noscript"), "insufficient").otherwise("missing")
    fw = F.array_join(F.transform(frameworks(c("html"), p("script_sources")), lambda x: x["framework"]), ", ")
    hidden = c("js_text_length")
    js_facts = key_facts(words.strip_widgets(c("js_preview")))
    opaque = F.filter(p("images"), lambda i: ~is_decorative(i) & alt_quality(i["alt"], F.lit(False)).isin("missing", "empty", "generic", "filename"))
    source = lambda i: F.substring(F.coalesce(F.nullif(F.coalesce(i["src"], F.lit("")), F.lit("")), F.nullif(F.coalesce(i["data_src"], F.lit("")), F.lit("")), F.lit("?")), 1, 60)
    no_facts = F.size(key_facts(p("full_text"))) == 0
    canvas = F.filter(p("canvases"), lambda x: ~x["fallback"])
    named = lambda x: F.lower(F.concat_ws(" ", F.coalesce(x["id"], F.lit("")), F.coalesce(x["class"], F.lit(""))))
    silent = F.filter(p("media"), lambda m: ~is_background(m) & ~m["captions"] & ~m["transcript"])
    frames = content_frames()
    cross = is_cross_origin(frames)
    markers = F.filter(p("elements"), is_scroll_marker)
    more = F.coalesce(c("load_more"), F.lit(0))
    ligatures = F.filter(p("elements"), lambda e: icon_library(e["class"]) == "material_icons")
    css = css_texts(p("css_text"))
    pdfs = p("pdf_links")
    hot = F.filter(pdfs, lambda x: urls.contains_any(F.lower(x["text"]), fixed.PDF_FACTS))
    label = lambda x: F.substring(F.when(F.length(x["text"]) > 0, x["text"]).otherwise(x["href"]), 1, 60)
    three = lambda a, f, sep: F.array_join(F.transform(F.slice(a, 1, 3), f), sep)
    full = ratio["full_length"]
    shadow = F.try_element_at(F.filter(c("shadow"), lambda s: s["length"] > 50), F.lit(1))
    rules = [
        rule("RE-02-shell", shell, F.when(quality.isin("missing", "insufficient"), "high").otherwise("medium"), "Page is a JS shell with little server-rendered content", "Server-render or pre-render the page (SSR/SSG), or provide an adequate <noscript> fallback, so crawlers without JS can read the content.", "html", text(F.when(fw == "", "JS framework").otherwise(fw), "; raw text ", full, " chars; noscript: ", quality), "body"),
        rule("RE-01-jsgap", hidden > 50, F.when((F.size(js_facts) > 0) & (hidden >= 200), "high").otherwise("medium"), "Content appears only after JavaScript execution", "Ensure important content is present in the initial HTML (SSR/SSG) so non-JS crawlers can extract it, not just browsers.", "rendered_dom", text(hidden, " chars only in rendered DOM.", F.when(F.size(js_facts) > 0, F.concat(F.lit(" key facts: "), F.array_join(F.array_sort(js_facts), ", "))), " e.g. '", F.substring("js_preview", 1, 160), "'"), "rendered vs raw diff"),
        rule("RE-03-ajax", c("ajax_delta") > 500, "medium", "Large content block loads late via AJAX", "Render or inline late-loading content so crawlers that don't wait for network idle still capture it.", "rendered_dom", text(c("ajax_delta"), " chars arrived after DOMContentLoaded"), "networkidle delta"),
        rule("RE-11-shadow", shadow.isNotNull(), "medium", "Key content lives inside Shadow DOM", "Expose content outside the shadow tree (light DOM / SSR) so simple extractors can read it.", "rendered_dom", text("<", shadow["tag"], "> shadowRoot has ", shadow["length"], " chars"), F.coalesce(shadow["tag"], F.lit("web-component"))),
        rule("RE-04-img-alt", F.size(opaque) > 0, F.when((F.size(opaque) >= 3) & no_facts, "high").otherwise("medium"), text(F.size(opaque), " content image(s) lack usable text alternatives"), "Add descriptive alt text (or a text equivalent) to content-bearing images; if the image carries facts (e.g. a pricing table), also provide those facts as HTML text.", "html", text("alt missing/generic on: ", three(opaque, source, ", ")), "img[alt]"),
        rule("RE-06-canvas", F.size(canvas) > 0, F.when(F.exists(canvas, lambda x: urls.contains_any(named(x), fixed.CANVAS_HINTS)), "high").otherwise("medium"), text(F.size(canvas), " <canvas> element(s) with no text fallback"), "Provide fallback content inside <canvas> (or an adjacent text/table equivalent) so the data is machine-readable.", "html", text("canvas ids/classes: ", three(canvas, lambda x: F.coalesce(F.nullif(F.coalesce(x["id"], F.lit("")), F.lit("")), F.nullif(F.coalesce(x["class"], F.lit("")), F.lit("")), F.lit("canvas")), ", ")), "canvas"),
        rule("RE-07-media", F.size(silent) > 0, "high", text(F.size(silent), " video/audio element(s) without captions or transcript"), "Add a captions/subtitles <track> and a text transcript so information spoken or shown in media is machine-readable.", "html", three(silent, lambda m: F.concat(m["kind"], F.lit(": "), F.substring(F.coalesce(F.nullif(F.coalesce(m["src"], F.lit("")), F.lit("")), F.lit("?")), 1, 60)), "; "), "video/audio"),
        rule("RE-12-iframe", F.size(frames) > 0, F.when(cross, "medium").otherwise("low"), text(F.size(frames), " content iframe(s) embed material from elsewhere"), "Ensure iframe content is also available as crawlable HTML on the page, or link to an indexable source; cross-origin iframe text is not attributed to this page.", "html", three(frames, lambda f: F.substring(f["src"], 1, 60), "; "), "iframe[src]"),
        rule("RE-13-infinite", (F.size(markers) > 0) | (more > 0), "medium", "Listing content is gated behind scroll/Load-More", "Provide crawlable pagination (linked page URLs) so all listing items are reachable without executing scroll/click behavior.", F.when(F.size(markers) > 0, "html").otherwise("rendered_dom"), text(F.size(markers), " static marker(s), ", more, " rendered load-more/sentinel element(s)"), "infinite-scroll"),
        rule("RE-14-nomains", (full > 500) & ~ratio["main_identified"], "medium", "No identifiable main content region", "Wrap primary content in <main>/<article> so extractors can separate it from navigation, headers, and footers.", "html", text("main content ", ratio["main_length"], "/", full, " chars"), "main"),
        rule("RE-14-boilerplate", (full > 500) & ratio["main_identified"] & (ratio["ratio"] < 0.30), "low", "Boilerplate dominates the page text", "Increase unique main-content density; heavy nav/footer/legal boilerplate dilutes the extractable signal.", "html", text("main content ratio ", F.bround(ratio["ratio"] * 100, 0).cast("long"), "%"), "main"),
        rule("RE-09-pseudotext", (F.size(ligatures) > 0) | (F.size(css) > 0), "low", "Text conveyed via icon-font ligatures / CSS content", "Avoid conveying real words through icon ligatures or CSS ::before/::after content; put them in HTML text where extractors can read them.", "html", F.concat_ws("; ", F.when(F.size(ligatures) > 0, text(F.size(ligatures), " ligature icon element(s)")), F.when(F.size(css) > 0, text(F.size(css), " CSS content: declaration(s)"))), "::before / icon font"),
        rule("RE-08-pdf", F.size(pdfs) > 0, F.when(F.size(hot) > 0, "medium").otherwise("low"), text(F.size(pdfs), " PDF link(s) may hold facts not summarized in HTML"), "Summarize key PDF facts as HTML on the linking page so crawlers don't have to parse the PDF to extract them.", "html", three(F.when(F.size(hot) > 0, hot).otherwise(pdfs), label, "; "), "a[href$=.pdf]"),
    ]
    return emit(base, SKILL, rules)
