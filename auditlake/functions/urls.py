"""URL functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), f"(?s){_PARTS}", group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host without user information and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))



def defrag(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


_ABSOLUTE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def join(base: Column, reference: Column) -> Column:
    """The address that a reference on the page `base` (http or https) means, by RFC 3986, section 5.

    Dot segments are folded over a stack of segments. Tabs and line breaks and leading blanks of a reference
    count for nothing, as do an empty query and an empty fragment; empty segments inside a path that is relative to
    the page's are dropped. A reference of another scheme is kept as it is. Null if either is null.
    """
    ref = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda text, k: F.regexp_extract(text, _ABSOLUTE, k)
    scheme_, place, given = F.lower(part(ref, 1)), part(ref, 2), part(ref, 3)
    own = F.lower(part(base, 1))
    cut = F.split(part(base, 3), "/")
    above = F.when(F.element_at(cut, -1) == "", cut).otherwise(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))))
    named = F.split(given, "/")
    joined_ = F.concat(above, named)
    last = F.element_at(named, -1)
    inner = F.filter(F.slice(joined_, 2, F.greatest(F.size(joined_) - 2, F.lit(0))), lambda x: x != "")
    below = F.when(F.size(joined_) < 2, joined_).otherwise(F.concat(F.slice(joined_, 1, 1), inner, F.array(last)))
    segments_ = F.when(given.startswith("/"), named).otherwise(below)
    folded = F.aggregate(
        segments_,
        F.array().cast("array<string>"),
        lambda stack, x: F.when(x == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(x == ".", stack).otherwise(F.array_append(stack, x)),
    )
    resolved = F.array_join(F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded), "/")
    rooted = lambda path_: F.when((path_ == "") | path_.startswith("/"), path_).otherwise(F.concat(F.lit("/"), path_))
    tail = lambda mark, text: F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(mark), text))
    fragment = tail("#", part(ref, 5))
    there = F.concat(own, F.lit("://"), part(base, 2))
    same = (scheme_ == "") | (scheme_ == own)
    return (
        F.when(base.isNull() | reference.isNull(), F.lit(None))
        .when(reference == "", base)
        .when(~same, reference)
        .when(place != "", F.concat(own, F.lit("://"), place, rooted(given), tail("?", part(ref, 4)), fragment))
        .when(given == "", F.concat(there, rooted(part(base, 3)), F.when(part(ref, 4) == "", tail("?", part(base, 4))).otherwise(tail("?", part(ref, 4))), fragment))
        .otherwise(F.concat(there, rooted(F.when(resolved == "", F.lit("/")).otherwise(resolved)), tail("?", part(ref, 4)), fragment))
    )


def registered_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def same_site(candidate: Column, page: Column) -> Column:
    bare = lambda u: F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")
    return scheme(candidate).isin("http", "https") & (bare(candidate) == bare(page))


def origin(url: Column) -> Column:
    """scheme://host:port, the port written out."""
    known = F.when(scheme(url) == "https", F.lit("443")).otherwise(F.lit("80"))
    given = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), F.when(given == "", known).otherwise(given))


def normalize_input(raw: Column) -> Column:
    """Adds https:// if no scheme is there; keeps origin and path."""
    raw = F.regexp_replace(raw, r"^\s+|\s+$", "")
    full = F.when(raw.rlike(r"^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return F.concat(scheme(full), F.lit("://"), netloc(full), F.when(path(full) == "", F.lit("/")).otherwise(path(full)))


def _pairs(url: Column) -> Column:
    """Decoded (key, value) pairs of the query, blank values kept; what holds a malformed escape stays as it is."""
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    parts = F.filter(F.split(query(url), "&"), lambda p: F.length(p) > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.instr(p, "=") > 0, decoded(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise(F.lit("")).alias("v"),
        ),
    )


def _quote(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize(url: Column, drop_tracking: bool = True) -> Column:
    """Crawl identity: lower scheme and host, no default port, sorted query, no fragment."""
    pairs = _pairs(url)
    if drop_tracking:
        pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*fixed.TRACKING_IN_IDENTITY))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_quote(p["k"]), F.lit("="), _quote(p["v"]))), "&")
    given = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    default = ((scheme(url) == "http") & (given == "80")) | ((scheme(url) == "https") & (given == "443")) | (given == "")
    place = F.concat(host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), given)))
    return F.concat(
        F.when(scheme(url) == "", F.lit("")).otherwise(F.concat(scheme(url), F.lit(":"))),
        F.when((place == "") & (scheme(url) == ""), F.lit("")).otherwise(F.concat(F.lit("//"), place)),
        F.when(path(url) == "", F.lit("/")).otherwise(path(url)),
        F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)),
    )


def query_keys(url: Column) -> Column:
    """Distinct keys with a value that is not blank."""
    return F.array_distinct(F.transform(F.filter(_pairs(url), lambda p: F.length(p["v"]) > 0), lambda p: p["k"]))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: F.length(s) > 0)


def depth(url: Column) -> Column:
    return F.size(segments(url))


def first_section(url: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("root"))


def date_rank(url: Column) -> Column:
    """-YYYYMMDD of a /20YY/M/D/ path, else 0: newer paths sort first."""
    found = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
    at = path(url)
    digits = F.concat(F.regexp_extract(at, found, 1), F.lpad(F.regexp_extract(at, found, 2), 2, "0"), F.lpad(F.regexp_extract(at, found, 3), 2, "0"))
    return F.when(at.rlike(found), -digits.cast("int")).otherwise(F.lit(0))


def canonical_match(href: Column, url: Column) -> Column:
    bare = lambda u: F.regexp_replace(defrag(u), "/+$", "")
    return bare(href) == bare(url)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def is_home(url: Column) -> Column:
    return F.trim(path(url)).isin(*fixed.HOME_PATHS)


def is_auth(url: Column) -> Column:
    return path(url).rlike("(?i)" + fixed.AUTH_PATH) | query(url).rlike("(?i)" + fixed.AUTH_QUERY)


def is_utility_social(url: Column) -> Column:
    at = F.regexp_replace(F.lower(path(url)), "/+$", "")
    return contains_any(F.lower(query(url)), ("q=", "query=", "search=", "s=")) | matches_any(at, fixed.UTILITY_SOCIAL)


def is_utility_engagement(url: Column) -> Column:
    return matches_any(F.lower(path(url)), fixed.UTILITY_ENGAGEMENT)


def is_utility_freshness(url: Column) -> Column:
    return matches_any(F.lower(path(url)), fixed.UTILITY_FRESHNESS)


def is_evergreen(url: Column) -> Column:
    return matches_any(F.regexp_replace(F.lower(path(url)), "/+$", ""), fixed.EVERGREEN)


def is_commercial_freshness(url: Column) -> Column:
    return contains_any(F.lower(url), fixed.COMMERCIAL_FRESHNESS)


def is_archived_editorial(url: Column, age_months: Column, as_of_year: Column) -> Column:
    """News or blog path that is old by its year or by its date."""
    at = F.lower(path(url))
    year = F.regexp_extract(at, r"/(19\d{2}|20\d{2})(?:/|$)", 1)
    old = F.when(year == "", F.lit(False)).otherwise(year.cast("int") <= as_of_year - 2)
    return contains_any(at, fixed.EDITORIAL_ARCHIVE) & (old | F.coalesce(age_months >= 24, F.lit(False)))


def is_editorial_permalink(url: Column, kind: Column) -> Column:
    dated = F.lower(path(url)).rlike(r"/(?:19|20)\d{2}/(?:0?[1-9]|1[0-2])(?:/|$)")
    return (kind == "editorial") & (dated | (depth(url) >= 2))


def is_suppressed(at: Column) -> Column:
    out = F.lit(False)
    for start in fixed.SUPPRESSED_PATHS:
        out = out | F.lower(at).startswith(start)
    return out


def is_safe(url: Column) -> Column:
    """Whether the address policy lets a URL be fetched, as far as its text tells (no name lookup)."""
    place = netloc(url)
    name = F.regexp_replace(F.lower(host(url)), r"^\[|\]$|\.$", "")
    given = F.regexp_extract(place, r":(\d*)$", 1)
    octets = F.split(name, r"\.")
    number = lambda i: F.try_element_at(octets, F.lit(i)).cast("int")
    is_v4 = name.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    # other numeric forms (one number, hex, octal, fewer parts) may name a private address
    is_number = name.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$")
    too_large = F.exists(octets, lambda o: o.cast("int") > 255)
    a, b = number(1), number(2)
    private = (
        a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 100) & b.between(64, 127))
        | (a >= 224)
    )
    is_v6 = F.contains(name, F.lit(":"))
    closed_v6 = name.rlike(r"(?i)^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|::ffff:.*)$")
    return (
        scheme(url).isin("http", "https")
        & ~F.contains(place, F.lit("@"))
        & (given.isin("", "80", "443") | F.contains(place, F.lit("]")) & ~place.rlike(r"\]:\d+$"))
        & (name != "")
        & ~F.when(is_v4, private | too_large).when(is_v6, closed_v6).otherwise(is_number | (name == "localhost") | name.endswith(".localhost"))
    )
