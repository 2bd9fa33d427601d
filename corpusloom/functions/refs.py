"""References: find them in free text, normalise them, take URLs apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import SPACE_CLASS, let, rstrip_only, strip, strip_only, text_or_empty

# Punctuation that never ends a pasted link, ASCII then CJK.
TRAILING_PUNCTUATION = ",.;:!?，。；：！？、）)]】》〉」』\"'"
_URL_BODY = rf"[^{SPACE_CLASS}<>\"']+"
_URL = rf"(?i:https?://){_URL_BODY}"
_VIDEO_CODE = r"BV[0-9A-Za-z]{10}"
_ANY_REFERENCE = rf"{_URL}|(?<![0-9A-Za-z]){_VIDEO_CODE}(?![0-9A-Za-z])"
_HTTP_PREFIX = r"^(?i:https?://)"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PLAIN_DOMAIN = (
    r"^(?:www\.)?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,63}"
    rf"(?::[0-9]+)?(?:[/?#][^{SPACE_CLASS}]*)?$"
)


def extract_references(text: Column) -> Column:
    """Ordered, distinct array of links and 12-character video codes in the text."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(_ANY_REFERENCE), F.lit(0))
    cleaned = F.transform(
        found,
        lambda r: F.when(r.rlike(_HTTP_PREFIX), rstrip_only(r, TRAILING_PUNCTUATION)).otherwise(r),
    )
    return F.array_distinct(F.filter(cleaned, lambda r: r != ""))


def first_url(text: Column) -> Column:
    return rstrip_only(F.regexp_extract(text_or_empty(text), _URL, 0), TRAILING_PUNCTUATION)


def unquote_paste(text: Column) -> Column:
    return strip(strip_only(strip(text_or_empty(text)), "\"'"))


def normalize_reference(raw: Column, local_path: Column | None = None) -> Column:
    """One canonical reference per raw input; `local_path` (null if none) wins."""
    # No lambdas here: the result often feeds Python functions, which plain expressions suit.
    value = unquote_paste(raw)
    out = _completed(value, _bare_url(value))
    return out if local_path is None else F.coalesce(local_path, out)


def _bare_url(value: Column) -> Column:
    """First link of the text, else the text, with paste escapes undone."""
    url = F.coalesce(F.nullif(first_url(value), F.lit("")), value)
    url = F.replace(url, F.lit("\\&"), F.lit("&"))
    url = F.replace(url, F.lit("\\?"), F.lit("?"))
    return F.replace(url, F.lit("&amp;"), F.lit("&"))


def _completed(value: Column, url: Column) -> Column:
    return (
        F.when(
            value.rlike(rf"^{_VIDEO_CODE}$"),
            F.concat(F.lit("https://www.bilibili.com/video/"), value),
        )
        .when(url.rlike(_HTTP_PREFIX), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )


def is_plain_domain(text: Column) -> Column:
    return text.rlike(_PLAIN_DOMAIN)


def host_of(url: Column) -> Column:
    """Lower-cased host, empty when there is none. Pure regex: it can never raise."""
    authority = F.regexp_extract(text_or_empty(url), _AUTHORITY, 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    return F.lower(
        F.when(host_port.startswith("["), bracketed).otherwise(
            F.regexp_extract(host_port, r"^[^:]*", 0)
        )
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(
        text_or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def query_of(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^[^?#]*\?([^#]*)", 1)


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of a query parameter, percent-decoded; null when absent."""
    raw = F.regexp_extract(query_of(url), rf"(?:^|&){key}=([^&]+)", 1)
    return F.nullif(F.coalesce(F.try_url_decode(raw), raw), F.lit(""))


# Link cells that mean "no link".
NO_LINK = ("", "—", "本地视频")


def link_key(value: Column) -> Column:
    """Compare key for links: scheme and host fold case, the rest stays exact."""
    return let(strip_only(strip(text_or_empty(value)), "`"), _link_key)


def _link_key(raw: Column) -> Column:
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(raw, _AUTHORITY, 1)
    user = F.regexp_extract(authority, r"^.*@", 0)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host_part = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*)", 0)
    port_part = F.substring(host_port, F.length(host_part) + 1, F.length(host_port))
    query = query_of(raw)
    fragment = F.regexp_extract(raw, r"#(.*)$", 1)
    rebuilt = F.concat(
        scheme,
        F.lit("://"),
        user,
        F.lower(host_part),
        port_part,
        rstrip_only(path_of(raw), "/"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return (
        F.when(raw.isin(*NO_LINK), F.lit(""))
        .when(scheme.isin("http", "https") & (host_of(raw) != ""), rebuilt)
        .otherwise(rstrip_only(raw, "/"))
    )


def product_key(cell: Column) -> Column:
    """Compare key for product paths in index cells."""
    return strip(F.replace(strip_only(strip(text_or_empty(cell)), "`"), F.lit("\\|"), F.lit("|")))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page at `base`."""
    return let(strip(text_or_empty(href)), lambda h: _resolve(base, h))


def _resolve(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^.*/", 0), F.lit("")), F.lit("/"))
    href_path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.regexp_extract(href, r"[?#].*$", 0)
    joined = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path_of(base), href))
        .otherwise(F.concat(origin, let(joined, collapse_dots), tail))
    )


def collapse_dots(path: Column) -> Column:
    """Resolve `.` and `..` path segments."""
    segments = F.filter(F.split(path, "/"), lambda s: s != ".")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(
        path.rlike(r"(?:^|/)\.{1,2}$") & (F.size(folded) > 0), F.concat(F.array_join(folded, "/"), F.lit("/"))
    ).otherwise(F.array_join(folded, "/"))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.regexp_replace(closed, "/+$", "/")).otherwise(path)


def parse_tags(text: Column) -> Column:
    """Delimited tag text to an array; `;` rules when present, else `,`."""
    value = strip(text_or_empty(text))
    parts = F.when(F.contains(value, F.lit(";")), F.split(value, ";")).otherwise(F.split(value, ","))
    return clean_tags(parts)


def clean_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, lambda t: strip(text_or_empty(t))), lambda t: t != "")


def canonical_key(source_type: Column, source_id: Column, reference: Column) -> Column:
    return F.when(
        (text_or_empty(source_type) != "") & (text_or_empty(source_id) != ""),
        F.concat(source_type, F.lit(":"), source_id),
    ).otherwise(reference)


def task_key(
    reference: Column,
    path: Column | None = None,
    size: Column | None = None,
    modified: Column | None = None,
) -> Column:
    """Stable identity: a hash of the reference, or of path, size and time for a file."""
    as_reference = F.concat(F.lit("ref:"), reference)
    if path is None:
        return F.sha2(as_reference, 256)
    as_file = F.concat_ws(":", F.lit("file"), path, size.cast("string"), modified.cast("string"))
    return F.sha2(F.when(path.isNotNull(), as_file).otherwise(as_reference), 256)
