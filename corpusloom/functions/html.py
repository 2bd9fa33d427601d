"""Page facts read with JVM regular expressions; nothing here leaves whole-stage Spark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .refs import host_of, path_of, resolve_link
from .routing import suffix_of
from .strings import decode_entities, first_filled, strip, text_or_empty

_META = r"(?is)<meta\b[^>]*>"
_HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![^>]*>"
# Fixed value: title used when a page names nothing.
WEB_TITLE = "网页"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag's text, entities decoded; empty when absent."""
    return decode_entities(raw_attribute(tag, name))


def raw_attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def meta_tags(html: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(html), F.lit(_META), F.lit(0))


def meta_content(tags: Column, *, prop: str = "", name: str = "") -> Column:
    """Content of the first meta tag with this property or name."""
    key, value = ("property", prop) if prop else ("name", name)
    hits = F.filter(tags, lambda t: raw_attribute(t, key) == value)
    values = F.transform(F.slice(hits, 1, 1), lambda t: strip(attribute(t, "content")))
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(text_or_empty(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return strip(decode_entities(raw))


def document_title(html: Column, tags: Column, url: Column) -> Column:
    return first_filled(
        meta_content(tags, prop="og:title"),
        meta_content(tags, name="twitter:title"),
        page_title(html),
        host_of(url),
        F.lit(WEB_TITLE),
    )


def document_author(tags: Column) -> Column:
    return first_filled(meta_content(tags, name="author"), meta_content(tags, prop="article:author"))


def document_published(tags: Column) -> Column:
    return first_filled(
        meta_content(tags, prop="article:published_time"), meta_content(tags, name="date")
    )


def visible_text(html: Column, sep: str = " ") -> Column:
    """All visible strings of the fragment, each stripped, joined by `sep`."""
    shown = F.regexp_replace(text_or_empty(html), _HIDDEN, "\u0001")
    cut = decode_entities(F.regexp_replace(shown, "(?s)<[/a-zA-Z][^>]*>", "\u0001"))
    clean = F.transform(F.split(cut, "\u0001+", -1), lambda p: strip(p))
    return F.array_join(F.filter(clean, lambda p: p != ""), sep)


def tags_of(html: Column, name: str) -> Column:
    """Opening tags of one element name, outside scripts and comments."""
    shown = F.regexp_replace(text_or_empty(html), _HIDDEN, "")
    return F.regexp_extract_all(shown, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def links(html: Column, url: Column) -> Column:
    """Ordered array of struct(kind, raw, resolved) for anchors and images."""
    shown = F.regexp_replace(text_or_empty(html), _HIDDEN, "")
    found = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:a|img)\b[^>]*>"), F.lit(0))

    def one(tag: Column) -> Column:
        image = tag.rlike(r"(?i)^<img\b")
        raw = F.when(image, attribute(tag, "src")).otherwise(attribute(tag, "href"))
        present = F.when(image, tag.rlike(r"(?i)[\s\"']src\s*=")).otherwise(tag.rlike(r"(?i)[\s\"']href\s*="))
        return F.struct(
            F.when(image, F.lit("img")).otherwise(F.lit("a")).alias("kind"),
            F.when(present, raw).alias("raw"),
        )

    kept = F.filter(F.transform(found, one), lambda l: l["raw"].isNotNull())
    return F.transform(
        kept,
        lambda l: F.struct(
            l["kind"].alias("kind"), l["raw"].alias("raw"), resolve_link(url, l["raw"]).alias("resolved")
        ),
    )


def image_sources(html: Column) -> Column:
    """Distinct http images in page order; lazy `data-src` wins, inline data is dropped."""
    lazy = lambda t: attribute(t, "data-src")
    sources = F.transform(
        tags_of(html, "img"),
        lambda t: F.when(lazy(t) != "", lazy(t)).otherwise(attribute(t, "src")),
    )
    return F.array_distinct(F.filter(sources, lambda s: s.startswith("http")))


def image_extension(url: Column, content_type: Column) -> Column:
    declared = F.lower(F.regexp_extract(url, r"wx_fmt=(\w+)", 1))
    suffix = suffix_of(path_of(url))
    ctype = text_or_empty(content_type)
    return (
        F.when(declared != "", declared)
        .when(suffix.rlike(r"^\p{L}{1,5}$"), suffix)
        .when(F.contains(ctype, F.lit("jpeg")) | F.contains(ctype, F.lit("jpg")), "jpg")
        .when(F.contains(ctype, F.lit("gif")), "gif")
        .when(F.contains(ctype, F.lit("webp")), "webp")
        .otherwise("png")
    )


def rewrite_images(body: Column, image_map: Column) -> Column:
    """Replace each remote image address by its local path, in map order."""
    entries = F.map_entries(F.coalesce(image_map, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, body, lambda acc, e: F.replace(acc, e["key"], e["value"]))


# Scripts that carry a creation time, tried in this order.
CREATE_TIME = (
    r"create_time\s*[:=]\s*['\"]?(\d{9,11})",
    r"createTime\s*[:=]\s*['\"]?(\d{9,11})",
    r"\bct\s*[:=]\s*['\"]?(\d{9,11})",
)
# Visible time formats that are rewritten to one form.
VISIBLE_TIMES = ("MMM d, yyyy, h:mm a", "MMM d, yyyy h:mm a", "yyyy-MM-dd HH:mm:ss")


def create_epoch(html: Column) -> Column:
    return F.coalesce(
        *[F.nullif(F.regexp_extract(html, p, 1), F.lit("")).try_cast("long") for p in CREATE_TIME]
    )


def normalize_visible_time(text: Column) -> Column:
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in VISIBLE_TIMES])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), text)


def epoch_text(seconds: Column, offset: int = 8 * 3600) -> Column:
    """`YYYY-MM-DD HH:MM:SS` of an epoch at a fixed offset, free of the session zone."""
    shifted = seconds + F.lit(offset)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(shifted / F.lit(86400)).cast("int"))
    rest = F.pmod(shifted, F.lit(86400))
    return F.format_string(
        "%s %02d:%02d:%02d",
        day.cast("string"),
        F.floor(rest / F.lit(3600)).cast("long"),
        F.floor((rest % 3600) / F.lit(60)).cast("long"),
        (rest % 60).cast("long"),
    )


def element_text(html: Column, element_id: str) -> Column:
    """Visible text of the first element with this id (elements that hold no nested tag of the same name)."""
    pattern = rf"""(?is)<(\w+)\b[^>]*\bid\s*=\s*["']{element_id}["'][^>]*>(.*?)</\1\s*>"""
    return visible_text(F.regexp_extract(text_or_empty(html), pattern, 2), sep="")


def article_meta(html: Column) -> Column:
    """Struct(title, author, publish_time, publish_epoch) of a rendered article page."""
    shown = element_text(html, "publish_time")
    epoch = create_epoch(html)
    return F.struct(
        element_text(html, "activity-name").alias("title"),
        element_text(html, "js_name").alias("author"),
        F.when(shown != "", normalize_visible_time(shown))
        .otherwise(F.coalesce(epoch_text(epoch), F.lit("")))
        .alias("publish_time"),
        epoch.alias("publish_epoch"),
    )
