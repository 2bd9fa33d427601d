"""Captured JSON payloads to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .refs import path_of
from .routing import SHORT_VIDEO_PATH, canonical_video_url
from .strings import first_filled, let, strip, text_or_empty
from .verdicts import is_live

VIEW_SCHEMA = (
    "code int, message string, data struct<title:string, desc:string, duration:string, "
    "owner:struct<name:string>, pages:array<struct<page:int, part:string, duration:string>>>"
)
INFO_SCHEMA = (
    "_type string, id string, title string, uploader string, channel string, duration string, "
    "description string, is_live boolean, live_status string, "
    "formats array<struct<acodec:string, vcodec:string>>"
)
PROBE_SCHEMA = "format struct<duration:string>, streams array<struct<codec_type:string>>"
# Titles used when a payload names nothing, and where metadata came from.
SHORT_VIDEO_TITLE = "抖音视频"
DETAIL_ORIGIN = "Playwright 浏览器详情响应"
PAGE_ORIGIN = "Playwright DOM 媒体地址"


def whole_seconds(value: Column) -> Column:
    """Integer part of a number given as text; 0 when it is none."""
    return F.coalesce(F.nullif(strip(text_or_empty(value)), F.lit("")).try_cast("double").cast("long"), F.lit(0))


def _seconds(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def probe_info(payload: Column) -> Column:
    """Struct(duration, has_audio, has_video) of a media probe; 0 when unreadable."""
    p = F.from_json(payload, PROBE_SCHEMA)
    has = lambda kind: F.coalesce(F.exists(p["streams"], lambda s: s["codec_type"] == kind), F.lit(False))
    return F.struct(
        _seconds(p["format"]["duration"]).alias("duration"),
        has("audio").alias("has_audio"),
        has("video").alias("has_video"),
    )


def view_info(payload: Column, code: Column, part: Column) -> Column:
    """Metadata of one video part from the official view payload.

    `status` is ok, unavailable (a fallback may be used) or missing_part (it may not).
    """
    v = F.from_json(payload, VIEW_SCHEMA)
    d = v["data"]
    listed = F.coalesce(d["pages"], F.array())
    single = F.array(
        F.struct(
            F.lit(1).alias("page"), F.lit(None).cast("string").alias("part"), d["duration"].alias("duration")
        )
    )
    pages = F.when(F.size(listed) > 0, d["pages"]).otherwise(single)
    page = F.get(F.filter(pages, lambda p: p["page"] == part.cast("int")), F.lit(0))
    no_data = d.isNull() | ((F.size(listed) == 0) & d["duration"].isNull())
    status = (
        F.when(F.coalesce(v["code"] != 0, F.lit(True)) | no_data, "unavailable")
        .when(page.isNull(), "missing_part")
        .otherwise("ok")
    )
    suffix = F.when(
        F.size(pages) > 1,
        F.concat(F.lit(" - P"), part.cast("string"), F.lit(" "), text_or_empty(page["part"])),
    ).otherwise("")
    ok = status == "ok"
    return F.struct(
        status.alias("status"),
        F.when(ok, F.concat(first_filled(d["title"], code), suffix)).alias("title"),
        F.when(ok, strip(text_or_empty(d["owner"]["name"]))).alias("uploader"),
        F.when(ok, whole_seconds(page["duration"])).alias("duration"),
        F.when(ok, strip(text_or_empty(d["desc"]))).alias("description"),
    )


def part_url(code: Column, part: Column) -> Column:
    return F.concat(F.lit("https://www.bilibili.com/video/"), code, F.lit("?p="), part.cast("string"))


def fallback_info(payload: Column, code: Column) -> Column:
    """Same columns as `view_info`, from a generic downloader payload."""
    i = F.from_json(payload, INFO_SCHEMA)
    return F.struct(
        strip(first_filled(i["title"], code)).alias("title"),
        strip(first_filled(i["uploader"], i["channel"])).alias("uploader"),
        whole_seconds(i["duration"]).alias("duration"),
        strip(text_or_empty(i["description"])).alias("description"),
    )


def generic_info(payload: Column, url: Column) -> Column:
    """Metadata of one video; `status` tells playlists and live items apart."""
    i = F.from_json(payload, INFO_SCHEMA)
    sound = F.filter(
        F.coalesce(i["formats"], F.array()), lambda f: F.coalesce(f["acodec"], F.lit("none")) != "none"
    )
    status = (
        F.when(i.isNull() | text_or_empty(i["_type"]).isin("playlist", "multi_video"), "not_single")
        .when(is_live(i["is_live"], i["live_status"]), "live")
        .otherwise("ok")
    )
    return F.struct(
        status.alias("status"),
        text_or_empty(i["id"]).alias("id"),
        first_filled(i["title"], i["id"]).alias("title"),
        first_filled(i["uploader"], i["channel"]).alias("uploader"),
        _seconds(i["duration"]).alias("duration"),
        text_or_empty(i["description"]).alias("description"),
        canonical_video_url(url).alias("url"),
        F.size(sound).alias("audio_formats"),
    )


def _address_list(detail: Column, path: str) -> Column:
    """http(s) addresses below a `url_list` given as a list, one string or an object."""
    base = f"{path}.url_list"
    pick = lambda p, t: F.try_variant_get(detail, p, t)
    named = F.array(*[pick(f"{base}.{k}", "string") for k in ("main_url", "backup_url", "fallback_url")])
    kind = F.schema_of_variant(F.try_variant_get(detail, base, "variant"))
    raw = (
        F.when(kind.startswith("ARRAY"), pick(base, "array<string>"))
        .when(kind == "STRING", F.array(pick(base, "string")))
        .when(kind.startswith("OBJECT"), named)
    )
    raw = F.coalesce(raw, F.array().cast("array<string>"))
    return F.transform(
        F.filter(raw, lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False))), lambda u: strip(u)
    )


def short_video_detail(payload: Column) -> Column:
    """Struct of a short-video detail response; video addresses come before the music one."""
    v = F.try_parse_json(payload)
    text = lambda path: text_or_empty(F.try_variant_get(v, path, "string"))
    number = lambda path: F.try_variant_get(v, path, "double")
    root = "$.aweme_detail"
    duration = F.coalesce(
        F.nullif(number(f"{root}.duration"), F.lit(0.0)), number(f"{root}.video.duration"), F.lit(0.0)
    )
    addresses = F.concat(
        _address_list(v, f"{root}.video.play_addr_h264"),
        _address_list(v, f"{root}.video.play_addr"),
        _address_list(v, f"{root}.video.download_addr"),
        _address_list(v, f"{root}.music.play_url"),
    )
    found = F.struct(
        text(f"{root}.aweme_id").alias("video_id"),
        strip(text(f"{root}.desc")).alias("title"),
        strip(text(f"{root}.desc")).alias("description"),
        strip(text(f"{root}.author.nickname")).alias("author"),
        (duration / 1000).alias("duration"),
        F.array_distinct(addresses).alias("media_candidates"),
        F.lit(DETAIL_ORIGIN).alias("acquisition"),
    )
    is_detail = F.schema_of_variant(F.try_variant_get(v, root, "variant")).startswith("OBJECT")
    return F.when(is_detail, found)


def merge_candidates(
    detail: Column, page_media: Column, network: Column, final_url: Column
) -> Column:
    """Struct(media_candidates, media_url, saw_blob): detail, then page, then network addresses."""
    from .refs import resolve_link

    none = F.array().cast("array<string>")
    ordered = F.concat(F.coalesce(detail, none), F.coalesce(page_media, none), F.coalesce(network, none))
    values = F.filter(F.transform(ordered, lambda u: strip(text_or_empty(u))), lambda u: u != "")
    direct = F.filter(values, lambda u: ~u.startswith("blob:"))
    resolved = F.transform(direct, lambda u: resolve_link(final_url, u))
    kept = F.array_distinct(F.filter(resolved, lambda u: u.rlike("^https?://")))
    return F.struct(
        kept.alias("media_candidates"),
        F.coalesce(F.get(kept, F.lit(0)), F.lit("")).alias("media_url"),
        F.exists(values, lambda u: u.startswith("blob:")).alias("saw_blob"),
    )


def page_media(videos: Column) -> Column:
    """Addresses of player elements in reading order: current, src, sources."""
    return F.flatten(
        F.transform(
            videos,
            lambda v: F.concat(
                F.array(v["current_src"], v["src"]),
                F.coalesce(v["sources"], F.array().cast("array<string>")),
            ),
        )
    )


def page_snapshot(
    title: Column,
    description: Column,
    author: Column,
    canonical_url: Column,
    final_url: Column,
    duration: Column,
    videos: Column,
    acquisition: Column,
) -> Column:
    """Cleaned page facts of a short video; duration falls back to the longest player."""
    link = strip(first_filled(canonical_url, final_url))
    video = first_filled(
        F.regexp_extract(path_of(link), SHORT_VIDEO_PATH, 1),
        F.regexp_extract(path_of(final_url), SHORT_VIDEO_PATH, 1),
    )
    longest = F.array_max(F.transform(videos, lambda v: F.coalesce(v["duration"].try_cast("double"), F.lit(0.0))))
    given = F.coalesce(duration, F.lit(0.0))
    return F.struct(
        video.alias("video_id"),
        first_filled(strip(text_or_empty(title)), F.lit(SHORT_VIDEO_TITLE)).alias("title"),
        strip(text_or_empty(author)).alias("author"),
        strip(text_or_empty(description)).alias("description"),
        link.alias("canonical_url"),
        F.when(given != 0, given)
        .otherwise(F.greatest(F.coalesce(longest, F.lit(0.0)), F.lit(0.0)))
        .alias("duration"),
        first_filled(acquisition, F.lit(PAGE_ORIGIN)).alias("acquisition"),
    )


def reply_json(reply: Column) -> Column:
    """The JSON object inside a model reply: fences off, first `{` to last `}`."""
    plain = F.regexp_replace(strip(text_or_empty(reply)), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    body = F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return let(F.try_parse_json(body), lambda v: F.when(is_object(v), v))


def chat_reply(payload: Column) -> Column:
    """Text of a chat-shaped response (content as one string or as text parts)."""
    v = F.try_parse_json(payload)
    plain = F.try_variant_get(v, "$.choices[0].message.content", "string")
    parts = F.from_json(
        payload, "choices array<struct<message:struct<content:array<struct<text:string>>>>>"
    )
    listed = F.array_join(
        F.transform(F.get(parts["choices"], F.lit(0))["message"]["content"], lambda p: text_or_empty(p["text"])), ""
    )
    kind = F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant"))
    return strip(F.when(kind.startswith("ARRAY"), listed).otherwise(plain))


def responses_reply(payload: Column) -> Column:
    """Text of a responses-shaped payload: `output_text`, else its text items line by line."""
    r = F.from_json(
        payload,
        "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>",
    )
    items = F.flatten(
        F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array()))
    )
    texts = F.transform(
        F.filter(items, lambda c: c["type"].isin("output_text", "text")), lambda c: text_or_empty(c["text"])
    )
    return strip(F.coalesce(r["output_text"], F.array_join(texts, "\n"), F.lit("")))


EDIT_SCHEMA = "array<variant>"


def proposed_edits(reply: Column) -> Column:
    """Array of variants below `edits`; null when the reply is unusable."""
    return F.try_variant_get(reply_json(reply), "$.edits", EDIT_SCHEMA)
