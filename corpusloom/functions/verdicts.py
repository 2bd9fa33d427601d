"""Ordered decisions: error classes, acquisition choice, media checks, read state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import text_or_empty

# Fixed values: (code, retryable, fragments), first match wins, on the lower-cased message.
ERROR_RULES = (
    ("rate_limited", True, ("429", "too many requests")),
    ("transient_network", True, ("502", "503", "504", "temporarily unavailable")),
    ("auth_required", False, ("cookie", "登录", "login", "auth")),
    ("invalid_media", False, ("无音轨", "invalid media", "媒体候选")),
    ("transcription_failed", False, ("asr", "转写")),
)
# Error kinds that decide before the message is read.
ERROR_KINDS = (
    ("unsupported", False, ("SourceUnavailableError", "UnsupportedURLError")),
    ("input_missing", False, ("FileNotFoundError",)),
    ("timeout", True, ("TimeoutError",)),
)


def _any_of(text: Column, fragments) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.contains(text, F.lit(fragment))
    return hit


def error_class(message: Column, kind: Column | None = None) -> Column:
    """Struct(code, retryable) of a failed attempt."""
    lower = F.lower(text_or_empty(message))
    verdict = lambda code, again: F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    chain = None
    if kind is not None:
        for code, again, kinds in ERROR_KINDS:
            hit = kind.isin(*kinds)
            chain = F.when(hit, verdict(code, again)) if chain is None else chain.when(hit, verdict(code, again))
    for code, again, fragments in ERROR_RULES:
        hit = _any_of(lower, fragments)
        chain = F.when(hit, verdict(code, again)) if chain is None else chain.when(hit, verdict(code, again))
    return chain.otherwise(verdict("failed", False))


def access_class(message: Column) -> Column:
    """Why a video download was refused."""
    lower = F.lower(text_or_empty(message))
    return (
        F.when(_any_of(lower, ("not a bot",)), "auth")
        .when(
            _any_of(lower, ("cookie",))
            & _any_of(lower, ("expired", "invalid", "login", "sign in", "authentication")),
            "cookie",
        )
        .when(_any_of(lower, ("429", "too many requests")), "rate_limit")
        .when(
            _any_of(lower, ("nsig", "signature", "javascript runtime", "js challenge", "challenge solver")),
            "js",
        )
        .when(_any_of(lower, ("po token", "proof of origin", "http error 403", "forbidden")), "playback")
        .when(_any_of(lower, ("sign in", "login")), "auth")
        .otherwise("download")
    )


def clipped_message(message: Column, limit: int | None = None) -> Column:
    """The message, never null; cut to `limit` characters if given."""
    return text_or_empty(message) if limit is None else F.left(text_or_empty(message), F.lit(limit))


def acquisition_choice(
    n_manual: Column, n_auto: Column, probe_error: Column, strict: Column
) -> Column:
    """Subtitles first. A failed probe means speech recognition, or failure when `strict`."""
    failed = text_or_empty(probe_error) != ""
    return (
        F.when(failed & strict, "failed")
        .when(failed, "asr")
        .when(F.coalesce(n_manual, F.lit(0)) > 0, "manual")
        .when(F.coalesce(n_auto, F.lit(0)) > 0, "auto")
        .otherwise("asr")
    )


# Fixed value: a body below this length asks for the rendered capture.
THIN_BODY = 120


def is_thin(body: Column) -> Column:
    return F.length(text_or_empty(body)) < THIN_BODY


def is_direct_media(url: Column, content_type: Column, resource_type: Column) -> Column:
    """A browser response that is one regular media file."""
    link, ctype = F.lower(text_or_empty(url)), F.lower(text_or_empty(content_type))
    rtype = F.lower(text_or_empty(resource_type))
    looks_like = (
        (rtype == "media")
        | ctype.startswith("audio/")
        | ctype.startswith("video/")
        | _any_of(link, ("douyinvod", ".mp4", ".m4a", ".mp3"))
    )
    streamed = F.contains(link, F.lit(".m3u8")) | F.contains(ctype, F.lit("mpegurl"))
    return (link.startswith("http://") | link.startswith("https://")) & ~streamed & looks_like


def episode_audio_check(has_audio: Column, actual: Column, expected: Column) -> Column:
    """Struct(verdict, reason) for a downloaded episode."""
    actual = F.coalesce(actual.try_cast("double"), F.lit(0.0))
    expected = F.coalesce(expected.try_cast("double"), F.lit(0.0))
    off = F.abs(actual - expected) > F.greatest(F.lit(30.0), expected * 0.1)
    reason = (
        F.when(~F.coalesce(has_audio, F.lit(False)), "no_audio")
        .when(actual <= 0.5, "bad_duration")
        .when((expected >= 60) & (actual < expected * 0.9), "truncated")
        .when((expected != 0) & off, "duration_differs")
        .otherwise("")
    )
    verdict = F.when(reason == "", "ok").when(reason == "duration_differs", "warn").otherwise("reject")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def short_video_check(has_audio: Column, actual: Column, expected: Column) -> Column:
    """Struct(verdict, reason) for one short-video candidate."""
    actual = F.coalesce(actual.try_cast("double"), F.lit(0.0))
    expected = F.coalesce(expected.try_cast("double"), F.lit(0.0))
    reason = (
        F.when(~F.coalesce(has_audio, F.lit(False)), "no_audio")
        .when(actual <= 0.5, "bad_duration")
        .when((expected >= 3) & (actual < expected * 0.5), "too_short")
        .otherwise("")
    )
    verdict = F.when(reason == "", "ok").otherwise("reject")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def is_live(is_live_flag: Column, live_status: Column) -> Column:
    return F.coalesce(is_live_flag, F.lit(False)) | text_or_empty(live_status).isin(
        "is_live", "is_upcoming", "post_live"
    )


# Names of the archive methods and the read flags.
REFINEMENT, DEEP_READ, UNPROCESSED = "Refinement", "DeepRead + Learning", "未处理"
READ_YES, READ_NO = "是", "否"


def processing_method(method: Column, refinement: Column, deep_read: Column, learning: Column) -> Column:
    has = lambda c: text_or_empty(c) != ""
    return (
        F.when((method == REFINEMENT) & has(refinement), REFINEMENT)
        .when((method == DEEP_READ) & has(deep_read) & has(learning), DEEP_READ)
        .otherwise(UNPROCESSED)
    )


def read_flag(method: Column) -> Column:
    return F.when(method != UNPROCESSED, READ_YES).otherwise(READ_NO)
