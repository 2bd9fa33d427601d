"""Pieces of DuckDB SQL shared by the checks."""

from __future__ import annotations

PUNCTUATION = ",.;:!?，。；：！？、）)]】》〉」』\"'".replace("'", "''")
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def authority(e: str) -> str:
    return f"regexp_extract({e}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def host(e: str) -> str:
    return f"lower(regexp_extract(regexp_replace({authority(e)}, '^.*@', ''), '^[^:]*', 0))"


def path(e: str) -> str:
    return f"regexp_extract({e}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def normalized(e: str) -> str:
    """Reference normal form for inputs without quotes or surrounding space."""
    link = f"rtrim(regexp_extract({e}, '(?i)https?://[^\\s<>\"'']+', 0), '{PUNCTUATION}')"
    chosen = f"CASE WHEN {link} <> '' THEN {link} ELSE {e} END"
    clean = f"replace(replace(replace({chosen}, chr(92) || '&', '&'), chr(92) || '?', '?'), '&amp;', '&')"
    return (
        f"CASE WHEN regexp_full_match({e}, 'BV[0-9A-Za-z]{{10}}') THEN 'https://www.bilibili.com/video/' || {e} "
        f"WHEN regexp_matches({clean}, '^(?i)https?://') THEN {clean} ELSE 'https://' || {clean} END"
    )


def channel(r: str) -> str:
    h, p = host(r), path(r)
    return f"""CASE
      WHEN {h} = 'channels.weixin.qq.com' OR ({h} IN ('weixin.qq.com','www.weixin.qq.com','mp.weixin.qq.com')
           AND (lower({p}) = '/sph' OR lower({p}) LIKE '/sph/%')) THEN 'deferred'
      WHEN {h} IN ('douyin.com','iesdouyin.com','www.iesdouyin.com') OR {h} LIKE '%.douyin.com' THEN 'douyin'
      WHEN regexp_matches(lower({p}), '[^/]\\.(pdf|docx|pptx|xlsx)$') THEN 'document'
      WHEN {h} = 'mp.weixin.qq.com' THEN 'wechat'
      WHEN {h} IN ('www.bilibili.com','bilibili.com','m.bilibili.com','b23.tv') THEN 'bilibili'
      WHEN {h} IN ('youtube.com','www.youtube.com','m.youtube.com','music.youtube.com','youtu.be',
                   'www.youtube-nocookie.com','youtube-nocookie.com') THEN 'youtube'
      WHEN {h} IN ('xiaoyuzhoufm.com','www.xiaoyuzhoufm.com')
           AND regexp_matches({p}, '/episode/[0-9a-fA-F]{{24}}(/|$)') THEN 'xiaoyuzhou'
      WHEN {h} IN ('zhihu.com','www.zhihu.com') AND regexp_matches({p}, '/question/[0-9]+') THEN 'zhihu_question'
      WHEN {h} IN ('xiaohongshu.com','www.xiaohongshu.com','xhslink.com','www.xhslink.com') THEN 'xiaohongshu'
      WHEN regexp_matches({r}, '^https?://') AND {h} <> '' THEN 'web' ELSE 'unsupported' END"""


def ms_time(e: str) -> str:
    """SRT time of seconds."""
    ms = f"CAST(round_even(({e}) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"


def short_time(e: str) -> str:
    s = f"CAST(trunc({e}) AS BIGINT)"
    return (
        f"CASE WHEN {s} >= 3600 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) "
        f"ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END"
    )
