"""Whitespace, blank handling and entity decoding shared by the other modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character the surveyed data rules treat as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java character class.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY_SPACE = f"[{SPACE_CLASS}]"


def strip(value: Column, extra: str = "") -> Column:
    return F.btrim(value, F.lit(SPACE_CHARS + extra))


def strip_only(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def rstrip_only(value: Column, chars: str) -> Column:
    return F.rtrim(value, F.lit(chars))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`.

    Column expressions are trees: a value mentioned n times is planned n times, and inside a
    lambda it would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def interleave(pieces: Column, between: Column) -> Column:
    """pieces[0] + between[0] + pieces[1] + ...; `between` is bound once, not per piece."""
    return let(
        between,
        lambda b: F.array_join(
            F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(b, i), F.lit("")))), ""
        ),
    )


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def is_blank(value: Column) -> Column:
    return strip(text_or_empty(value)) == ""


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


# Named entities decoded in the JVM tier. The first group also counts without
# its semicolon, as browsers read it.
LEGACY_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "copy": "©", "reg": "®", "middot": "·",
    "laquo": "«", "raquo": "»", "times": "×", "deg": "°",
}
STRICT_ENTITIES = {
    "apos": "'", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "bull": "•", "trade": "™", "euro": "€",
}
_ENTITY = (
    "&(?:#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};"
    f"|(?:{'|'.join(STRICT_ENTITIES)});|(?:{'|'.join(LEGACY_ENTITIES)})(?:;|(?![A-Za-z0-9]*;)))"
)


def _entity_char(entity: Column) -> Column:
    """Character of one matched entity: a table look-up, or the code point of a number."""
    name = F.regexp_replace(entity, "[&;]", "")
    known = {**LEGACY_ENTITIES, **STRICT_ENTITIES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    digits = F.regexp_extract(entity, "#[xX]?([0-9a-fA-F]+)", 1)
    base_ten = digits.try_cast("long")
    number = F.when(entity.rlike("#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(base_ten)
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    point = F.when(valid, number).otherwise(F.lit(0xFFFD))
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return F.when(F.contains(entity, F.lit("#")), char).otherwise(F.try_element_at(table, name))


def decode_entities(value: Column) -> Column:
    """Decode named and numeric entities in one pass over the text."""
    found = lambda v: F.transform(F.regexp_extract_all(v, F.lit(_ENTITY), F.lit(0)), _entity_char)
    decoded = lambda v: interleave(F.split(v, _ENTITY, -1), found(v))
    return let(value, lambda v: F.when(F.contains(v, F.lit("&")), decoded(v)).otherwise(v))


def bare_names_as_text(value: Column, decoded: tuple[str, ...] = ("amp",)) -> Column:
    """HTML whose entity names without a semicolon will be read as text, as in a title cut off at a length.

    Browsers and `decode_entities` take the common ones for their characters; here only the names of `decoded` stay entities.
    """
    return F.regexp_replace(value, f"&(?=[A-Za-z])(?!{'|'.join(decoded)})(?![A-Za-z0-9]+;)", "&amp;")
