"""JSON that models write: fences, words around it, stray commas, raw control characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RARE_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Types of older records that mean a current one; others are dropped.
TYPES = {"persona": "persona", "episodic": "episodic", "instruction": "instruction", "episode": "episodic", "preference": "persona", "fact": "persona", "event": "episodic", "instruct": "instruction"}
DEFAULT_PRIORITY, DEFAULT_SCORE, DEFAULT_SCENE = 50, 5, ""


def parse(text: Column, schema: str) -> Column:
    """The value of `schema`; null where it can't be read.

    Raw control characters inside strings are taken as they are; only a text that can't be read so loses the rare ones.
    """
    options = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}
    return F.coalesce(F.from_json(text, schema, options), F.from_json(F.regexp_replace(text, RARE_CONTROL, ""), schema, options))


def candidates(text: Column, listed: bool) -> list[Column]:
    """Texts to try in order: as it is, in a code fence, between outer brackets where a list is wanted, between outer braces, and each without trailing commas."""
    clean = text
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    braces, brackets = F.regexp_extract(clean, r"(?s)(\{.*\})", 1), F.regexp_extract(clean, r"(?s)(\[.*\])", 1)
    no_commas = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    ends = [brackets, braces] if listed else [braces, brackets]
    return [clean, fenced, *(x for c in ends for x in (c, no_commas(c)))]


def extract(text: Column, schema: str) -> Column:
    """The first candidate that parses to something; arrays must have items."""
    found = []
    for c in candidates(text, schema.startswith("array")):
        value = parse(c, schema)
        found.append(F.when((F.trim(c) != "") & value.isNotNull() & _some(value, schema), value))
    return F.coalesce(*found)


def _some(value: Column, schema: str) -> Column:
    return F.size(value) > 0 if schema.startswith("array") else F.lit(True)


def memory_type(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for old, new in TYPES.items():
        out = F.when(F.lower(F.trim(c)) == old, F.lit(new)).otherwise(out)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("episodic")).otherwise(out)


def escaped(text: Column) -> Column:
    """The text with control characters inside JSON strings escaped; those between strings stay, as white space does."""
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[^"]+|")'), F.lit(1))

    def inside(piece: Column) -> Column:
        out = piece
        for code in range(32):
            short = {9: "t", 10: "n", 13: "r", 8: "b", 12: "f"}.get(code)
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\{short}" if short else f"\\u{code:04x}"))
        return out

    is_string = lambda p: p.startswith('"') & (F.length(p) > 1) & p.rlike(r"[\x00-\x1f]")
    return F.array_join(F.transform(pieces, lambda p: F.when(is_string(p), inside(p)).otherwise(p)), "")


def tolerant(text: Column) -> Column:
    """A JSON text that can be read: as it is, with control characters in strings escaped, or without the rare ones; else null."""
    readable = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(readable(text), readable(escaped(text)), readable(F.regexp_replace(text, RARE_CONTROL, "")))


def metadata(value: Column) -> Column:
    """Metadata as a VARIANT object: of a JSON text or of a VARIANT; `{}` for all that is no object, can't be read or is null."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value).otherwise(F.parse_json(F.lit("{}")))


def metadata_of(text: Column) -> Column:
    return metadata(F.try_parse_json(text))


def field(value: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT by its path (`$.a.b[0]`); null where it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)
