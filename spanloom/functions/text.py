"""Column functions on text, with the white space and lengths of the capture format (ECMAScript)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space of ECMAScript, as a Java character class.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: two for characters beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def preview(text: Column, size: int = 60) -> Column:
    """White-space runs as one blank, cut to ``size`` characters (60 in the command line, 80 in tools)."""
    return F.substring(F.regexp_replace(text, f"{SPACE}+", " "), 1, size)


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (1-based, inclusive); what lies outside is cut off."""
    lines = F.split(content, "\n", -1)
    size = F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), size), "\n")


def bag_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+"), lambda t: t != "")


RESULT_KEYS = ("content", "text", "result", "stdout", "output")  # fixed values: members that may hold a result


def text_of(value: Column, plain: Column) -> Column:
    """A tool response as text: a string is itself, of an object the first string-valued member of
    RESULT_KEYS, anything else its JSON text; null is empty.

    ``value`` is the response as a variant, ``plain`` as JSON text (which keeps the order of members
    and the spelling of numbers).
    """

    def of(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        members = F.array(*[F.try_variant_get(v, f"$.{k}", "variant") for k in RESULT_KEYS])
        texts = F.filter(members, lambda m: F.coalesce(F.schema_of_variant(m) == "STRING", F.lit(False)))
        first = F.try_variant_get(F.try_element_at(texts, F.lit(1)), "$", "string")
        return (
            F.when(v.isNull() | (kind == "VOID"), F.lit(""))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .otherwise(F.coalesce(F.when(F.startswith(kind, F.lit("OBJECT")), first), plain, F.lit("")))
        )

    return F.element_at(F.transform(F.array(value), of), 1)  # an array of one holds the value, so that it is read once


def as_text(raw_json: Column) -> Column:
    """``text_of`` the JSON text of a value."""
    wrapped = F.concat(F.lit('{"v":'), raw_json, F.lit("}"))
    return text_of(F.try_parse_json(raw_json), F.get_json_object(wrapped, "$.v"))


def split_hash(name: Column) -> Column:
    """Rolling hash h = h * 31 + code, modulo 2**32, over the characters of a name."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))


def split_of(name: Column) -> Column:
    """train for two fifths of the names, test for the others."""
    return F.when(split_hash(name) % 5 < 2, "train").otherwise("test")


def first_match(text: Column, find: Column) -> Column:
    return F.instr(text, find) > 0


def padded(text: Column, width: int) -> Column:
    """Filled up with blanks to a width; longer texts stay as they are."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"([^.]*)$", 1)
