"""Strict JSON in the JVM, by Spark's VARIANT type, whose parser refuses duplicate keys at any depth, NaN and infinities.

Texts nested deeper than a thousand levels are refused as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a JSON string may escape, and a string once escapes are gone.
ESCAPE, STRING, CONSTANT = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})', r'"[^"\\\x00-\x1f]*"', "-?(?:Infinity|NaN)"
#: No character of JSON outside strings, a number that begins with a zero, nothing at all.
LOOSE = r"[^\s\[\]{}:,\"0-9a-zA-Z.+\-]|(?<![0-9.eE+])0[0-9]|^\s*$"


def _one(text: Column) -> Column:
    """The parser stops behind the first value. So the text is put in an array, with its own hash behind it: where the text is one value, the
    array has two, and the second is the hash, which the text can't hold itself."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text.cast("binary")), F.lit('"]')))


def _whole(held: Column, text: Column) -> Column:
    return (F.size(F.try_variant_get(held, "$", "array<variant>")) == 2) & (F.try_variant_get(held, "$[1]", "string") == F.md5(text.cast("binary")))


def value(text: Column) -> Column:
    """The text as a variant; null unless it is exactly one strict JSON value."""
    held = _one(text)
    return F.when(_whole(held, text), F.try_variant_get(held, "$[0]", "variant"))


def verdict(text: Column) -> Column:
    """As below, of a text that is written and computed once, however large its expression is."""
    return F.get(F.transform(F.array(text), _verdict), F.lit(0))


def _verdict(text: Column) -> Column:
    """ok, or why a text isn't strict JSON: not a number, duplicate key, not JSON. The reason is looked for in refused texts only: with
    strings emptied and constants made numbers, a text that a lenient parser takes has one of the first two faults."""
    bare = F.regexp_replace(F.regexp_replace(text, ESCAPE, ""), STRING, '""')
    open_ = F.contains(F.replace(bare, F.lit('""'), F.lit("")), F.lit('"')) | F.contains(bare, F.lit("\\"))
    lenient = F.get_json_object(F.concat(F.lit("["), F.regexp_replace(bare, CONSTANT, "0"), F.lit("]")), "$").isNotNull()
    # what the lenient parser lets pass besides
    extra = ~_whole(_one(text), text) | bare.rlike(LOOSE)
    return (
        F.when(value(text).isNotNull(), "ok").when(text.isNull() | F.coalesce(extra, F.lit(False)) | open_ | ~lenient, "not JSON")
        .when(bare.rlike(CONSTANT), "not a number").otherwise("duplicate key")
    )


def canonical(text: Column, without: tuple[str, ...] = ()) -> Column:
    """A strict JSON object as compact JSON with keys in order at every depth, without some keys of the object itself; null if it isn't one.

    Numbers are written by value: whole ones up to 38 digits as they are, others without zeros at their end (2.50 is 2.5), so
    texts that differ in the form of a number only are one.
    """
    held = F.try_variant_get(value(text), "$", "map<string,variant>")
    kept = F.map_filter(held, lambda k, _: ~k.isin(*without)) if without else held
    return F.to_json(kept)
