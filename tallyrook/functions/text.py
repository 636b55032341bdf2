"""Text as the document rules see it: trimming, folding, tokens, edit distance in characters and words. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folded() -> dict[str, str]:
    """Latin letters that are a letter of ASCII with marks, by their compatibility decomposition."""
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return {c: bare(c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(bare(c)) == 1 and bare(c).isascii()}


ACCENTED, PLAIN = map("".join, zip(*_folded().items(), strict=True))
#: Marks that stand behind their letter.
MARKS = r"[\x{300}-\x{36f}]"
# White space as Python's strip() has it, in a form that Java's and RE2's patterns share.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters themselves.
WHITES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: A character that isn't ASCII; white space of ASCII that isn't one space.
BEYOND_ASCII, ASCII_SPACE = r"[^\x00-\x7f]", r"[\t-\r\x1c-\x20]{2,}|[\t-\r\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at both ends; SQL's trim keeps tabs and line ends. Characters between the ends are matched with nothing."""
    return F.btrim(c, F.lit(WHITES))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def as_text(c: Column) -> Column:
    # nullif would trim twice
    return F.get(F.filter(F.array(strip(c)), lambda x: x != ""), F.lit(0))


def _folded_by(c: Column, given: str, plain: str) -> Column:
    return F.lower(F.translate(F.regexp_replace(c, MARKS, ""), given, plain))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return _folded_by(c, ACCENTED, PLAIN)


def norm(c: Column) -> Column:
    """Folded, runs of white space as one space: how values are compared. Texts of ASCII have no accents to look up."""
    whole = F.regexp_replace(_folded_by(c, ACCENTED + WHITES, PLAIN + " " * len(WHITES)), " {2,}", " ")
    return F.trim(F.when(c.rlike(BEYOND_ASCII), whole).otherwise(F.regexp_replace(F.lower(c), ASCII_SPACE, " ")))


def token(c: Column) -> Column:
    """Folded letters and digits only: how words are located."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), f"{WHITE}+"), token), lambda t: t != "")


def page_tokens(c: Column) -> Column:
    """The same of a whole page, in one pass over it; empty ones may be among them."""
    return F.split(F.regexp_replace(_folded_by(c, ACCENTED + WHITES, PLAIN + " " * len(WHITES)), r"[^\p{L}\p{N} ]", ""), " ")


def cer(reference: Column, other: Column, distance=F.levenshtein) -> Column:
    """Character error rate: edits per character of the reference; against an empty one 0 if both are empty, else 1."""
    return F.when(reference == "", F.when(other == "", 0.0).otherwise(1.0)).otherwise(distance(reference, other) / F.length(reference))


def matches(truth: Column, value: Column, limit: float = 0.5) -> Column:
    """Both there and close enough."""
    return F.coalesce((truth != "") & (value != "") & (cer(norm(truth), norm(value)) <= limit), F.lit(False))


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet could take for a formula gets a quote before it."""
    return F.when(c.rlike(r"^[=+\-@\p{Cc}\p{Cf}\p{Z}\s]"), F.concat(F.lit("'"), c)).otherwise(c)


#: One character a different word of a pair of texts.
LETTERS = "".join(map(chr, range(0x4E00, 0xA000)))


def words_of(c: Column) -> Column:
    return F.filter(F.split(strip(c), f"{WHITE}+"), lambda w: w != "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance in words: every different word of the two texts becomes one character, and the built-in distance compares these.
    Texts with more different words than LETTERS has characters are an error."""
    both = F.struct(words_of(a).alias("a"), words_of(b).alias("b"))

    def spelled(words: Column, known: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.substring(F.lit(LETTERS), F.array_position(known, w).cast("int"), F.lit(1))), "")

    def distance(x: Column) -> Column:
        known = x["known"]
        far = F.raise_error(F.lit(f"more than {len(LETTERS)} different words")).cast("int")
        return F.when(F.size(known) > len(LETTERS), far).otherwise(F.levenshtein(spelled(x["x"]["a"], known), spelled(x["x"]["b"], known)))

    pairs = F.transform(F.array(both), lambda x: F.struct(x.alias("x"), F.array_union(x["a"], x["b"]).alias("known")))
    return F.get(F.transform(pairs, distance), F.lit(0)).cast("long")


def wer(reference: Column, other: Column) -> Column:
    """Word error rate: edits in words per word of the reference; against an empty one 0 if both are empty, else 1."""
    n = F.size(words_of(reference))
    return F.when(n == 0, F.when(F.size(words_of(other)) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(reference, other) / n)
