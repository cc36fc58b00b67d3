"""Label and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two private-use characters that forms print as empty check boxes.
CHECK_GLYPHS = ("\uf063", "\uf06f")


def slug(s: Column, most: int = 40) -> Column:
    """Lower case, other than a-z0-9 to one underscore, outer underscores off, then cut; 'field' where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, most), F.lit("")), F.lit("field"))


#: Dots or middle dots, two or more, with blanks or tabs between them; or an ellipsis.
_DOTS = r"(?:(?:[.\x{b7}][ \t]*)+[.\x{b7}]|\x{2026})"


def strip_leaders(s: Column) -> Column:
    """Cuts a dot leader at either end, with the blanks, commas, colons and semicolons on its inner side; an unchanged label stays as it is."""
    t = F.regexp_replace(s, rf"^\s*{_DOTS}[ \t,;:]*", "")
    t = F.regexp_replace(t, rf"[ \t,;:]*{_DOTS}\s*$", "")
    return F.when(t == s, s).otherwise(F.trim(t))


def normalize_label(s: Column) -> Column:
    """Trailing colons and date masks in parentheses off, white space to single spaces, lower case (sharp s as ss)."""
    t = F.regexp_replace(F.trim(s), r"(?:\s*:|\s*\([\sdmyDMY/\-]+\))+\s*$", "")
    return F.replace(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def normalize_plain(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9']", "")


def tokenize(s: Column) -> Column:
    """Words between white space of any kind, no-break spaces too."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def strip_fill(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\s_.·․]+|[\s_.·․]+$", "")


def is_blank_or_glyph(s: Column) -> Column:
    return s.isin(*CHECK_GLYPHS) | s.rlike("_{3,}") | s.rlike(r"^[.·․ ]*$")


def is_ink(s: Column) -> Column:
    """A guard's ink: no check glyph, no underscore, no white space."""
    return ~s.isin(*CHECK_GLYPHS, "_") & s.rlike(r"(?U)\S")


def is_mask(s: Column) -> Column:
    return s.rlike(r"^[()\- $.]+$")


def option_of(s: Column) -> Column:
    """The option in a trailing pair of parentheses, if what stands before ends with ? or :."""
    return F.when(s.rlike(r"^.*[?:]\s*\([^()]+\)\s*$"), F.regexp_extract(s, r"^.*?\s*\(([^()]+)\)\s*$", 1))


def prompt_of(s: Column) -> Column:
    return F.when(s.rlike(r"^.*[?:]\s*\([^()]+\)\s*$"), F.regexp_extract(s, r"^(.*?)\s*\(([^()]+)\)\s*$", 1))


def type_family(t: Column) -> Column:
    return F.when(t.isin("text", "multiline", "choice"), "text").otherwise(t)


#: Words before or in a label that ask for an identifier, whose digits aren't a count.
_IDENTIFIER = r"\b(?:phone|fax|account|bank|transit|insurance|licen[cs]e|passport|policy|serial|card|file|case|permit|route|postal|zip)\b|#"


def field_kind(label: Column) -> Column:
    """date, month, integer or null, from the words of a label: a mask that has a day tells a date, one of month and year a month; then counts, then words for dates."""
    low = F.lower(label)
    day = r"\b(?:dd?[/.\-]mm?|mm?[/.\-]dd?)[/.\-](?:yyyy|ccyy|yy)\b|\b(?:yyyy|ccyy)[/.\-]mm?[/.\-]dd?\b"
    return (
        F.when(low.rlike(day), "date")
        .when(low.rlike(r"\bmm?[/.\-](?:yyyy|ccyy|yy)\b|\bmonth\b"), "month")
        .when(low.rlike(r"\b(?:age|how many|count|quantity|qty|number of|no\. of)\b") & ~low.rlike(_IDENTIFIER), "integer")
        .when(low.rlike(r"\b(?:dates?|dob|birthday)\b"), "date")
    )


def fixed(x: Column, digits: int) -> Column:
    """x, not negative, with so many digits (4 at most), rounded as C does: by the exact binary value, halves to even. format_string rounds halves of the shortest decimal up.

    Where the shortest decimal looks like a half, the fraction in units of 2^-62 (2^-71 for tiny x) is compared with the half in whole numbers.
    """
    ten = 10**digits
    d = x.try_cast("decimal(38,18)")
    whole = F.floor(d).cast("decimal(20,0)")
    t = ((d - whole) * F.lit(ten)).cast("decimal(30,18)")
    n = F.floor(t).cast("long")
    tiny = x < 2.0**-9
    m = F.when(tiny, x * 2.0**71).otherwise((x - F.floor(x)) * 2.0**62).try_cast("long").cast("decimal(20,0)")
    unit = F.when(tiny, F.lit(str(2**71)).cast("decimal(22,0)")).otherwise(F.lit(str(2**62)).cast("decimal(22,0)"))
    value, half = m * F.lit(2 * ten).cast("decimal(6,0)"), (2 * n + 1).cast("decimal(6,0)") * unit
    up = (value > half) | ((value == half) & (n % 2 == 1))
    exact = F.format_string(f"%d.%0{digits}d", (whole.cast("long") + F.when(up & (n + 1 == ten), 1).otherwise(0)), (n + up.cast("long")) % ten)
    return F.when((x < 1e15) & (t - n == F.lit(0.5).cast("decimal(2,1)")), exact).otherwise(F.format_string(f"%.{digits}f", x))


def delta(d: Column) -> Column:
    return F.concat(F.when(d < 0, "-").otherwise("+"), fixed(F.abs(d), 4))


def regression_tag(lower_is_better: Column, d: Column) -> Column:
    worse = F.when(lower_is_better, d > 1e-9).otherwise(d < -1e-9)
    return F.when(worse, " REGRESSION").otherwise("")
