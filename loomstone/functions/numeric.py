"""Numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: decimal digits with a sign, point and exponent, or inf / infinity / nan.
FLOAT = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"
#: Fields of a JSON object that hold its number, in order of preference.
JSON_FIELDS = ("value", "avg", "sum")


def number(text: Column) -> Column:
    """text as a double, or null; text such as 1d, which a plain cast reads, is no number."""
    clean = F.trim(text)
    return F.when(clean.rlike(FLOAT), clean.try_cast("double"))


def json_number(text: Column, names: tuple[str, ...] = JSON_FIELDS) -> Column:
    """The first of the named fields of a JSON object that holds a JSON number, not text that looks like one.
    The text is parsed once, and only where it may be an object."""

    def field(v: Column, name: str) -> Column:
        held = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(held).rlike("BIGINT|DOUBLE|FLOAT|DECIMAL"), F.try_variant_get(v, f"$.{name}", "double"))

    found = F.transform(F.array(F.try_parse_json(text)), lambda v: F.coalesce(*(field(v, n) for n in names)))
    return F.when(text.rlike(r"^\s*\{"), F.element_at(found, 1))


def parse_numeric(text: Column) -> Column:
    """The number of a value: plain, after its last colon, or in a JSON object; else null."""
    return F.coalesce(number(text), number(F.substring_index(text, ":", -1)), json_number(text))


def zigzag(n: Column) -> Column:
    """Signed to unsigned with small magnitudes first: 0, -1, 1, -2 -> 0, 1, 2, 3."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1).cast("long")))
