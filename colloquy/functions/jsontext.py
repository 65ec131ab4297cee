"""JSON text to VARIANT, as strict as a JSON document parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(c: Column) -> Column:
    """VARIANT of a text that is one JSON document, else NULL.

    The built-in parser ignores what follows the first value. Trailing text
    cannot stay valid inside an array and inside an object at once, and a
    second value would make the array longer.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    second = F.try_variant_get(in_array, "$[1]", "variant")
    value = F.try_variant_get(in_array, "$[0]", "variant")
    return F.when(in_object.isNotNull() & second.isNull(), value)


def kind(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT`` … of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def typed_string(v: Column, field: str) -> Column:
    """A field of an object if it is a JSON string, else NULL."""
    value = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(kind(value) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def elements(v: Column) -> Column:
    """Items of an array VARIANT, NULL for anything else."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def text_field(v: Column, field: str) -> Column:
    """A field as text; a missing or null field gives ''."""
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit(""))
