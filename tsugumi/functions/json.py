"""JSON inside text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_array(c: Column) -> Column:
    """The variant of a text that is one valid JSON array from its first sign to its last, else null.

    The parser stops at the end of the first value; the wrapped forms bring to light what follows it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & listed.isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()
    return F.when(F.ltrim(c).startswith("[") & alone, F.try_parse_json(c))
