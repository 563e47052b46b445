"""Texts that hold one JSON value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of an object under which its rows stand, by preference.
LISTS = ("data", "examples", "tests")


def parsed_array(text: Column) -> Column:
    """The items of a text that is an array; null for another value."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def alone(text: Column) -> Column:
    """The text parsed as the only item of a list: an array of one value, if it is one value."""
    return parsed_array(F.concat(F.lit("["), text, F.lit("]")))


def closed(text: Column) -> Column:
    """Whether the text also parses inside an object; so it does not close the list around it."""
    return F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def is_json_value(text: Column) -> Column:
    """Whether the text is exactly one JSON value; parsing alone would accept what follows one."""
    return F.coalesce((F.size(alone(text)) == 1) & closed(text), F.lit(False))


#: What is put behind a text to see that its parsing reached the end.
_END = 7306126530274


def with_end(text: Column) -> Column:
    """The text parsed as the first of two items; null if that is no JSON."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_END}]")))


def only_value(parsed: Column, text: Column) -> Column:
    """The value of a text that is exactly one JSON value, else null, from ``with_end`` as a column of its own.

    A text that closes the list does not reach the second item; one that names its number itself is parsed as ``alone`` and ``closed`` do.
    """
    second = F.try_variant_get(parsed, "$[1]", "variant")
    whole = (F.schema_of_variant(second) == "BIGINT") & (F.try_variant_get(second, "$", "long") == _END) & F.try_variant_get(parsed, "$[2]", "variant").isNull()
    plain = F.when(is_json_value(text), F.get(alone(text), F.lit(0)))
    return F.when(F.contains(text, F.lit(str(_END))), plain).when(whole, F.try_variant_get(parsed, "$[0]", "variant"))
