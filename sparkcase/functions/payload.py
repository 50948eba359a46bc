"""What a JSON payload holds, at any depth, read by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, with the colon if it is a field's name, or a number. Strings are taken whole, so no number within one is found.
_PIECES = r'"[^"]*+"(?:\s*+:)?|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?'
#: JSON's own escapes of backslash and quotation mark stand as characters that JSON forbids, so that strings end at the next mark.
_SLASH, _QUOTE = "\x01", "\x02"


def _plain(literals: Column) -> Column:
    """JSON string literals as the strings they stand for."""
    whole = F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]"))
    back = F.replace(F.replace(whole, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))
    return F.from_json(back, "array<string>")


def payload_content(payload: Column) -> Column:
    """struct<strings, fields, numbers, hour> of a JSON text.

    strings: all string values; fields: all field names, as words ("prior_24_h"
    as "prior 24 h"); numbers: all numbers as text, true and false left out;
    hour: the field hour_of_day of the outermost object if it is a whole number.
    What is null or no JSON has none of these.
    """
    valid = F.when(F.try_parse_json(payload).isNotNull(), payload)
    marked = F.replace(F.replace(valid, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.coalesce(F.regexp_extract_all(marked, F.lit(_PIECES), F.lit(0)), F.array().cast("array<string>"))

    def content(found: Column) -> Column:
        text = F.filter(found, lambda x: x.startswith('"'))
        names = F.transform(F.filter(text, lambda x: x.endswith(":")), lambda x: F.concat(F.substring_index(x, '"', 2), F.lit('"')))
        hour = F.get_json_object(valid, "$.hour_of_day")
        return F.struct(
            _plain(F.filter(text, lambda x: ~x.endswith(":"))).alias("strings"),
            F.transform(_plain(names), lambda x: F.replace(x, F.lit("_"), F.lit(" "))).alias("fields"),
            F.filter(found, lambda x: ~x.startswith('"')).alias("numbers"),
            F.when(hour.rlike(r"^-?\d{1,9}$"), hour.try_cast("int")).alias("hour"),
        )

    return F.get(F.transform(F.array(pieces), content), F.lit(0))
