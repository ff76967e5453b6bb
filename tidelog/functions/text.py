"""Line and size expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_text(column: Column, query: str) -> Column:
    """Case-insensitive literal substring."""
    return F.lower(column).contains(F.lower(F.lit(query)))


def like_text(column: Column, query: str) -> Column:
    """``LIKE %query%`` without case; ``%`` and ``_`` in the query stay wildcards."""
    return column.ilike("%" + query.replace("\\", "\\\\") + "%")


def sort_key(line: Column) -> Column:
    """The first space-delimited token when it has at least ten characters, else ''."""
    token = F.substring_index(line, " ", 1)
    return F.when(F.char_length(token) >= 10, token).otherwise(F.lit(""))


def line_bytes(line: Column) -> Column:
    return F.octet_length(line).cast("bigint")


def human_size(size: Column) -> Column:
    """``14.3 MB``: one decimal, base 1024, half-even on the binary value."""
    value = size.cast("double")

    def shown(power: int, unit: str) -> Column:
        number = F.format_number(value / float(1024 ** power), 1)
        return F.concat(F.replace(number, F.lit(","), F.lit("")), F.lit(" " + unit))

    return (F.when(value < 1024.0, shown(0, "B"))
            .when(value < 1024.0 ** 2, shown(1, "KB"))
            .when(value < 1024.0 ** 3, shown(2, "MB"))
            .when(value < 1024.0 ** 4, shown(3, "GB"))
            .otherwise(shown(4, "TB")))
