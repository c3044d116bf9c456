"""Label names and the text form of shares."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelscope.functions import script


def label_name(col: Column | str) -> Column:
    """Name of a label code, ``unknown`` for any other code."""
    code = F.col(col) if isinstance(col, str) else col
    names = F.create_map(*map(F.lit, chain.from_iterable(script.LABEL_NAMES.items())))
    return F.coalesce(F.element_at(names, code.cast("int")), F.lit(script.UNKNOWN_LABEL))


def label_code(col: Column | str) -> Column:
    """Code of a label name, null for any other name."""
    name = F.col(col) if isinstance(col, str) else col
    pairs = chain.from_iterable((v, k) for k, v in script.LABEL_NAMES.items())
    return F.element_at(F.create_map(*map(F.lit, pairs)), name)


def percentage(count: Column, total: Column) -> Column:
    """``count / total`` in percent, 0 for an empty total."""
    share = F.try_divide(count.cast("double"), total.cast("double")) * F.lit(100.0)
    return F.coalesce(share, F.lit(0.0))


def percentage_text(col: Column | str) -> Column:
    """Two decimals and a percent sign; rounds the exact binary value, ties to even."""
    return F.concat(F.format_number(col, 2), F.lit("%"))
