"""One projection that turns every missing marker into NULL.

Spark has NULL and NaN where pandas has one missing value; after this step no
column holds NaN or +-inf, and placeholder strings are NULL. Strings that are
not markers are kept exactly as they were (untrimmed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import is_collection, is_floating, is_text, qcol

# Fixed values that must equal the reference's rule (compared after strip()).
MISSING_WORDS = ("na", "n/a", "none", "null", "nan")  # compared lower-cased
EMPTY_SHAPES = ("[]", "{}", "[ ]", "{ }", "()", "( )", '""', "''")
# Every character Python's str.strip() removes.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_CHARS))


def is_missing_text(c: Column, words=MISSING_WORDS, shapes=EMPTY_SHAPES) -> Column:
    s = stripped(c)
    return (s == "") | F.lower(s).isin(*words) | s.isin(*shapes)


def normalized_column(name: str, dt, words=MISSING_WORDS, shapes=EMPTY_SHAPES) -> Column:
    c = qcol(name)
    if is_floating(dt):
        out = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    elif is_text(dt):
        out = F.when(~is_missing_text(c, words, shapes), c)
    elif is_collection(dt):
        out = F.when(F.size(c) > 0, c)
    else:
        return c
    return out.alias(name)


def standardize_missing(df: DataFrame, words=MISSING_WORDS, shapes=EMPTY_SHAPES) -> DataFrame:
    """A single ``select``: narrow, codegen-friendly, no shuffle."""
    return df.select(*[normalized_column(f.name, f.dataType, words, shapes) for f in df.schema.fields])
