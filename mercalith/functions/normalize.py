"""The two normalisations and the defensive casts, as Spark SQL text over a column name.

SQL text keeps a plan with many derived columns cheap to put together and reads like the rules
built from it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The Unicode space separators (category Zs), which count as blank when text
# is trimmed; tabs and line ends do not.
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

# Everything the profile counts as whitespace: the above plus control and line separators.
WHITESPACE = SPACES + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """A SQL string literal of any text, every unusual character escaped."""
    plain = [c.isascii() and c.isprintable() and c not in "'\\" for c in value]
    return "'" + "".join(c if ok else f"\\u{ord(c):04x}" for c, ok in zip(value, plain)) + "'"


def text(name: str) -> str:
    return f"CAST({quoted(name)} AS STRING)"


def trimmed(name: str) -> str:
    return trim(text(name))


def trim(expression: str) -> str:
    return f"trim(BOTH {literal(SPACES)} FROM {expression})"


def norm_id(name: str) -> str:
    """Formal identifier: upper case, inner and outer spaces removed."""
    return f"upper(replace({text(name)}, ' ', ''))"


def norm_text(name: str) -> str:
    """Free text for display: trimmed, upper case."""
    return f"upper({trimmed(name)})"


def key_id(name: str) -> str:
    """Formal identifier as a grouping key: `norm_id` in lower case.

    Upper case would make 'ss' and the sharp s one text.
    """
    return f"lower(replace({text(name)}, ' ', ''))"


def key_text(name: str) -> str:
    """Free text as a grouping key: `norm_text` in lower case."""
    return f"lower({trimmed(name)})"


def fold(name: str) -> str:
    """Free text for comparison: trimmed, lower case."""
    return f"lower({trimmed(name)})"


def is_whitespace(expression: str) -> str:
    return f"ltrim({literal(WHITESPACE)}, {expression}) = ''"


def whole_number(name: str, data_type: T.DataType) -> str:
    """Value as BIGINT, NULL if it is no number.

    Text rounds half away from zero ('12.5' is 13), floating point half to even.
    """
    column = quoted(name)
    if isinstance(data_type, T.IntegralType):
        return f"CAST({column} AS BIGINT)"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"try_cast(bround({column}) AS BIGINT)"
    return f"try_cast(round(try_cast({column} AS DECIMAL(38,9)), 0) AS BIGINT)"


def cast_value(expression: str, data_type: T.DataType) -> str:
    """`expression` as a target type, NULL where it has no such value.

    Dates may be written yyyyMMdd; text that is a number but not whole rounds half away from zero.
    """
    if isinstance(data_type, T.DateType):
        written = f"CAST({expression} AS STRING)"
        return f"coalesce(try_to_date({written}, 'yyyyMMdd'), try_cast({written} AS DATE))"
    if isinstance(data_type, T.IntegralType):
        kind = data_type.simpleString()
        number = f"round(try_cast({expression} AS DECIMAL(38,9)), 0)"
        return f"coalesce(try_cast({expression} AS {kind}), try_cast({number} AS {kind}))"
    return f"try_cast({expression} AS {data_type.simpleString()})"


def single_repeated_char(expression: str) -> str:
    """True for text of at least two characters that are all the same."""
    return (
        f"(length({expression}) > 1 AND "
        f"replace({expression}, substring({expression}, 1, 1), '') = '')"
    )


def no_alphanumeric(expression: str) -> str:
    """True for non-empty text without one ASCII letter or digit."""
    return f"{expression} RLIKE '^[^a-zA-Z0-9]+$'"
