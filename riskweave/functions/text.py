"""Text expressions shared by the detectors."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the characters trimmed as white space.
WHITE_SPACE = ("\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")
# Cut lengths by detector, and the mark put after a cut.
LINE_CUT = 100
ARGUMENT_CUT = 80
SCRIPT_CUT = 120
CUT_MARK = "..."


def bound(value: Column, expression: Callable[[Column], Column]) -> Column:
    """``expression`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` and further columns, each computed once per row in compiled code; a generator keeps them from being pasted into their uses."""
    made = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.explode(F.array(made)).alias("_once")).select(*df.columns, *[F.col(f"_once.{k}").alias(k) for k in values])


def each(df: DataFrame, values: Column, name: str) -> DataFrame:
    """``df`` with a row for each of ``values`` (an array without nulls), made once per row in a projection, which is compiled where a generator with lambdas isn't.

    The explode is an outer one: for an inner one a filter on the array's size is
    put below the projection, and makes the array a second time.
    """
    made = df.select("*", values.alias("_each"))
    return made.select(*df.columns, F.explode_outer("_each").alias(name)).where(F.col(name).isNotNull())


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def truncate(text: Column, length: int) -> Column:
    """Cut to ``length`` characters and mark the cut."""
    return F.when(F.length(text) > length,
                  F.concat(F.left(text, F.lit(length)), F.lit(CUT_MARK))).otherwise(text)


def render(template: Column, text: Column) -> Column:
    """Put the quoted text into a rule's message template."""
    return F.replace(template, F.lit("%s"), text)


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# Escapes inside quotes.
QUOTE_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"}


def quoted(text: Column) -> Column:
    """The text in double quotes; quotes, backslashes and named control characters are escaped, other control characters stay."""
    for char, escape in QUOTE_ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))
