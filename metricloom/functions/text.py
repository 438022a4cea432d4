"""Column functions over names, definitions and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The units a window range may name.
WINDOW_UNITS = ["day", "month", "year", "quarter", "week", "hour"]

WINDOW_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("order", T.StringType()),
            T.StructField("range", T.StringType()),
            T.StructField("semiadditive", T.StringType()),
        ]
    )
)

ANSWER_TYPE = T.StructType(
    [
        T.StructField("expr", T.StringType()),
        T.StructField("needs_window", T.BooleanType()),
        T.StructField("window", WINDOW_TYPE),
        T.StructField("warning_type", T.StringType()),
        T.StructField("warning_message", T.StringType()),
        T.StructField("dimensions_needed", T.ArrayType(T.StringType())),
        T.StructField(
            "joins_needed",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("source", T.StringType()),
                        T.StructField("on", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def snake_case(c: Column) -> Column:
    """`UnitPriceID` -> `unit_price_id`; blanks become underscores."""
    word_edges = "(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
    return F.translate(F.lower(F.regexp_replace(c, word_edges, "_")), " ", "_")


def without_comments(c: Column) -> Column:
    """A measure text without `-- ...`, `// ...` and `/* ... */`, which are no comments inside quotes and brackets."""
    kept = r'''("(?:[^"]|"")*"|'(?:[^']|'')*'|\[(?:[^\]]|\]\])*\])'''
    return F.regexp_replace(c, kept + r"|--[^\r\n]*|//[^\r\n]*|/\*(?s:.*?)\*/", "$1")


def last_part(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def safe_view_name(c: Column) -> Column:
    """`main.sales.my-fact` -> `mv_my_fact`."""
    return F.concat(F.lit("mv_"), F.translate(last_part(c), "-", "_"))


def view_name(c: Column, kind: str) -> Column:
    """Name of the view made from a model, a cube or (in batches) a fact table."""
    if kind == "model":
        return F.concat(F.lit("mv_"), c)
    if kind == "cube":
        return F.concat(F.lit("mv_"), F.translate(F.lower(c), " ", "_"))
    if kind == "batch":
        return F.concat(F.lit("mv_batch_"), last_part(c))
    raise ValueError(f"unknown kind of view: {kind}")


def split_name(c: Column, catalog: str, schema: str) -> Column:
    """Struct (catalog, schema) of a three-part name, or the defaults."""
    parts = F.split(c, r"\.")
    three = F.size(parts) >= 3
    return F.struct(
        F.when(three, F.get(parts, F.lit(0))).otherwise(F.lit(catalog)).alias("catalog"),
        F.when(three, F.get(parts, F.lit(1))).otherwise(F.lit(schema)).alias("schema"),
    )


def strip_fence(c: Column) -> Column:
    """Remove a Markdown code fence around a text."""
    opened = F.regexp_replace(F.trim(c), r"^\s*```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"\s*```\s*$", "")


def parse_answer_json(c: Column, schema: T.DataType = ANSWER_TYPE) -> Column:
    """Typed row of an answer text; NULL for empty, error and broken texts.

    A required object is recognised by a closing brace, since `from_json` would otherwise turn
    a truncated text into a row of NULLs.
    """
    body = strip_fence(c)
    usable = body.rlike(r"(?s)^\s*\{.*\}\s*$") & F.get_json_object(body, "$").isNotNull()
    return F.when(usable, F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def split_pair(c: Column) -> Column:
    """`name:expr` -> struct; a text without a colon serves as both."""
    parts = F.split(c, ":", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("name"),
        F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).alias("expr"),
    )


def b64_text(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def normalize_range(c: Column) -> Column:
    """`trailing_3_months` -> `trailing 3 month`; the one-word ranges stay as they are."""
    plural = r"\b(" + "|".join(WINDOW_UNITS) + r")s\b"
    return F.regexp_replace(F.translate(F.trim(c), "_", " "), plural, "$1")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def uses_over(c: Column) -> Column:
    """The text contains a SQL window clause."""
    return matches(c, r"\bOVER\s*\(")


def format_measure(c: Column, fmt: str) -> Column:
    """Display text of a number for the format strings found in models and cubes."""
    fmt = fmt.strip('"')
    if fmt in ("Percent", "0.00%"):
        return F.concat(F.format_number(c.cast("double") * 100, 2), F.lit("%"))
    if fmt in ("$#,#.00", "$#,##0.00"):
        return F.concat(F.lit("$"), F.format_number(c, 2))
    if fmt == "$#,#":
        return F.concat(F.lit("$"), F.format_number(c, 0))
    if fmt in ("#,##0", "#,#"):
        return F.format_number(c, 0)
    if fmt in ("#,##0.00", "#,#.00"):
        return F.format_number(c, 2)
    raise ValueError(f"unknown format: {fmt}")


def member_label(name: Column, measure: Column, fmt: str) -> Column:
    """`EAST - $1,234`."""
    return F.concat_ws(" - ", name, format_measure(measure, fmt))
