"""Tool calls recovered from message logs, with typed arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.fixed_values import TOOL_CALL_PATTERNS


def _calls(content: Column, pattern: str) -> Column:
    names = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    arguments = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("tool"), a.alias("args_json")))


def tool_calls(
    logs: DataFrame, known_tools: Sequence[str], content_col: str = "text",
    keep: Sequence[str] = ("message_id",),
) -> DataFrame:
    """One row per call written as text: ``(message_id, call_no, tool, args_json)``.

    Unknown tools and arguments that are not a JSON object are left out.
    """
    found = F.concat(*[_calls(F.col(content_col), p) for p in TOOL_CALL_PATTERNS])
    valid = F.filter(
        found,
        lambda c: c["tool"].isin(list(known_tools))
        & F.coalesce(F.schema_of_variant(F.try_parse_json(c["args_json"])).startswith("OBJECT"), F.lit(False)),
    )
    return logs.select(*keep, F.posexplode(valid).alias("call_no", "c")).select(
        *keep, "call_no", "c.tool", "c.args_json"
    )


def argument_type(kind: Column, text: Column) -> Column:
    """Type of an argument: texts of digits, with one point, or true/false are converted."""
    from_text = (
        F.when(text.rlike("^[0-9]+$"), "int")
        .when(text.rlike(r"^([0-9]+\.[0-9]*|\.[0-9]+)$"), "float")
        .when(F.lower(text).isin("true", "false"), "bool")
        .otherwise("text")
    )
    return (
        F.when(kind == "STRING", from_text)
        .when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "float")
        .when(kind == "BOOLEAN", "bool")
        .otherwise("json")
    )


def typed_arguments(calls: DataFrame, keep: Sequence[str] = ("message_id", "call_no", "tool")) -> DataFrame:
    """One row per argument with its value in the column of its type.

    ``(…, name, arg_type, int_value, float_value, bool_value, text_value)``; arrays and
    objects stay JSON text.
    """
    pairs = F.try_variant_get(F.try_parse_json("args_json"), "$", "map<string,variant>")
    exploded = calls.select(*keep, F.explode(pairs).alias("name", "v"))
    kind = F.schema_of_variant("v")
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    text = F.when(nested, F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
    typed = exploded.select(*keep, "name", kind.alias("kind"), text.alias("text")).withColumn(
        "arg_type", argument_type(F.col("kind"), F.col("text"))
    )

    def value(kinds: tuple[str, ...], sql_type: str) -> Column:
        return F.when(F.col("arg_type").isin(*kinds), F.col("text").try_cast(sql_type))

    return typed.select(
        *keep, "name", "arg_type",
        value(("int",), "bigint").alias("int_value"),
        value(("float",), "double").alias("float_value"),
        value(("bool",), "boolean").alias("bool_value"),
        value(("text", "json"), "string").alias("text_value"),
    )
