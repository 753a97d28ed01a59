"""Entities, recent turns and context of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.fixed_values import (
    AGENT_NAMES,
    COMPETITOR_CUES,
    COMPETITOR_TOPIC,
    DEFAULT_AGENT,
    ENTITY_KINDS,
    ENTITY_LABELS,
    EXCHANGE_TURNS,
    HOTEL_ID_PATTERN,
    METRIC_WORDS,
    PLACE_WORDS,
    RECENT_TURNS,
    TURN_CHARS,
)
from innsight.functions import text as tx

def _no_strings() -> Column:
    return F.array().cast("array<string>")


def entity_columns(text: Column) -> dict[str, Column]:
    """Entity arrays of a text: hotel ids, metrics, competitors, places and topics."""
    low = F.lower(text)
    hotels = F.regexp_extract_all(text, F.lit(HOTEL_ID_PATTERN), F.lit(1))
    return {
        "hotels": F.transform(hotels, lambda h: F.upper(h)),
        "metrics": tx.words_found(low, METRIC_WORDS),
        "competitors": _no_strings(),
        "locations": F.transform(tx.words_found(low, PLACE_WORDS), lambda p: F.initcap(p)),
        "topics": F.when(tx.contains_any(low, COMPETITOR_CUES), tx.word_array([COMPETITOR_TOPIC])).otherwise(
            _no_strings()
        ),
    }


def extract_entities(messages: DataFrame, text_col: str = "text") -> DataFrame:
    return messages.withColumns(entity_columns(F.col(text_col)))


def merge_entities(df: DataFrame, left: str, right: str, output: str) -> DataFrame:
    """Merge two entity structs: every list in first-seen order without repeats."""
    merged = [
        F.array_distinct(F.concat(F.col(f"{left}.{kind}"), F.col(f"{right}.{kind}"))).alias(kind)
        for kind in ENTITY_KINDS
    ]
    return df.withColumn(output, F.struct(*merged))


def entity_state(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Entities of each conversation as rows in first-seen order: ``(conv_id, kind, entity, position)``.

    Mentions are reduced to their first turn before anything is ordered, so a long
    conversation leaves one row per entity, not one per turn.
    """
    columns = entity_columns(F.col(text_col))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), columns[k].alias("names")) for k in ENTITY_KINDS])
    mentions = (
        messages.select("conv_id", "turn", F.inline(kinds))
        .select("conv_id", "turn", "kind", F.posexplode("names").alias("pos", "entity"))
    )
    first = mentions.groupBy("conv_id", "kind", "entity").agg(F.min(F.struct("turn", "pos")).alias("seen"))
    window = Window.partitionBy("conv_id", "kind").orderBy("seen.turn", "seen.pos", "entity")
    return first.select(
        "conv_id", "kind", "entity", F.col("seen.turn").alias("first_turn"),
        F.row_number().over(window).alias("position"),
    )


def entity_context(state: DataFrame) -> DataFrame:
    """One context string per conversation, a line per kind that has entities."""
    lists = state.groupBy("conv_id", "kind").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "entity"))), lambda e: e["entity"]), ", "
        ).alias("names")
    )
    order = F.array_position(tx.word_array(ENTITY_KINDS), F.col("kind"))
    label = F.element_at(F.create_map(*[F.lit(v) for pair in ENTITY_LABELS.items() for v in pair]), F.col("kind"))
    line = F.struct(order.alias("order"), F.concat(label, F.lit(": "), "names").alias("line"))
    return lists.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"
        ).alias("entity_context")
    )


def recent_turns(messages: DataFrame, n: int = RECENT_TURNS) -> DataFrame:
    """The last ``n`` turns of each conversation, ``back`` counting from the end."""
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(window)).filter(F.col("back") <= n)


def older_turns(messages: DataFrame, n: int = RECENT_TURNS) -> DataFrame:
    """Turns before the last ``n``: the part a summary has to cover."""
    oldest = recent_turns(messages, n).groupBy("conv_id").agg(F.min("turn").alias("first_kept"))
    return messages.join(oldest, "conv_id").filter(F.col("turn") < F.col("first_kept")).drop("first_kept")


def exchange(messages: DataFrame, n: int = EXCHANGE_TURNS, max_chars: int = TURN_CHARS) -> DataFrame:
    """The last turns of each conversation as text, each cut to ``max_chars``."""
    line = F.concat(F.upper("role"), F.lit(": "), tx.cap(F.col("text"), max_chars, "..."))
    # bounded: n short lines per conversation
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return (
        recent_turns(messages, n)
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("exchange"))
    )


def conversation_context(messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Context per conversation: summary, key entities and the last exchange."""
    entities = entity_context(entity_state(messages))
    joined = exchange(messages).join(entities, "conv_id", "left")
    if summaries is None:
        joined = joined.withColumn("summary", F.lit(None).cast("string"))
    else:
        joined = joined.join(summaries.select("conv_id", "summary"), "conv_id", "left")

    def part(title: str, name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(title), F.col(name)))

    context = F.concat_ws(
        "\n",
        part("[Previous Context]\n", "summary"),
        part("\n[Key Entities]\n", "entity_context"),
        part("\n[Recent Exchange]\n", "exchange"),
    )
    return joined.select("conv_id", context.alias("context"))


def agent_names(raw: Column, agents: Sequence[str] = tuple(AGENT_NAMES), default: str | None = DEFAULT_AGENT) -> Column:
    """Agents named in a routing answer.

    Exact items of a comma or line list, else every known name in order of appearance,
    else the default.
    """
    text = F.lower(raw)
    known = tx.word_array(agents)
    items = F.transform(F.split(text, "[,\n]"), tx.strip)
    listed = F.filter(items, lambda i: F.array_contains(known, i))
    places = F.transform(
        F.filter(known, lambda a: F.contains(text, a)),
        lambda a: F.struct(F.position(a, text).alias("place"), a.alias("name")),
    )
    mentioned = F.transform(F.array_sort(places), lambda p: p["name"])
    fallback = _no_strings() if default is None else tx.word_array([default])
    return F.when(F.size(listed) > 0, listed).when(F.size(mentioned) > 0, mentioned).otherwise(fallback)


def chart_lines(text: Column) -> Column:
    """Lines that carry a chart mark and a link."""
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.contains(line, F.lit("📊")) & F.contains(line, F.lit("http"))
    )
    return F.transform(lines, tx.strip)
