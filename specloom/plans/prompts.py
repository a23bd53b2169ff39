"""Prompts of conversion strategies, assembled as columns; sending them is outside the engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import blank

#: The fields that a template names.
TEXT, EXAMPLES = "{nl_text}", "{examples_block}"
#: What a system prompt that was not filled in still holds.
UNFILLED = re.compile(r"\[[A-Z_]*PLACEHOLDER\]")


def examples_block(examples: DataFrame) -> DataFrame:
    """One row, column block: the examples (nl, rimay), numbered in the order of ``k`` or as they come."""
    k = F.col("k") if "k" in examples.columns else F.monotonically_increasing_id()
    rows = examples.select(k.alias("k"), blank(F.col("nl")).alias("nl"), blank(F.col("rimay")).alias("rimay"))
    listed = F.array_sort(F.collect_list(F.struct("k", "nl", "rimay")))
    one = lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nNL: "), x["nl"], F.lit("\nRimay: "), x["rimay"])
    return rows.agg(F.rtrim(F.array_join(F.transform(listed, one), "\n\n")).alias("block"))


def fill(template: str, text: Column, block: Column | None = None) -> Column:
    """The template with its fields filled in; doubled braces become single ones."""
    parts, out = template.replace("{{", "\0").replace("}}", "\1"), []
    for k, part in enumerate(parts.split(TEXT)):
        out += [text] if k else []
        for j, piece in enumerate(part.split(EXAMPLES)):
            if j and block is None:
                raise ValueError("the template asks for examples")
            out += [block] if j else []
            out.append(F.lit(piece.replace("\0", "{").replace("\1", "}")))
    return F.concat(*out)


def _plain(requirements: DataFrame, template: str, examples: DataFrame | None) -> DataFrame:
    return requirements.withColumn("user", fill(template, F.coalesce("nl_text", F.lit(""))))


def _with_examples(requirements: DataFrame, template: str, examples: DataFrame | None) -> DataFrame:
    if examples is None:
        raise ValueError("this strategy needs examples")
    # one short row, so it is a literal of the plan
    block = examples_block(examples).first()["block"]
    return requirements.withColumn("user", fill(template, F.coalesce("nl_text", F.lit("")), F.lit(block)))


#: Strategies by name: functions of requirements (req_id, nl_text), a template and examples; more may be added.
STRATEGIES: dict[str, Callable[[DataFrame, str, DataFrame | None], DataFrame]] = {"zsl": _plain, "fsl": _with_examples, "cot": _plain}


def build_prompts(requirements: DataFrame, strategy: str, template: str, system: str, examples: DataFrame | None = None) -> DataFrame:
    """Adds the columns system and user to requirements; errors for an unknown strategy or an unfinished system prompt."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    if UNFILLED.search(system):
        raise ValueError("the system prompt still holds its placeholder")
    return STRATEGIES[strategy](requirements, template, examples).withColumn("system", F.lit(system))
