"""Answerers of items by name: each maps rows with evidence to answers, and any function of a batch can be one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import score

Provider = Callable[[DataFrame], DataFrame]
_KNOWN: dict[str, Provider] = {}


def register(name: str, provider: Provider | None = None):
    """Make a provider known by a name; as a decorator too."""

    def add(f: Provider) -> Provider:
        if name in _KNOWN:
            raise ValueError(f"a provider {name!r} is known already")
        _KNOWN[name] = f
        return f

    return add if provider is None else add(provider)


def available() -> tuple[str, ...]:
    return tuple(sorted(_KNOWN))


def provider(name: str) -> Provider:
    try:
        return _KNOWN[name]
    except KeyError:
        raise KeyError(f"unknown provider {name!r}; known: {', '.join(available())}") from None


def by_batch(answer: Callable[[pd.DataFrame], list], columns: list[str]) -> Provider:
    """A provider of a function of a batch of rows with these columns: a model's client goes in here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "answer": answer(batch[columns])})

    return lambda items: items.select("item_id", *[c for c in columns if c != "item_id"]).mapInPandas(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, answer string")


@register("front end")
def front_end(items: DataFrame) -> DataFrame:
    """The measured evidence in prose; nothing where there is none."""
    return items.filter("estimated_azimuth_deg IS NOT NULL").select("item_id", score.prose(F.col("estimated_azimuth_deg"), F.col("instrument")).alias("answer"))


@register("always centre")
def centre(items: DataFrame) -> DataFrame:
    return items.select("item_id", score.prose(F.lit(0.0), F.col("instrument")).alias("answer"))


@register("no answer")
def refusal(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.lit(None).cast("string").alias("answer")).limit(0)


@register("audio only")
def audio_only(items: DataFrame) -> DataFrame:
    """A stand-in for a model that names the louder side alone."""
    return items.select("item_id", F.concat(F.lit("It is on the "), F.when(F.col("ild_db") > 0, "left").when(F.col("ild_db") < 0, "right").otherwise("center"), F.lit(".")).alias("answer"))
