"""Page summaries: extractive, or by a pluggable provider with the extractive one behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind, clean_text, first_sentences, sentences, truncate
from ..session import stage


def sentence_count(text: Column | str) -> Column:
    return F.size(sentences(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def prompt(template: str, text: Column, most_sentences: int) -> Column:
    """The template with its places for the number of sentences and the content filled, in that order."""
    if not template.strip():
        raise ValueError("a prompt template is required")
    out = F.replace(F.lit(template), F.lit("{max_sentences}"), F.lit(str(most_sentences)))
    for place in ("{content}", "{text}"):
        out = F.replace(out, F.lit(place), text)
    return out


def shortened(text: Column, most_sentences: int) -> Column:
    """A provider's text with white space collapsed, of at most 1 to 8 sentences; unchanged where it has no more."""
    n = max(1, min(8, most_sentences))
    return bind(sentences(text), lambda s: F.when(F.size(s) <= n, clean_text(text)).otherwise(F.array_join(F.slice(s, 1, n), " ")))


def summarise(pages: DataFrame, most_sentences: int = 3, provider: Callable[[list[str]], list[str]] | None = None, name: str = "provider", template: str = "{text}", most_chars: int = 12000) -> DataFrame:
    """(page_id, book_id, display_page_number, provider, summary, sentence_count, source_sentence_count).

    The provider gets batches of prompts; where it fails or answers nothing the extractive summary
    stands in. Pages with a null or blank text give an empty summary.
    """
    text = F.coalesce("text_content", F.lit(""))
    own = first_sentences(text, most_sentences)
    if provider is None:
        x = pages.withColumn("summary", own).withColumn("provider", F.lit("extractive"))
    else:

        @F.pandas_udf(T.StringType())
        def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                try:
                    yield pd.Series(list(provider(p.tolist())))
                except Exception:
                    yield pd.Series([None] * len(p))

        x = pages.withColumn("_said", ask(prompt(template, truncate(text, most_chars), most_sentences)))
        x = x.withColumn("_short", F.nullif(shortened(F.coalesce("_said", F.lit("")), most_sentences), F.lit("")))
        x = x.withColumn("summary", F.coalesce("_short", own)).withColumn("provider", F.when(F.col("_short").isNotNull(), name).otherwise("extractive"))
    return x.select("page_id", "book_id", "display_page_number", "provider", "summary", sentence_count("summary").alias("sentence_count"), sentence_count("text_content").alias("source_sentence_count"))


#: Fixed value: another name of a provider.
ALIASES = {"hf": "huggingface"}


def dispatch(pages: DataFrame, setting: str, providers: dict[str, Callable[[list[str]], list[str]] | None], most_sentences: int = 3) -> DataFrame:
    """The columns of :func:`summarise`, by the provider that ``setting`` names, or by all in order where it is auto.

    ``providers`` has those that are known, None for one that is not configured. A named provider
    that is not configured gives an empty summary and a null provider; where one fails or answers
    nothing the extractive summary stands in. With auto each configured provider gets the pages that
    those before it left.
    """
    name = ALIASES.get(setting, setting)
    if name != "auto":
        if providers.get(name):
            return summarise(pages, most_sentences, providers[name], name)
        return summarise(pages, most_sentences).withColumns({"provider": F.lit(None).cast("string"), "summary": F.lit(""), "sentence_count": F.lit(0)})
    done, left = [], pages
    for n, p in ((n, p) for n, p in providers.items() if p):
        x = stage(summarise(left, most_sentences, p, n))
        done.append(x.where(F.col("provider") == n))
        left = left.join(x.where(F.col("provider") != n).select("page_id"), "page_id", "left_semi")
    return reduce(DataFrame.unionByName, [*done, summarise(left, most_sentences)])
