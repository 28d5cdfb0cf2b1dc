"""JSON, HTML, PDF-like and REST sources, and settings."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import trim_ws

#: Text layers shorter than this are read again by a recogniser.
TEXT_LAYER_LEAST = 50


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array (or JSON Lines); malformed values become null."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_json(df: DataFrame, path: str, files: int = 1) -> None:
    """JSON Lines; one file only where the caller says the rows fit one."""
    df.coalesce(files).write.mode("overwrite").json(path)


def body(col: Column | str, schema: str) -> Column:
    """A JSON request body; null fields for a missing or malformed one."""
    return F.from_json(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("{}")), schema)


def html_text(html: Column | str) -> Column:
    """The text of an HTML page: scripts, styles and tags removed, block ends as line breaks, common entities resolved."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"(?s)<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(a), F.lit(b))
    return trim_ws(F.regexp_replace(h, r"[ \t]+", " "))


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, modificationTime) of files; the upload and download connector."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def document_pages(files: DataFrame, extract: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(path, page_number, text_content, page_count) of each file by a pluggable extractor.

    Where the text layer of a page has fewer than TEXT_LAYER_LEAST characters the recogniser, where
    one is given, reads the page; an error of either gives an empty text, of the file no page.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, raw in zip(p["path"], p["content"]):
                try:
                    texts = extract(bytes(raw))
                except Exception:
                    continue
                for n, t in enumerate(texts, 1):
                    if recognise and len((t or "").strip()) < TEXT_LAYER_LEAST:
                        try:
                            t = recognise(bytes(raw), n)
                        except Exception:
                            t = ""
                    rows.append((path, n, t or "", len(texts)))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text_content", "page_count"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text_content string, page_count int")


def form_feed_pages(raw: bytes) -> list[str]:
    """Extractor for plain text: pages end at form feeds."""
    return raw.decode("utf-8", "replace").split("\f")


class RestPages(DataSource):
    """``format("rest")``: rows of a JSON service that answers {success, data: {items: [...]}}, and rows posted to it.

    Options: url (with {offset} and {limit} where it pages), total, limit (1 to 500), timeout. An
    answer without success raises.
    """

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a service is only appended to")
        return _RestWriter(self.options)


class _RestWriter(DataSourceWriter):
    """Posts each row as a JSON object, or its column ``item`` as it stands where it is the only one.

    An answer without success fails the task; a task that is run again posts its rows again, so the
    service must take a row twice.
    """

    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        for row in iterator:
            told = row.asDict(recursive=True)
            data = told["item"] if [*told] == ["item"] else json.dumps(told, ensure_ascii=False, default=str)
            ask = urllib.request.Request(self.url, data=(data or "{}").encode(), headers={"Content-Type": "application/json"}, method="POST")  # noqa: S310
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:  # noqa: S310
                _success(json.loads(r.read()))
        return WriterCommitMessage()


def _success(answer: dict) -> dict:
    if not answer.get("success"):
        raise RuntimeError(answer.get("message") or "the service reported a failure")
    return answer


class _RestReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 30))
        self.limit = max(1, min(500, int(options.get("limit", 500))))
        self.total = int(options.get("total", self.limit))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, max(1, self.total), self.limit)]

    def read(self, partition: InputPartition):
        url = self.url.replace("{offset}", str(partition.value)).replace("{limit}", str(self.limit))
        with urllib.request.urlopen(url, timeout=self.timeout) as r:  # noqa: S310
            answer = _success(json.loads(r.read()))
        data = answer.get("data") or {}
        for item in data.get("items", data) if isinstance(data, dict) else data:
            yield (json.dumps(item, ensure_ascii=False),)


def envelope(success: bool, message: str = "", data: object = None, details: object = None) -> dict:
    """The answer of every service call."""
    return {"success": success, "message": message, "data": data} | ({"details": details} if details is not None else {})


@dataclass
class Settings:
    """Settings with typed values; a variable that does not parse leaves the default."""

    chunk_min_words: int = 200
    chunk_max_words: int = 300
    chunk_target_words: int = 250
    semantic_top_k: int = 200
    debug: bool = False
    summary_provider: str = "auto"

    @classmethod
    def read(cls, env: dict[str, str] | None = None) -> Settings:
        env, got = os.environ if env is None else env, {}
        for f in fields(cls):
            v = env.get(f.name.upper())
            if v is None:
                continue
            if f.type == "bool":
                got[f.name] = v.strip().lower() in {"1", "true", "yes", "on"}
            elif f.type == "int":
                try:
                    got[f.name] = int(v)
                except ValueError:
                    pass
            else:
                got[f.name] = v
        return cls(**got)
