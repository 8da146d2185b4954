"""Documents from files, page renderers and recognising models: what reads the outside world.

Rendering pages and converting office files need libraries of their own; both are callables that a caller passes in.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import kinds

_SUFFIX = r"\.([^./]+)$"


def discover(spark: SparkSession, folder: str, most_bytes: int = 4_293_918_719) -> tuple[DataFrame, DataFrame]:
    """(inputs, skipped) of one folder level: path, kind, length. The content is not read; the length is a pushed filter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    named = files.withColumn("kind", kinds.document_kind(F.regexp_extract("path", _SUFFIX, 1)))
    fine = F.col("kind").isNotNull() & (F.col("length") <= most_bytes)
    return named.filter(fine).orderBy("path"), named.filter(~fine | F.col("kind").isNull()).orderBy("path")


def contents(spark: SparkSession, folder: str, most_bytes: int = 4_293_918_719) -> DataFrame:
    """(path, kind, content) of the documents in a folder; files above the limit are not opened."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") <= most_bytes)
    return files.select("path", kinds.document_kind(F.regexp_extract("path", _SUFFIX, 1)).alias("kind"), "content").filter("kind is not null")


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New documents of a folder as a stream."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path", "modificationTime", "length", kinds.document_kind(F.regexp_extract("path", _SUFFIX, 1)).alias("kind"), "content").filter("kind is not null")


def rendered(docs: DataFrame, render: Callable[[bytes], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """(path, page_idx, width, height, image, error): the pages that ``render`` yields; a failing document is a row with its error."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                try:
                    rows = [(r.path, i, w, h, image, None) for i, (w, h, image) in enumerate(render(r.content))]
                except Exception as e:  # noqa: BLE001  one bad document does not stop the others
                    rows = [(r.path, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=["path", "page_idx", "width", "height", "image", "error"])

    return docs.select("path", "content").mapInPandas(pages, "path string, page_idx int, width int, height int, image binary, error string")


class ChatModel:
    """A served model behind an HTTP chat endpoint: retries on timeouts, 408, 429 and 5xx, waiting ever longer."""

    def __init__(self, url: str, model: str, timeout: float = 600, retries: int = 3, factor: float = 0.5, send: Callable | None = None):
        self.url, self.model, self.timeout, self.retries, self.factor = url.rstrip("/"), model, timeout, retries, factor
        self.send = send or self._send

    def _send(self, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}/v1/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return json.load(reply)

    def __call__(self, body: dict) -> dict:
        for attempt in range(self.retries + 1):
            try:
                return self.send(body | {"model": self.model})
            except urllib.error.HTTPError as e:
                if attempt == self.retries or not (e.code in (408, 429) or 500 <= e.code < 600):
                    return {"error": {"message": f"status {e.code}"}}
            except (TimeoutError, urllib.error.URLError) as e:
                if attempt == self.retries:
                    return {"error": {"message": type(e).__name__}}
            time.sleep(self.factor * 2**attempt * 0.75)
        return {"error": {"message": "no reply"}}


def predicted(requests: DataFrame, keys: list[str], body: str, model: Callable[[], Callable[[dict], dict]], concurrency: int = 16) -> DataFrame:
    """(keys..., reply): each request's JSON body answered by a model that each task makes once; replies keep their keys.

    A pool within the task sends so many at a time; rows stay in batches, so memory is bounded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                replies = pool.map(lambda b: json.dumps(ask(json.loads(b))), frame[body])
                yield frame[keys].assign(reply=list(replies))

    kept = requests.select(*keys, body)
    schema = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInPandas(run, f"{schema}, reply string")
