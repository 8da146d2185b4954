"""Publishing of documents: tables by Spark's committer, then one file set a document.

Paths of assets are unique and portable; pages must be complete; a stem's files replace the earlier ones as a whole.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def asset_faults(assets: DataFrame) -> DataFrame:
    """(doc_id, path, fault) of assets that cannot be published: outside images/, not portable, or one path with two contents."""
    parts = F.split("path", "/", -1)
    portable = F.col("path").startswith("images/") & (F.size(parts) > 1) & F.forall(parts, text.is_portable) & ~F.col("path").contains("\\")
    n = assets.groupBy("doc_id", "path").agg(F.count_distinct("sha256").alias("n"))
    return n.select("doc_id", "path", F.when(~portable, "not portable").when(F.col("n") > 1, "two contents").alias("fault")).filter("fault is not null")


def unique_assets(assets: DataFrame, cap: int) -> DataFrame:
    """Each path once, with the running bytes of its document and whether they are over the cap."""
    once = assets.dropDuplicates(["doc_id", "path"])
    w = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    return once.withColumn("upto", F.sum("bytes").over(w)).withColumn("over", F.col("upto") > cap)


def complete(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents (doc_id) all of whose expected pages (doc_id, page_idx) are there, and no others."""
    keys = ["doc_id", "page_idx"]
    wrong = expected.select(*keys).exceptAll(pages.select(*keys)).unionByName(pages.select(*keys).exceptAll(expected.select(*keys)))
    return expected.select("doc_id").distinct().join(wrong.select("doc_id").distinct(), "doc_id", "left_anti")


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Parquet tables by name, dealt out by document where they have one."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/{name}")


#: The files of a document, by the column that holds each.
FILES = {"markdown": "{stem}.md", "content_list": "{stem}_content_list.json", "content_list_v2": "{stem}_content_list_v2.json", "middle": "{stem}_middle.json", "document": "{stem}_model.json"}


class Folder:
    """Files of a folder that all executors have mounted; another store needs the same five methods."""

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)

    def rename(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(new), exist_ok=True)
        os.rename(old, new)

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def remove(self, path: str) -> None:
        shutil.rmtree(path, ignore_errors=True)


def _install(store: Folder, stage: str, target: str) -> None:
    """The staged folder in place of the target's; if that fails, the earlier files stay."""
    old = f"{stage}.old"
    if store.exists(target):
        store.rename(target, old)
    try:
        store.rename(stage, target)
    except OSError:
        if store.exists(old):
            store.rename(old, target)
        raise
    store.remove(old)


def publish(documents: DataFrame, root: str, profile: str = "vlm", store: Folder | None = None) -> int:
    """Write {root}/{stem}/{profile}/ with a file for each column of FILES that documents (stem, ...) has; how many documents.

    Each task writes its own documents: a folder is built aside, then swapped in by renames, so that a task that is run
    again writes the same files.  Rows that repeat a stem are refused, as they would overwrite each other."""
    if not documents.groupBy("stem").count().filter("count > 1").isEmpty():
        raise ValueError("two documents with one stem")
    store = store or Folder()
    names = {c: f for c, f in FILES.items() if c in documents.columns}

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                target = os.path.join(root, row["stem"], profile)
                stage = f"{target}.{uuid.uuid4().hex}"
                for column, name in names.items():
                    store.write(os.path.join(stage, name.format(stem=row["stem"])), (row[column] or "").encode())
                _install(store, stage, target)
            yield pd.DataFrame({"n": [len(frame)]})

    done = documents.select("stem", *names).mapInPandas(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
