"""Pages recognised in two steps: a layout, then a reply for each block that needs one.

The model is a callable from a request to a reply, which each task makes once (``sources.files.predicted``).  Asking is
the dear part, so what is asked is written to a folder that the caller names before it is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import formulas, requests
from quire.operators import cleaning, layout, spatial
from quire.sources import files

PAGE = ["doc_id", "page_idx"]
# Temperatures go up by STEP to MOST, RETRIES times at most, with at least this much to choose from.
STEP, MOST, RETRIES, TOP_K, TOP_P = 0.2, 1.0, 5, 40, 0.9
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def _longest(items: list[str]) -> int:
    return max((len(list(run)) for item, run in groupby(items) if len(item) >= 8), default=0)


def failure(reply: str, stage: str = "content") -> str | None:
    """Why a reply should be asked for again; null if it is fine. A layout may be empty."""
    if not reply.strip():
        return None if stage == "layout" else "blank"
    if "\ufffd" in reply:
        return "replacement-character"
    if _CONTROL.search(reply):
        return "control-character"
    lines = [x.strip() for x in reply.replace("\r\n", "\n").split("\n")]
    return "repetition" if formulas.period(reply) or _longest(reply.split()) >= 6 or _longest(lines) >= 4 else None


def _reply(response: dict) -> tuple[str, list[str]]:
    """The text of a chat reply, and what is wrong with it."""
    if "error" in response:
        return "", [f"error object: {(response['error'] or {}).get('message', 'no error message')}"]
    choices = response.get("choices") or []
    if not choices:
        return "", ["missing choices"]
    said = (choices[0].get("message") or {}).get("content")
    end = choices[0].get("finish_reason")
    wrong = ["empty content"] if said is None else [] if end in ("stop", "length") else [f"unexpected finish reason: {end}" if end else "missing finish reason"]
    return (said or "").removesuffix(requests.END), wrong


class Careful:
    """A model that is asked again, at the next temperature, while its reply fails; replies are {text, warnings}."""

    def __init__(self, ask: Callable[[dict], dict], stage: str = "content"):
        self.ask, self.stage = ask, stage

    def __call__(self, body: dict) -> dict:
        base, warnings, body = body.get("temperature"), [], dict(body)
        for used in range(RETRIES + 1):
            said, wrong = _reply(self.ask(body))
            warnings += wrong
            why = failure(said, self.stage)
            hotter = None if base is None or not 0 <= base < MOST else round(min(base + (used + 1) * STEP, MOST), 6)
            if why is None or hotter is None or used == RETRIES or base + used * STEP >= MOST:
                break
            body["temperature"] = hotter
            if 0 < body.get("top_k", 0) < TOP_K:
                body["top_k"] = TOP_K
            if body.get("top_p", TOP_P) < TOP_P:
                body["top_p"] = TOP_P
            warnings.append(f"temperature retry: temperature={hotter:.1f} quality={why}")
        return {"text": said, "warnings": [f"{self.stage}: {w}" for w in warnings]}


_SAID = "text string, warnings array<string>"


def asked(rows: DataFrame, keys: list[str], prompt, model: Callable[[], Callable[[dict], dict]], stage: str, folder: str, image: str = "image", temperature: float = 0.0) -> DataFrame:
    """(keys..., text, warnings) for each row's prompt and image reference, written to a folder and read again."""
    said = [F.struct(F.lit("image_url").alias("type"), F.struct(F.col(image).alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text"))]
    said.append(F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), prompt.alias("text")))
    body = F.to_json(F.struct(F.lit(temperature).alias("temperature"), F.array(F.struct(F.lit("user").alias("role"), F.array(*said).alias("content"))).alias("messages")))
    replies = files.predicted(rows.select(*keys, body.alias("body")), keys, "body", lambda: Careful(model(), stage))
    out = replies.select(*keys, F.from_json("reply", _SAID).alias("r")).select(*keys, "r.text", "r.warnings")
    out.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(out.schema).parquet(folder)


def two_step(pages: DataFrame, model: Callable[[], Callable[[dict], dict]], folder: str, analyse_images: bool = True, formulas_on: bool = True, tables_on: bool = True, most_blocks: int = 256, most_requests: int = 128) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) of pages (doc_id, page_idx, image): layout, candidates, replies and their cleaning.

    blocks: doc_id, page_idx, block_idx, kind, sub_type, box in per-mille, angle, merge_prev, content.  A page with more
    blocks than most_blocks has an empty layout, one with more candidates is asked about the first; both are warnings."""
    suppressed = tuple(k for k, on in (("equation", formulas_on), ("table", tables_on)) if not on)
    said = asked(pages, PAGE, F.lit(requests.PROMPTS["[layout]"]), model, "layout", f"{folder}/layout")
    found = layout.parse(said.select(*PAGE, F.col("text").alias("layout"))).withColumnRenamed("pos", "block_idx")
    box = [F.round(F.col(c) * 1000).cast("int").alias(n) for c, n in (("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))]
    found = found.select(*PAGE, "block_idx", "kind", *box, "angle", "merge_prev")
    over = layout.over_cap(found, PAGE, most_blocks).filter("over").select(*PAGE, F.concat(F.lit("layout blocks exceed the per-page cap of "), F.lit(most_blocks).cast("string")).alias("warning"))
    found = found.join(over, PAGE, "left_anti")
    candidates = spatial.semantic_candidates(found, most_requests + 1, analyse_images, suppressed)
    many = candidates.filter(F.col("rank") > most_requests).select(*PAGE, F.lit(f"semantic requests exceed the per-page cap of {most_requests}").alias("warning"))
    keys = [*PAGE, "block_idx"]
    wanted = candidates.filter(F.col("rank") <= most_requests).join(pages.select(*PAGE, "image"), PAGE)
    # The crop is named by its box; a model that reads images cuts it out.
    crop = F.concat("image", F.lit("#"), F.concat_ws(",", "x0", "y0", "x1", "y1"))
    replies = asked(wanted.select(*keys, "kind", crop.alias("image")), keys, requests.prompt_for(F.col("kind")), model, "content", f"{folder}/content")
    blocks = cleaning.cleaned(found.join(replies.select(*keys, F.col("text").alias("reply")), keys, "left"))
    told = said.select(*PAGE, F.explode("warnings").alias("warning")).unionByName(replies.select(*PAGE, F.explode("warnings").alias("warning")))
    return blocks, told.unionByName(over).unionByName(many)
