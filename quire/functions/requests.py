"""Requests to a recognising model and its replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompts by kind.
PROMPTS = {"table": "\nTable Recognition:", "equation": "\nFormula Recognition:", "image": "\nImage Analysis:", "chart": "\nImage Analysis:", "[default]": "\nText Recognition:", "[layout]": "\nLayout Detection:"}
END = "<|im_end|>"


def prompt_for(kind: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    """The kind's own prompt if it has one that is not blank, else the default."""
    out = F.lit(prompts["[default]"])
    for k, v in prompts.items():
        if v.strip() and k[0] != "[":
            out = F.when(kind == k, v).otherwise(out)
    return out


def frequency_penalty(kind: Column) -> Column:
    return F.when(kind == "table", 0.005).otherwise(0.05)


def completion(finish: Column, content: Column, failed: Column, no_choice: Column, tokens: Column, truncated_ok: bool, end: str = END) -> Column:
    """struct(text, warning) of a chat reply in the lenient mode: what is wrong becomes a warning."""
    n = F.concat(F.lit("(generated "), tokens.cast("string"), F.lit(" tokens)"))
    text = F.when(content.endswith(end), F.regexp_replace(content, F.lit("\\Q" + end + "\\E$"), F.lit(""))).otherwise(content)
    fine = (finish == "stop") | ((finish == "length") & F.lit(truncated_ok))
    warning = (
        F.when(failed, "error object").when(no_choice, "missing choices").when(content.isNull(), F.concat(F.lit("empty content "), n))
        .when(finish.isNull(), F.concat(F.lit("missing finish reason "), n)).when(~fine, F.concat(F.lit("unexpected finish reason: "), finish, F.lit(" "), n))
    )
    return F.struct(F.when(failed | no_choice, "").otherwise(F.coalesce(text, F.lit(""))).alias("text"), warning.alias("warning"))


def retry_temperature(base: Column, used: Column) -> Column:
    """The next temperature after so many retries; null when there is none."""
    now = F.least(base + used * 0.2, F.lit(1.0))
    step = F.least(base + (used + 1) * 0.2, F.lit(1.0))
    return F.when((base >= 0) & (base < 1) & (used < 5) & (now < 1) & (step > now), step)


def backoff(factor: Column, attempt: Column, jitter: Column) -> Column:
    """Seconds to wait before a retry; jitter is in [0.5, 1)."""
    return factor * F.pow(F.lit(2.0), attempt) * jitter


def retries_status(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)
