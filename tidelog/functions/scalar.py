"""Text, time, vector and JSON expressions; all but the byte histogram run in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, and the float epsilon below which a squared norm counts as zero (fixed values).
SPACES = " \t\n\x0b\x0c\r"
FLOAT_EPSILON = 1.1920929e-07
FENCE = "```"

# ---- text


def is_blank(c: Column) -> Column:
    """True for null and empty strings: a missing value on the way in."""
    return c.isNull() | (F.length(c) == 0)


def embedding_text(summary: Column, log: Column) -> Column:
    """The summary unless it is missing, else the log."""
    return F.coalesce(F.nullif(summary, F.lit("")), log)


def trim_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_code_fence(c: Column) -> Column:
    """Trimmed text; if it opens with a fence and has a second line, without its first line and all from the last fence on."""
    t = trim_ascii(c)
    body = F.regexp_replace(t, r"^[^\n]*\n", "")
    before_last = F.regexp_replace(body, r"(?s)```(?!.*```).*$", "")
    return F.when(t.startswith(FENCE) & (F.instr(t, "\n") > 0), trim_ascii(before_last)).otherwise(t)


def truncated(c: Column, most: int, suffix: str = "...") -> Column:
    """At most `most` characters, marked by the suffix if any are missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)


def joined_parts(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def event_text(event: str, **fields: Column) -> Column:
    """A log line: `event=<name> key=value ...`, in the order given; nulls are left out."""
    pairs = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()]
    return F.concat_ws(" ", F.lit(f"event={event}"), *pairs)


# ---- time


def from_proto_time(seconds: Column, nanos: Column) -> Column:
    """A timestamp of whole microseconds; nanoseconds below are cut off."""
    return F.timestamp_micros(seconds.cast("long") * 1_000_000 + F.floor(nanos / 1000).cast("long"))


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def or_now(ts: Column, now: Column | None = None) -> Column:
    """An unset or zero time means now."""
    return F.when(ts.isNull() | (F.unix_micros(ts) == 0), F.current_timestamp() if now is None else now).otherwise(ts)


def elapsed(now: Column, then: Column) -> Column:
    """Whole seconds since then, like `12s`; N/A if it never was."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1_000_000).cast("long")
    return F.coalesce(F.concat(seconds.cast("string"), F.lit("s")), F.lit("N/A"))


# ---- vectors


def query_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def inner_product(a: Column, b: Column) -> Column:
    """In double and in array order; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def normalised(v: Column) -> Column:
    """Unit length, or as it is if the squared length is within the float epsilon of zero."""
    square = F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    # both at hand as values, since v may be a Python function's, which no lambda may hold
    both = F.array(F.struct(v.alias("v"), F.when(square <= FLOAT_EPSILON, 1.0).otherwise(F.sqrt(square)).alias("n")))
    return F.element_at(F.transform(both, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), 1)


def byte_histogram(text: Column, buckets: int = 8) -> Column:
    """Counts of the UTF-8 bytes by their value modulo `buckets` (a power of two up to 256); null for a null text.

    One pass over each Arrow batch: counting bytes with text functions takes a pass for each bucket.
    """
    if buckets not in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("buckets must be a power of two up to 256")

    @F.pandas_udf("array<float>")
    def count(texts: pd.Series) -> pd.Series:
        each = lambda t: np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) & (buckets - 1), minlength=buckets).astype(np.float32)
        return texts.map(each, na_action="ignore")

    return count(text)


# ---- JSON

def request_body(prompt: Column, temperature: float = 0.1) -> Column:
    """The body of a generation request: the prompt as the one part of a user turn, answered in JSON."""
    content = F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt.alias("text"))).alias("parts"))
    config = F.struct(F.lit(temperature).alias("temperature"), F.lit("application/json").alias("responseMimeType"))
    return F.to_json(F.struct(F.array(content).alias("contents"), config.alias("generationConfig")))


def _items(node: Column, path: str) -> Column:
    """The elements of the array at the path; none if there is no array."""
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>"))


def _string(node: Column, path: str) -> Column:
    """The string at the path; null for anything else, which a plain cast would turn into text."""
    value = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, path, "string"))


def candidate_text(body: Column) -> Column:
    """All text parts of all candidates, line by line; nodes of another shape are passed over. Null if there is none."""
    parts = F.flatten(F.transform(_items(F.try_parse_json(body), "$.candidates"), lambda c: _items(c, "$.content.parts")))
    texts = F.filter(F.transform(parts, lambda p: _string(p, "$.text")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, joined_parts(texts))


SUMMARY_ERRORS = ("malformed JSON", "not an array", "empty array", "non-string entry", "empty string")


def summary_payload(payload: Column) -> Column:
    """struct(summaries, error) of a payload that must be a JSON array of non-blank strings, maybe fenced."""
    value = F.try_parse_json(strip_code_fence(payload))
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(items, lambda v: trim_ascii(_string(v, "$")))
    error = (
        F.when(value.isNull(), SUMMARY_ERRORS[0])
        .when(~F.schema_of_variant(value).startswith("ARRAY"), SUMMARY_ERRORS[1])
        .when(F.size(items) == 0, SUMMARY_ERRORS[2])
        .when(F.exists(texts, lambda t: t.isNull()), SUMMARY_ERRORS[3])
        .when(F.exists(texts, lambda t: t == ""), SUMMARY_ERRORS[4])
    )
    return F.struct(F.when(error.isNull(), texts).alias("summaries"), error.alias("error"))
