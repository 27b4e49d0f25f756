"""Summarizers: one conversation log in, one or more summaries out."""

from __future__ import annotations

import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_WORDS = 200


class SummaryError(Exception):
    """A failed summary; code is one of INVALID_ARGUMENT, INTERNAL, UNAVAILABLE, DEADLINE_EXCEEDED."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Retry:
    """Attempts with exponential back-off; times in seconds."""

    attempts: int = 3
    first: float = 0.1
    factor: float = 2.0
    most: float = 0.5
    codes: frozenset = frozenset({"INVALID_ARGUMENT", "INTERNAL", "UNAVAILABLE", "DEADLINE_EXCEEDED"})

    def call(self, fn: Callable, sleep: Callable[[float], None] = time.sleep):
        """fn's result; an error of another code, or the last attempt's, is raised."""
        wait = self.first
        for left in range(max(1, self.attempts) - 1, -1, -1):
            try:
                return fn()
            except SummaryError as error:
                if not left or error.code not in self.codes:
                    raise
            sleep(wait)
            wait = min(self.most, wait * self.factor)


class Summarizer(ABC):
    @abstractmethod
    def summaries(self, log: str) -> list[str]:
        """At least one summary; raises SummaryError."""

    def column(self, log: Column) -> Column:
        """struct(summaries, error) of each log; a null log has neither."""
        summarizer = self

        @F.pandas_udf("summaries array<string>, error string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for logs in batches:
                rows = [summarizer._attempt(x) for x in logs]
                yield pd.DataFrame(rows, columns=["summaries", "error"])

        return run(log)

    def _attempt(self, log) -> tuple[list[str] | None, str | None]:
        if not isinstance(log, str):
            return None, None
        try:
            return self.summaries(log), None
        except SummaryError as error:
            return None, f"{error.code}: {error}"


def exploded(rows: DataFrame, summarizer: Summarizer, log: str) -> DataFrame:
    """One row for each summary: the 1-to-N form, with place and summary."""
    found = rows.withColumn("__s", summarizer.column(F.col(log)))
    return found.select(*rows.columns, F.posexplode("__s.summaries").alias("place", "summary"))


def parts(log: str, most_words: int = SHORT_WORDS) -> list[str]:
    """Contiguous parts of about most_words words; a log that short is one part, and no fenced block is cut."""
    if len(log.split()) <= most_words:
        return [log]
    pieces = re.findall(r"```.*?(?:```|\Z)[^\n]*\n?|[^\n]*\n|[^\n]+", log, re.S)
    out, size = [""], 0
    for piece in pieces:
        n = len(piece.split())
        if size and size + n > most_words:
            out.append("")
            size = 0
        out[-1] += piece
        size += n
    if len(out) == 1:  # one long line or block: a cut between words of the line, never in a block
        if log.lstrip().startswith("```"):
            return out
        words = re.findall(r"\S+\s*|\s+", log)
        out = ["".join(words[i : i + most_words]) for i in range(0, len(words), most_words)]
    return out


class ExtractiveSummarizer(Summarizer):
    """Without a model: the first words of each part."""

    def __init__(self, words: int = 40):
        self.words = words

    def summaries(self, log: str) -> list[str]:
        out = [" ".join(p.split()[: self.words]) for p in parts(log)]
        kept = [s for s in out if s]
        if not kept:
            raise SummaryError("INVALID_ARGUMENT", "empty log")
        return kept


def strip_fence(text: str) -> str:
    """Python's side of scalar.strip_code_fence."""
    spaces = " \t\n\x0b\x0c\r"
    t = text.strip(spaces)
    if not t.startswith("```") or "\n" not in t:
        return t
    inner = t.split("\n", 1)[1]
    return (inner[: inner.rindex("```")] if "```" in inner else inner).strip(spaces)


def parse_summaries(payload: str) -> list[str]:
    """A JSON array of non-blank strings, maybe fenced."""
    try:
        value = json.loads(strip_fence(payload))
    except ValueError as error:
        raise SummaryError("INVALID_ARGUMENT", f"malformed JSON: {error}") from None
    if not isinstance(value, list):
        raise SummaryError("INVALID_ARGUMENT", "not an array")
    if not value:
        raise SummaryError("INVALID_ARGUMENT", "empty array")
    out = []
    for item in value:
        if not isinstance(item, str):
            raise SummaryError("INVALID_ARGUMENT", "non-string entry")
        out.append(item.strip(" \t\n\x0b\x0c\r"))
        if not out[-1]:
            raise SummaryError("INVALID_ARGUMENT", "empty string")
    return out


def parse_response(body: str) -> str:
    """All text parts of a response's candidates, line by line."""
    try:
        tree = json.loads(body)
    except ValueError as error:
        raise SummaryError("INTERNAL", f"malformed response: {error}") from None
    candidates = tree.get("candidates") if isinstance(tree, dict) else None
    if not isinstance(candidates, list) or not candidates:
        raise SummaryError("INTERNAL", "no candidates")
    found = []
    for candidate in candidates:
        content = candidate.get("content") if isinstance(candidate, dict) else None
        of = content.get("parts") if isinstance(content, dict) else None
        found += [p["text"] for p in of or [] if isinstance(of, list) and isinstance(p, dict) and isinstance(p.get("text"), str)]
    if not found:
        raise SummaryError("INTERNAL", "no text parts")
    return "\n".join(found)


INSTRUCTIONS = (
    "Summarise the agent conversation below for a search index, in two or three lines. "
    f"Up to {SHORT_WORDS} words it is one part; a longer one is cut into contiguous parts where its sense allows, "
    "never inside a fenced code block. Answer with a JSON array that has one summary string for each part.\n\n"
)


class RemoteSummarizer(Summarizer):
    """A generation service behind a transport: a function from the request's JSON to the response's."""

    def __init__(self, transport: Callable[[str], str], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep):
        self.transport, self.retry, self.sleep = transport, retry, sleep

    def request(self, log: str) -> str:
        content = {"role": "user", "parts": [{"text": INSTRUCTIONS + log}]}
        return json.dumps({"contents": [content], "generationConfig": {"temperature": 0.1, "responseMimeType": "application/json"}})

    def summaries(self, log: str) -> list[str]:
        body = self.request(log)
        return self.retry.call(lambda: parse_summaries(parse_response(self.transport(body))), self.sleep)
