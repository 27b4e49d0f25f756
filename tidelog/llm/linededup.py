"""Removal of repeated lines or paragraphs by global grouping of their digests.

Every unit is normalised and hashed to 128 bits where its text lies. The digests are grouped over
all documents, with map-side minima, so that a unit in a third of all documents is still one small
group. The earliest occurrence stays: the least (doc_id, text hash, place). The others go, and
their offsets in the original text are kept.

A passage that begins and ends inside longer lines is no unit. So the digests of short paragraphs, which
are cut by content alone, are grouped as well: from each sentence on, the fewest sentences that
have PASSAGE words. They tell which documents hold a passage that another document has too; nothing is
removed by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import filter_bits, lean, may_hold, staged, with_row_info

#: How units end: a line at each line feed, a paragraph at each run of two or more.
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n{2,}")}
#: Words that a unit needs to be removed: any.
MIN_WORDS = 1
#: Bits of the filter of passages that may be shared.
FILTER_BITS = 26
#: Where sentences end, and the words that make sentences a passage: whole sentences of so many words lie in
#: most passages of over 50 words, wherever those begin.
SENTENCE, PASSAGE = re.compile(r"[.!?]+(?:[ \t-\r]+|\Z)|\n+"), 20


def units(text: str, kind: str = "line") -> list[tuple[int, int]]:
    """(start, end) of each unit, in code points, its break not included."""
    out, at = [], 0
    for m in BREAKS[kind].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(unit: str, min_words: int) -> str | None:
    """Lower case, words with one space between; None if there are too few."""
    words = unit.lower().split()
    return " ".join(words) if len(words) >= max(1, min_words) else None


def passages(text: str, least: int = PASSAGE) -> set[str]:
    """From each sentence on, the fewest sentences with at least `least` words: their words in lower case with one space between."""
    words, starts = [], []
    for sentence in SENTENCE.split(text.lower()):
        if found := sentence.split():
            starts.append(len(words))
            words += found
    starts.append(len(words))
    out, j = set(), 0
    for i in range(len(starts) - 1):
        while j < len(starts) and starts[j] - starts[i] < least:
            j += 1
        if j == len(starts):
            break
        out.add(" ".join(words[starts[i] : starts[j]]))
    return out


def _digests(parts: list[str]) -> np.ndarray:
    """Both halves of the parts' 128-bit digests, as longs."""
    raw = b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in parts)
    return np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)


def _hashed(batches: Iterator[pa.RecordBatch], kind: str, min_words: int, passage: int) -> Iterator[pa.RecordBatch]:
    """A row for each unit and, with place -1, for each passage."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            owner, places, starts, ends, parts = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for place, (start, end) in enumerate(units(text, kind)):
                    if (plain := normalised(text[start:end], min_words)) is not None:
                        places.append(place)
                        starts.append(start)
                        ends.append(end)
                        parts.append(plain)
                        owner.append(row)
                found = passages(text, passage)
                for column, value in ((places, -1), (starts, 0), (ends, 0), (owner, row)):
                    column += [value] * len(found)
                parts += found
            digests, owner = _digests(parts), pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(owner),
                    "text_hash": batch.column("text_hash").take(owner),
                    "place": pa.array(places, pa.int64()),
                    "start": pa.array(starts, pa.int64()),
                    "end": pa.array(ends, pa.int64()),
                    "d1": pa.array(digests[:, 0]),
                    "d2": pa.array(digests[:, 1]),
                }
            )


def _rest(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                marks = {(g["start"], g["end"]) for g in gone or ()}
                spans = sorted(m for m in marks if m[0] >= 0)
                found, removed, kept, at_ = units(text, kind), set(spans), [], 0
                for i, (start, end) in enumerate(found):
                    if (start, end) in removed:  # with its break
                        stop = found[i + 1][0] if i + 1 < len(found) else end
                        kept.append(text[at_:start])
                        at_ = stop
                rest = "".join([*kept, text[at_:]])
                rows.append((len(found) if text else 0, len(spans), ",".join(f"{a}:{b}" for a, b in spans), rest, hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest(), len(marks) > len(spans)))
            names = ("n_units", "n_removed", "removed", "kept", "kept_sha256", "has_passage")
            kinds = {"n_units": pa.int64(), "n_removed": pa.int64(), "has_passage": pa.bool_()}
            out = {n: pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | out)


def remove_repeated_units(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_units, n_removed, removed, kept, kept_sha256, has_passage of each row of docs (doc_id, text).

    removed has the original offsets of the removed units, start:end in code points, joined by
    commas; kept is the text without them and the breaks that follow them. Units of fewer than
    min_words words, blank ones at least, stay. The earliest occurrence is the one of the least doc_id (a null comes after all),
    then text hash, then place in the text. has_passage tells whether whole sentences with together at least
    `passage` words stand in another document too; it is false for texts of fewer words. Null and empty texts have
    no units and no passage. Rows that are equal in doc_id and text are one document: all get its
    result. An empty table gives an empty result; other columns of docs are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_hash long, place long, start long, end long, d1 long, d2 long"
    every = staged(docs.mapInArrow(lean(lambda it: _hashed(it, kind, min_words, passage)), schema), "units")
    found = every.where("place >= 0")
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "place")
    first = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last")
    first = first.select("d1", "d2", F.col("first.text_hash").alias("f_hash"), F.col("first.place").alias("f_place"), F.col("first.doc_id").alias("f_id"))
    first = staged(first, "first")  # the join then has a shuffle of its own, whose hot digests the engine can split
    kept = (F.col("text_hash") == F.col("f_hash")) & (F.col("place") == F.col("f_place")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
    gone = found.join(first, ["d1", "d2"]).where(~kept).select("doc_id", "text_hash", F.struct("start", "end").alias("span"))
    shared = _shared(every.where("place < 0")).select("doc_id", "text_hash", F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end")).alias("span"))
    # a span before the text marks a passage
    per_text = gone.unionByName(shared).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("gone"))
    told = with_row_info(docs, staged(per_text, "gone"), "gone")
    out = f"doc_id {id_type}, n_units long, n_removed long, removed string, kept string, kept_sha256 string, has_passage boolean"
    return told.select("doc_id", "text", "gone").mapInArrow(lean(lambda it: _rest(it, kind)), out)


def _shared(passages: DataFrame) -> DataFrame:
    """The documents (doc_id, text_hash) of passages that stand in two documents or more, once each."""
    passages = passages.select("doc_id", "text_hash", "d1", "d2", F.xxhash64("doc_id", "text_hash").alias("document"))
    two = passages.groupBy("d1", "d2").agg(F.min("document").alias("lo"), F.max("document").alias("hi")).where("lo <> hi")
    two = staged(two.select("d1", "d2"), "shared")
    bits = passages.sparkSession.sparkContext.broadcast(filter_bits(two, "d1", FILTER_BITS))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits.value, batch.column("d1").to_numpy())))

    passages = passages.drop("document")
    return passages.mapInArrow(lean(may), passages.schema).join(two, ["d1", "d2"]).select("doc_id", "text_hash").distinct()
