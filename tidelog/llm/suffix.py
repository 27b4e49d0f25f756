"""Removal of repeated substrings by suffix arrays built in two stages (Itoh and Tanaka, 1999).

Equal windows of `length` bytes share their anchor (see anchors), so suffixes need sorting only
among the contexts of one anchor hash, never over the whole corpus at once.

1. Each text's anchors are hashed. Hashes that occur once are done with: nothing there repeats.
2. Equal contexts are counted first. What occurs twice as a whole is repeated as a whole.
3. The distinct contexts of an anchor hash go to one suffix sorter, in blocks. Only suffixes smaller than
   their successors are sorted directly; the others follow by a scan of the buckets of first bytes.
   Neighbours whose common prefix reaches `length` are repeated windows.
4. A hash with too many distinct contexts for one block is cut finer: windows at like offsets from
   the anchor go together if the bytes that they must share are equal; in the end each window
   by itself, where equal ones are one context and are settled by their count.

If passages are asked for, windows of a second, shorter length go the same way beside the others. The last bit of a hash
tells which of the lengths it belongs to, so the two never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.anchors import anchors
from tidelog.llm.common import filter_bits, lean, may_hold, prefix_sums, staged, with_row_info

LENGTH = 400
#: A passage: more words than this in a run of bytes that repeated strings of so many bytes cover.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 250
#: Bits of the filters of anchor and text hashes.
FILTER_BITS = 26
#: Distinct contexts of a key that one sorter takes, and the bytes of suffixes that it sorts at a time.
MOST_CONTEXTS, BLOCK_BYTES = 2048, 1 << 20
#: Widths of the finer cuts; each is taken only by what the one before leaves too large.
CUTS = (64, 16, 4, 1)


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


# ---- the suffix sorter


def sorted_suffixes(text: bytes, limit: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes, each cut at its limit, up to `depth` bytes.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the
    buckets of first bytes upwards: the place before a sorted suffix, if its byte is not smaller,
    is the next one of its own bucket's first part.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    ends = np.zeros(n, bool)  # the last byte of a context: its suffix exceeds its successor, the empty one
    ends[limit[wanted] - 1] = True
    # smaller than the successor: the next different byte within the context is larger
    change = np.ones(n, bool)
    change[:-1] = (t[:-1] != t[1:]) | ends[:-1]
    run_end = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    up = np.zeros(n, bool)
    inner = run_end < n - 1
    up[inner] = (t[run_end[inner] + 1] > t[run_end[inner]]) & ~ends[run_end[inner]]
    # what is needed: the wanted places, and from each falling one on all up to the next rising one or end
    stop = np.where(up | ends, np.arange(n), n)
    next_stop = np.minimum.accumulate(stop[::-1])[::-1]
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, wanted, 1)
    np.add.at(delta, next_stop[wanted] + 1, -1)
    needed = np.cumsum(delta[:-1]) > 0

    rising = np.flatnonzero(needed & up)
    cut = np.minimum(rising + depth, limit[rising])
    slices = [text[i:j] for i, j in zip(rising.tolist(), cut.tolist(), strict=True)]
    rising = rising[sorted(range(len(slices)), key=slices.__getitem__)]
    del slices

    first_byte = t[rising]
    seeds = np.flatnonzero(needed & ends)  # followed by the empty suffix, the least of all
    incoming: list[list[np.ndarray]] = [[] for _ in range(256)]
    for byte in np.unique(t[seeds]):
        incoming[byte].append(seeds[t[seeds] == byte])
    out = []
    for byte in range(256):
        falling = []
        layer = np.concatenate(incoming[byte]) if incoming[byte] else np.empty(0, np.int64)
        while len(layer):  # runs of one byte
            falling.append(layer)
            before = layer[layer > 0] - 1
            layer = before[needed[before] & (t[before] == byte) & ~ends[before]]
        some = slice(np.searchsorted(first_byte, byte), np.searchsorted(first_byte, byte, side="right"))
        bucket = np.concatenate([*falling, rising[some]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (t[before] > byte) & ~ends[before]]
        if len(before):
            bytes_ = t[before]
            order = np.argsort(bytes_, kind="stable")
            cuts = np.flatnonzero(np.diff(bytes_[order])) + 1
            for part in np.split(before[order], cuts):
                incoming[t[part[0]]].append(part)
    out = np.concatenate(out)
    return out[np.isin(out, wanted)]


def _not_alone(text: bytes, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which of the wanted windows have a fingerprint that another one has too."""
    sums, inverse = prefix_sums(np.frombuffer(text, np.uint8))
    with np.errstate(over="ignore"):
        prints = (sums[wanted + length] - sums[wanted]) * inverse[wanted]
    order = np.argsort(prints)
    same = np.diff(prints[order]) == 0
    out = np.zeros(len(wanted), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def repeated_windows(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context, the ranges (first, last) of the starts of its windows that occur twice or more in them all.

    Suffixes are sorted where the fingerprint of the window is not the only one of its kind; the others have no equal.
    """
    text = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    limit = np.repeat(begin + sizes, sizes)
    starts = np.maximum(sizes - length + 1, 0)
    wanted = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, starts, strict=True)]) if len(contexts) else np.empty(0, np.int64)
    wanted = wanted[_not_alone(text, wanted, length)] if len(wanted) else wanted
    repeated = np.zeros(len(text) + 1, bool)
    order = sorted_suffixes(text, limit, wanted, length).tolist() if len(wanted) else []
    for i, j in zip(order, order[1:]):
        # the adjacent common prefix matters only in whether it reaches the length
        if text[i : i + length] == text[j : j + length]:
            repeated[i] = repeated[j] = True
    return [_ranges(repeated[b : b + s]) for b, s in zip(begin.tolist(), starts.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


# ---- over Spark


def _hashed(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            texts = [t.encode() for t in batch.column(0).slice(at, 512).to_pylist()]
            for _, h, c, *_ in anchors(texts, lengths, gram):
                yield pa.RecordBatch.from_pydict({"h": pa.array(h), "c": pa.array(c)})


def _contexts(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], gram: int, repeated, mixed) -> Iterator[pa.RecordBatch]:
    """Anchors whose hash may repeat; those whose contexts may differ come with the content, once for each task.

    h is the anchor's hash, c its context's; span holds the first start in the upper and the last in the lower half.
    """
    repeated, mixed, sent = repeated.value, mixed.value, set()
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            texts, hashes = [t.encode() for t in batch.column("text").to_pylist()], batch.column("text_hash").to_numpy()
            for owner, h, c, place, first, last in anchors(texts, lengths, gram, lambda h: may_hold(repeated, h)):
                content: list[bytes | None] = [None] * len(h)
                differ = np.flatnonzero(may_hold(mixed, h))
                ends = last + np.array(lengths)[h & 1]
                for i, *key, text, a, b in zip(*(x.tolist() for x in (differ, h[differ], c[differ], owner[differ], first[differ], ends[differ])), strict=True):
                    if tuple(key) not in sent:
                        if len(sent) >= 100_000:
                            sent.clear()
                        sent.add(tuple(key))
                        content[i] = texts[text][a:b]
                content = pa.array(content, pa.binary())
                columns = {"text_hash": pa.array(hashes[owner]), "h": pa.array(h), "c": pa.array(c), "span": pa.array(first << 32 | last)}
                columns["place"] = pa.array(place - first, mask=content.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict(columns | {"content": content})


def _sorter(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, content), sorted by key and sub: ranges of repeated windows of each, sorted in blocks of whole keys.

    A context that comes more than once counts once.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def settle():
        rows = []
        for level, length in enumerate(lengths):
            mine = [x for x in held if x[0] & 1 == level]
            ranges = repeated_windows([x[2] for x in mine], length)
            rows += [(k, s, a, b) for (k, s, _), found in zip(mine, ranges, strict=True) for a, b in found]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("key", "sub", "r0", "r1"), columns, strict=True)})

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "sub", "content")], strict=True):
            if held and row[:2] == held[-1][:2]:
                continue
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield settle()
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield settle()


def _cut(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], width: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut into pieces of windows whose distance to the anchor falls into one step of `width`.

    All windows of a step contain the bytes between its last start and its first end, also when a
    context has only some of them; that core is their common key.
    """
    names = ("h", "c", "key", "sub", "off", "content")
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for h, c, place, content in zip(*[batch.column(x).to_pylist() for x in ("h", "c", "place", "content")], strict=True):
            length = lengths[h & 1]
            for step in range((place - (len(content) - length)) // width, place // width + 1):
                start = max(0, place - step * width - width + 1)
                last = min(len(content) - length, place - step * width)
                core = content[place - step * width : place - step * width - width + 1 + length]
                piece = content[start : last + length]
                key = xxhash.xxh3_64_intdigest(core, (h ^ (step + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                sub = xxhash.xxh3_64_intdigest(piece, place - start)
                for column, value in zip(out, (h, c, signed(key & ~1 | h & 1), signed(sub), start, piece), strict=True):
                    column.append(value)
        kinds = (*[pa.int64()] * 5, pa.binary())
        yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})


def _sorted_ranges(distinct: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """key, sub, r0, r1 from distinct (key, sub, content)."""
    return distinct.select("key", "sub", "content").repartition("key").sortWithinPartitions("key", "sub").mapInArrow(
        lean(lambda it: _sorter(it, lengths)), "key long, sub long, r0 long, r1 long"
    )


def _united(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of overlapping or touching (start, end)."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def _words(data: bytes, a: int, b: int) -> int:
    """Whole words in a stretch of a text: those that it cuts at its ends don't count."""
    joined = lambda at: 0 < at < len(data) and len(data[at - 1 : at + 1].strip()) == 2
    return len(data[a:b].split()) - joined(a) - joined(b)


def _kept(batches: Iterator[pa.RecordBatch], length: int, short: int, full: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "has_passage": [], "spans": [], "kept": []}
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = text.encode()
                found = [(r >> 32, r & 0x7FFFFFFF, r >> 31 & 1) for r in ranges or ()]
                spans = _united([(a, b + length) for a, b, level in found if not level])
                at_, parts = 0, []
                for a, b in spans:
                    parts.append(data[at_:a])
                    at_ = b
                kept = b"".join([*parts, data[at_:]])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["has_passage"].append(any(_words(data, a, b) > PASSAGE_WORDS for a, b in _united([(a, b + short) for a, b, level in found if level])))
                if full:
                    out["spans"].append([{"start": a, "end": b} for a, b in spans])
                    out["kept"].append(kept)
            columns = {"doc_id": batch.column("doc_id")} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
            columns["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
            if short < length:
                columns["has_passage"] = pa.array(out["has_passage"], pa.bool_())
            if full:
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                columns |= {"spans": pa.array(out["spans"], pa.list_(span)), "kept": pa.array(out["kept"], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int | None = None, full: bool = True, most_contexts: int = MOST_CONTEXTS, short: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text); if full, also spans and kept.

    Every byte goes that a string of `length` bytes covers which also starts anywhere else, in the
    same text or another. Spans are the maximal removed runs, as offsets in the UTF-8 bytes, end
    exclusive; kept is the rest, concatenated. Null and shorter texts lose nothing. Repeated rows
    are texts each, and repeat each other; equal texts get equal results. Any doc_id may be null. An
    empty table gives an empty result; other columns of docs are ignored. Texts are told apart by
    a 64-bit hash, and may have less than 2^31 bytes.

    With a `short` below length there is also has_passage: whether the strings of `short` bytes that start
    anywhere else too cover a run of more than PASSAGE_WORDS words. It takes nothing away.
    """
    short = min(short or length, length)
    lengths = (length, short) if short < length else (length,)
    gram = gram or max(1, short // 6)
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text", F.octet_length("text")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    long_enough = docs.where(F.octet_length("text") >= short)

    # hashes that occur twice or more, and whether with different contexts
    hashed = long_enough.select("text").mapInArrow(lean(lambda it: _hashed(it, lengths, gram)), "h long, c long")
    seen = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    seen = staged(seen.where("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    share = spark.sparkContext.broadcast
    repeated, mixed = share(filter_bits(seen, "h", FILTER_BITS)), share(filter_bits(seen.where("mixed"), "h", FILTER_BITS))

    schema = "text_hash long, h long, c long, span long, place long, content binary"
    found = staged(long_enough.select("text_hash", "text").mapInArrow(lean(lambda it: _contexts(it, lengths, gram, repeated, mixed)), schema), "contexts")
    counts = staged(found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")), "counts")
    # the hashes with too many contexts are few: else the contents are shuffled once, to the sorters
    heavy = counts.groupBy("h").agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") > most_contexts).select("h")
    heavy = staged(heavy, "heavy")
    texts = few = found.where(F.col("content").isNotNull()).select("h", "c", "place", "content")
    if any_heavy := bool(heavy.head(1)):
        few = texts.join(heavy, "h", "left_anti")
        texts = staged(texts.join(heavy, "h", "left_semi").dropDuplicates(["h", "c"]), "texts")
    ranges = _sorted_ranges(few.select(F.col("h").alias("key"), F.col("c").alias("sub"), "content"), lengths)
    results = [ranges.withColumnsRenamed({"key": "h", "sub": "c"})]

    # hashes with too many contexts: finer and finer
    window = F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, length).otherwise(short)
    many = texts
    for width in (w for w in CUTS if w == 1 or 2 * w <= short):  # the windows of a step must have a core in common
        if not (any_heavy and many.head(1)):
            break
        pieces = staged(
            many.select("h", "c", "place", "content").mapInArrow(
                lean(lambda it, width=width: _cut(it, lengths, width)), "h long, c long, key long, sub long, off long, content binary"
            ),
            "pieces",
        )
        copies = pieces.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("n"))
        per_key = copies.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"))
        whole = pieces.join(copies.where("n > 1"), ["key", "sub"])
        results.append(whole.select("h", "c", F.col("off").alias("r0"), (F.col("off") + F.octet_length("content") - window).alias("r1")))
        rest = pieces.join(per_key.where(F.col("distinct") > 1), "key")
        distinct = rest.where(F.col("distinct") <= most_contexts).dropDuplicates(["key", "sub"])
        small = _sorted_ranges(distinct, lengths)
        back = pieces.select("h", "c", "key", "sub", "off").join(small, ["key", "sub"])
        results.append(back.select("h", "c", (F.col("off") + F.col("r0")).alias("r0"), (F.col("off") + F.col("r1")).alias("r1")))
        heavy = rest.where(F.col("distinct") > most_contexts).select("h", "c").distinct()
        many = texts.join(heavy, ["h", "c"], "left_semi")

    within = results[0]
    for more in results[1:]:
        within = within.unionByName(more)
    # a context that occurs twice is one range, the others have those that were found inside
    twice = counts.where("n > 1").select("h", "c", F.lit(0).cast("long").alias("r0"), F.lit(None).cast("long").alias("r1"))
    once = within.join(counts.where("n = 1").select("h", "c"), ["h", "c"], "left_semi")
    places = found.select("text_hash", "h", "c", "span").join(twice.unionByName(once), ["h", "c"])
    first, last = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    start = first + F.col("r0")
    level = F.shiftleft(F.col("h").bitwiseAND(F.lit(1).cast("long")), 31)
    ranges = F.shiftleft(start, 32).bitwiseOR(F.coalesce(first + F.col("r1"), last)).bitwiseOR(level)
    per_text = places.select("text_hash", ranges.alias("range")).groupBy("text_hash").agg(F.collect_set("range").alias("ranges"))
    per_text = staged(per_text, "ranges")

    out = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out += ", has_passage boolean" if short < length else ""
    out += ", spans array<struct<start:long,end:long>>, kept binary" if full else ""
    told = with_row_info(docs, per_text, "ranges")
    return told.select("doc_id", "text", "ranges").mapInArrow(lean(lambda it: _kept(it, length, short, full)), out)
