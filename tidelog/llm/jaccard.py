"""N-gram Jaccard join by multiple-global-order filtering, and the groups that its links form.

A document is its set of distinct k-word shingles. Two sets link when their similarity is at least
num / den. Under any one order of all shingles, two linked sets of n and m shingles share
a member of their prefixes, the n - ceil(n * num / den) + 1 first ones; more than that, what they
share outside the prefixes is at most what the prefixes leave over, so the prefixes must share
enough that the needed overlap stays reachable. Three orders are used. All put shingles that a
fixed-size count sketch has seen often last, and each orders the rest by its own hash.

1. Equal sets are one class. Each class posts its first prefix; postings of shingles that no other
   class posted are dropped.
2. Short posting lists are joined with themselves, and the shared postings of each pair are counted.
   Long lists are dealt to tiles in Python, which compare all prefixes of a tile at once and return
   a spanning forest of its candidates, never its pairs.
3. Pairs that pass the first order must pass the other two. What passes all three forms clusters.
4. A cluster is dealt to tiles of its sets, cut by set size, where candidates are verified exactly.
   A tile returns a spanning forest of its links and each class's number of linked documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, filter_bits, lean, may_hold, mix64, shingle_set, shingles, splittable, staged
from tidelog.llm.graph import components

ORDERS = 3
#: Counters of the frequency sketch: a fixed size, whatever the data's.
SKETCH_BITS = 18
SKETCH_BLOCK = 4096
#: Posting lists up to this length are joined with themselves.
SHORT_LIST = 32
#: Classes in one side of a tile.
TILE = 512
#: Bits of the filter that keeps the texts of classes without candidates from being shuffled.
FILTER_BITS = 24
#: Most bits of the filter of shingles that were posted more than once; it goes by their lower bits. Up to
#: there it has about POSTING_SHARE bits for each posting; beyond, it lets more through.
POSTING_BITS, POSTING_SHARE = 27, 6


@dataclass(frozen=True)
class Similarity:
    """Shingles of k words; sets link at intersection / union >= num / den."""

    k: int = 5
    num: int = 8
    den: int = 10

    def prefix(self, n: int) -> int:
        return n + (-self.num * n // self.den) + 1


def _prefix(tokens: np.ndarray, size: int, levels: np.ndarray, order: int) -> np.ndarray:
    """The first `size` tokens of one global order: by how common the sketch holds them, then by hash, then by token."""
    keys = levels[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] | (mix64(tokens, 10 + order) >> np.uint64(16))
    last = np.partition(keys, size - 1)[size - 1]
    first = tokens[keys < last]
    return np.concatenate([first, np.sort(tokens[keys == last])[: size - len(first)]])


def _prefixes(tokens: np.ndarray, sim: Similarity, levels: np.ndarray) -> list[np.ndarray]:
    """The set's prefix under each order; those of the later ones are only counted for an upper bound, so 32 bits do."""
    size = sim.prefix(len(tokens)) if len(tokens) else 0
    if not size:
        return [tokens.view(np.int64), *[np.empty(0, np.int32)] * (ORDERS - 1)]
    first, *others = (_prefix(tokens, size, levels, order) for order in range(ORDERS))
    return [first.view(np.int64), *((mix64(x, 20) >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in others)]


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(block, width, counts): counters of the sketch, in blocks of SKETCH_BLOCK unsigned integers of `width` bytes."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            found = [shingles(t, k) for t in batch.column(0).slice(at, 512).to_pylist()]
            counts += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    parts = [(i, part, np.min_scalar_type(part.max())) for i, part in enumerate(counts.reshape(-1, SKETCH_BLOCK)) if part.any()]
    columns = {"block": [i for i, _, _ in parts], "width": [kind.itemsize for _, _, kind in parts]}
    columns = {c: pa.array(v, pa.int32()) for c, v in columns.items()}
    yield pa.RecordBatch.from_pydict(columns | {"counts": pa.array([part.astype(kind).tobytes() for _, part, kind in parts], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of whole blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, width, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts, f"u{width}").astype(np.int64)
    for block, total in sums.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [total.tobytes()]})


def token_levels(docs: DataFrame, k: int) -> np.ndarray:
    """For each counter of the sketch over all documents, its level as the upper 16 bits of sort keys."""
    parts = docs.select("text").mapInArrow(lean(lambda it: _counted(it, k)), "block int, width int, counts binary")
    found = parts.repartition("block").mapInArrow(lean(_summed), "block int, counts binary").toArrow()
    counts = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    for block, total in zip(found["block"].to_pylist(), found["counts"].to_pylist(), strict=True):
        counts[block] = np.frombuffer(total, np.int64)
    return np.floor(32 * np.log2(1 + counts.reshape(-1))).astype(np.uint64) << np.uint64(48)


def _class_of(tokens: np.ndarray) -> np.int64:
    """A 64-bit digest of a set of shingles."""
    if not len(tokens):
        return np.int64(0)
    with np.errstate(over="ignore"):
        total = mix64(tokens, 3).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix64(tokens, 5)) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0]


def _featured(batches: Iterator[pa.RecordBatch], sim: Similarity, levels) -> Iterator[pa.RecordBatch]:
    """Each document's set size, class and first prefix."""
    levels = levels.value
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            n, sid, first = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, sim.k)
                n.append(len(tokens))
                sid.append(_class_of(tokens))
                first.append(_prefix(tokens, sim.prefix(len(tokens)), levels, 0).view(np.int64) if len(tokens) else tokens.view(np.int64))
            out = {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array(n, pa.int64()), "sid": pa.array(sid, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | {"p0": pa.array(first, pa.list_(pa.int64()))})


def _asked(batches: Iterator[pa.RecordBatch], sim: Similarity, levels, bits) -> Iterator[pa.RecordBatch]:
    """All prefixes of the documents that may stand for a class in question.

    32 bits of each token do to count for an upper bound if those that coincide within a set are counted besides.
    """
    for whole in _maybe(batches, "text_hash", bits):
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            found = [_prefixes(shingle_set(t, sim.k), sim, levels.value) for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash")}
            for order in range(ORDERS):
                lists = [(f[order] & 0x7FFFFFFF).astype(np.int32) for f in found]
                out[f"p{order}"] = pa.array(lists, pa.list_(pa.int32()))
                out[f"lost{order}"] = pa.array(_lost(lists), pa.int64())
            yield pa.RecordBatch.from_pydict(out)


def _maybe(batches: Iterator[pa.RecordBatch], column: str, bits) -> Iterator[pa.RecordBatch]:
    """The rows whose column's bit is set."""
    for batch in batches:
        yield batch.filter(pa.array(may_hold(bits.value, batch.column(column).to_numpy())))


def _postings(batches: Iterator[pa.RecordBatch], bits, width: int) -> Iterator[pa.RecordBatch]:
    """(token, sid, n) of the first prefixes' tokens that may have been posted twice."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            lists = batch.column("p0")
            tokens = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hit = may_hold(bits.value, tokens << (64 - width))
            owner = pa.array(owner[hit])
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[hit]), "sid": batch.column("sid").take(owner), "n": batch.column("n").take(owner)})


def _needed(na: np.ndarray, nb: np.ndarray, sim: Similarity) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-(na[:, None] + nb[None, :]) * sim.num // (sim.num + sim.den))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a's with b's sets, by products of incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    vocabulary = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(vocabulary):
        return out

    def places(sets):
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
        known = vocabulary[at] == tokens
        order = np.argsort(at[known], kind="stable")
        return at[known][order], owner[known][order]

    sides = [(*places(a), len(a)), (*places(b), len(b))]
    for start in range(0, len(vocabulary), 4096):
        stop, parts = min(start + 4096, len(vocabulary)), []
        for at, owner, size in sides:
            matrix = np.zeros((size, stop - start), np.float32)
            some = slice(np.searchsorted(at, start), np.searchsorted(at, stop))
            matrix[owner[some], at[some] - start] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def _lost(sets: list[np.ndarray]) -> np.ndarray:
    """How many members of each list coincide with others of it."""
    return np.array([len(x) - len(np.unique(x)) for x in sets], np.int64)


def _passes(a: pd.DataFrame, b: pd.DataFrame, sim: Similarity) -> np.ndarray:
    """Which pairs the sizes and all orders' prefixes allow."""
    na, nb = a["n"].to_numpy(), b["n"].to_numpy()
    small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    ok = (small * sim.den >= large * sim.num) & (a["sid"].to_numpy()[:, None] != b["sid"].to_numpy()[None, :])
    need = _needed(na, nb, sim)
    for order in range(ORDERS):
        if not ok.any():
            break
        pa_, pb = list(a[f"p{order}"]), list(b[f"p{order}"])
        rest_a = na - np.array([len(x) for x in pa_])
        rest_b = nb - np.array([len(x) for x in pb])
        # tokens may be narrowed: of a set whose lost ones coincide with others, so many more may be shared
        lost = np.minimum(_lost(pa_)[:, None], _lost(pb)[None, :])
        shared = _common(pa_, pb)
        ok &= (shared > 0) & (shared + lost + np.maximum(rest_a[:, None], rest_b[None, :]) >= need)
    return ok


def _forest(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the matrix links: each id with the least id of its component."""
    ids = np.unique(np.concatenate([ids_a, ids_b]))
    at_a, at_b = np.searchsorted(ids, ids_a), np.searchsorted(ids, ids_b)
    label = np.arange(len(ids))
    r, c = np.nonzero(linked)
    r, c = at_a[r], at_b[c]
    while len(r):
        least = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, least)
        np.minimum.at(new, c, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _tile_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by keys; holds one group at a time."""
    held = []
    for batch in batches:
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for start, stop in zip(change, [*change[1:], len(batch)], strict=True):
            part = batch.iloc[start:stop]
            if held and (held[-1][keys].iloc[-1] != part[keys].iloc[0]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(batches: Iterator[pd.DataFrame], sim: Similarity) -> Iterator[pd.DataFrame]:
    for group in _tile_groups(batches, ["token", "tile"]):
        group = group.drop_duplicates(["side", "sid"])
        a = group[group["side"] == 0]
        b = a if group["same"].iloc[0] else group[group["side"] == 1]
        x, y = _forest(a["sid"].to_numpy(), b["sid"].to_numpy(), _passes(a, b, sim))
        yield pd.DataFrame({"a": x, "b": y})


def _verified(batches: Iterator[pd.DataFrame], sim: Similarity, levels) -> Iterator[pd.DataFrame]:
    """Rows (a, b, links): forest edges have links 0, and each class that links has (a, a, linked documents)."""
    for group in _tile_groups(batches, ["cluster", "tile"]):
        group = group.drop_duplicates(["side", "sid"]).copy()
        group["tokens"] = [shingle_set(t, sim.k) for t in group.pop("text")]
        for order, prefixes in enumerate(zip(*[_prefixes(t, sim, levels.value) for t in group["tokens"]], strict=True)):
            group[f"p{order}"] = list(prefixes)
        same = bool(group["same"].iloc[0])
        a = group[group["side"] == 0]
        b = a if same else group[group["side"] == 1]
        ok = _passes(a, b, sim)
        rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(rows):
            continue
        common = _common([a["tokens"].iloc[i] for i in rows], [b["tokens"].iloc[i] for i in cols]).astype(np.int64)
        union = a["n"].to_numpy()[rows][:, None] + b["n"].to_numpy()[cols][None, :] - common
        linked = (sim.den * common >= sim.num * union) & ok[np.ix_(rows, cols)]
        ids_a, ids_b = a["sid"].to_numpy()[rows], b["sid"].to_numpy()[cols]
        x, y = _forest(ids_a, ids_b, linked)
        yield pd.DataFrame({"a": x, "b": y, "links": np.zeros(len(x), np.int64)})
        degrees = [(ids_a, linked @ b["copies"].to_numpy()[cols])]
        if not same:
            degrees.append((ids_b, a["copies"].to_numpy()[rows] @ linked))
        for ids, links in degrees:
            yield pd.DataFrame({"a": ids, "b": ids, "links": links.astype(np.int64)})[links > 0]


def _size_bucket(sim: Similarity) -> Column:
    """Linked sets lie in one bucket or in neighbouring ones; the tiny slack keeps rounding harmless."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(sim.den / sim.num)) + 1e-9)).cast("int")


def _tiled(rows: DataFrame, group: str, sim: Similarity) -> DataFrame:
    """rows (group, sid, n, ...) dealt to tiles: adds tile, side and same.

    A group's classes are cut by set size into buckets, and each bucket by a hash into blocks of
    about TILE classes. A block meets itself, the later blocks of its bucket and all blocks of
    the next bucket; every pair that the sizes allow meets in exactly one tile.
    """
    rows = rows.withColumn("bucket", _size_bucket(sim))
    # several small neighbouring buckets stay one tile: a group of at most TILE classes is not cut
    whole = rows.groupBy(group).agg(F.count(F.lit(1)).alias("in_group"))
    sizes = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    sizes = sizes.join(whole, group).withColumn("blocks", F.when(F.col("in_group") <= TILE, 1).otherwise(F.ceil(F.col("in_bucket") / TILE).cast("int")))
    sizes = sizes.withColumn("cut", F.col("in_group") > TILE)
    next_ = sizes.select(group, (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("next_blocks"))
    before = sizes.select(group, (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("before_blocks"))
    plan = sizes.select(group, "bucket", "blocks", "cut").join(next_, [group, "bucket"], "left").join(before, [group, "bucket"], "left")
    rows = rows.join(splittable(plan, group), [group, "bucket"])
    block = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("blocks")).cast("int")
    name = lambda bucket, i, bucket2, j: F.concat_ws(":", bucket, i, bucket2, j)
    tile = lambda name, side, same: F.struct(name.alias("tile"), F.lit(side).alias("side"), same.alias("same"))
    b, empty = F.col("bucket"), F.array().cast("array<struct<tile:string,side:int,same:boolean>>")
    others = lambda n: F.sequence(F.lit(0), n - 1)
    tiles = F.concat(
        F.transform(
            others(F.col("blocks")),
            lambda j: tile(
                name(b, F.least(F.col("block"), j), b, F.greatest(F.col("block"), j)), 0, j == F.col("block")
            ).withField("side", (j < F.col("block")).cast("int")),
        ),
        F.when(F.col("next_blocks") > 0, F.transform(others(F.col("next_blocks")), lambda j: tile(name(b, F.col("block"), b + 1, j), 0, F.lit(False)))).otherwise(empty),
        F.when(F.col("before_blocks") > 0, F.transform(others(F.col("before_blocks")), lambda j: tile(name(b - 1, j, b, F.col("block")), 1, F.lit(False)))).otherwise(empty),
    )
    tiles = F.when(F.col("cut"), tiles).otherwise(F.array(tile(F.lit("all"), 0, F.lit(True))))
    out = rows.withColumn("block", block).withColumn("t", F.explode(tiles))
    drop = ["bucket", "blocks", "cut", "next_blocks", "before_blocks", "block", "t"]
    return out.withColumn("tile", F.col("t.tile")).withColumn("side", F.col("t.side")).withColumn("same", F.col("t.same")).drop(*drop)


def _in_python(rows: DataFrame, group: str, fn, schema: str) -> DataFrame:
    """fn over whole tiles, dealt evenly; a partition streams its tiles one after another."""
    return rows.repartition(group, "tile").sortWithinPartitions(group, "tile").mapInPandas(lean(fn), schema)


def _row_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """By the document's id, which may be null, and its text's hash."""
    right = right.withColumnsRenamed({"doc_id": "r_doc_id", "text_hash": "r_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_hash") == F.col("r_text_hash"))
    return left.join(right, same, how).drop("r_doc_id", "r_text_hash")


def jaccard_groups(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, group_id, n_links of each row of docs (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included. group_id is equal
    for the rows of a component, and n_links is the number of other rows that the row links with. A
    row whose text is null, empty or without words has no shingles, no links and no group_id;
    its component_id is its doc_id. Rows with a null doc_id take part, and their component_id
    is null only if no reachable row has an id. Repeated rows are linked copies. An empty table
    gives an empty result; other columns of docs are ignored. text_hash is xxhash64 of the text, null as empty.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    levels = spark.sparkContext.broadcast(token_levels(docs, sim.k))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_hash long, n long, sid long, p0 array<long>"
    rows = staged(docs.select("doc_id", "text_hash", "text").mapInArrow(lean(lambda it: _featured(it, sim, levels)), schema), "prefixes")

    # one row stands for each class
    some = rows.where("n > 0")
    classes = some.groupBy("sid").agg(
        F.min("doc_id").alias("least_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("row"),
        F.count(F.lit(1)).alias("copies"),
        F.min("n").alias("n"),
    )
    classes = staged(classes.select("sid", "n", "least_id", "copies", "row.doc_id", "row.text_hash"), "classes")

    # postings that at least two classes made: a filter of a fixed size, then exactly
    share = spark.sparkContext.broadcast
    posted = some.agg(F.sum(F.size("p0"))).first()[0] or 0
    width = min(POSTING_BITS, max(16, math.ceil(math.log2(POSTING_SHARE * posted + 1))))
    often = share(filter_bits(some, "p0", width, least=2, lower=True))
    postings = some.select("sid", "n", "p0").mapInArrow(lean(lambda it: _postings(it, often, width)), "token long, sid long, n long").distinct()
    postings = staged(postings, "postings")
    # the prefixes take the most room, and are done with
    often.destroy()
    whole, rows = rows, staged(rows.drop("p0"), "rows")
    discard(whole)
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    listed = staged(postings.join(splittable(shared, "token"), "token"), "listed")
    discard(postings)

    # order 1, short lists: the shared postings of a pair are counted
    long_ = listed.where(F.col("length") > SHORT_LIST)
    in_long = long_.groupBy("sid").agg(F.count(F.lit(1)).alias("in_long"))
    short = listed.where(F.col("length") <= SHORT_LIST).select("token", "sid", "n")
    x, y = short.alias("x"), short.alias("y")
    allowed = (F.col("x.sid") < F.col("y.sid")) & (F.least("x.n", "y.n") * sim.den >= F.greatest("x.n", "y.n") * sim.num)
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where(allowed)
    pairs = pairs.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(
        F.count(F.lit(1)).alias("shared")
    )
    need = F.ceil((F.col("na") + F.col("nb")) * sim.num / (sim.num + sim.den)).cast("long")
    prefix = lambda n: n - F.ceil(n * sim.num / sim.den) + 1
    rest = F.greatest(F.col("na") - prefix(F.col("na")), F.col("nb") - prefix(F.col("nb")))
    unseen = in_long.select(F.col("sid").alias("a"), "in_long")
    pairs = pairs.join(unseen, "a", "left").where(F.col("shared") + F.coalesce("in_long", F.lit(0)) + rest >= need - 1).drop("in_long")
    pairs = staged(pairs, "pairs")

    # the other orders, for the classes that are still in question
    asked = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).unionAll(long_.select("sid")).distinct()
    asked = staged(classes.join(asked, "sid").select("sid", "doc_id", "text_hash"), "asked")
    asked_bits = share(filter_bits(asked, "text_hash", FILTER_BITS))
    prefixes = docs.select("doc_id", "text_hash", "text").mapInArrow(
        lean(lambda it: _asked(it, sim, levels, asked_bits)), ", ".join([f"doc_id {id_type}, text_hash long", *(f"p{i} array<int>, lost{i} long" for i in range(ORDERS))])
    )
    prefixes = _row_join(prefixes, asked, "inner").drop("doc_id", "text_hash").dropDuplicates(["sid"])
    prefixes = staged(prefixes, "asked-prefixes")
    later = [str(i) for i in range(1, ORDERS)]
    side = lambda s: prefixes.select(F.col("sid").alias(s), *[F.col(f"{c}{i}").alias(f"{s}_{c}{i}") for c in ("p", "lost") for i in later])
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    for i in later:
        both = F.size(F.array_intersect(f"a_p{i}", f"b_p{i}"))
        pairs = pairs.where((both > 0) & (both + F.least(f"a_lost{i}", f"b_lost{i}") + rest >= need - 1))

    # long lists
    dealt = _tiled(long_.select("token", "sid", "n"), "token", sim).join(prefixes.drop(*[f"lost{i}" for i in range(ORDERS)]), "sid")
    forest = _in_python(dealt, "token", lambda it: _candidates(it, sim), "a long, b long")
    clusters = components(pairs.select("a", "b").unionAll(forest))

    # verification
    members = clusters.unionAll(clusters.select(F.col("root").alias("node"), "root")).distinct()
    members = members.select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    chosen = staged(members.join(classes, "sid"), "clusters")
    tiles = _tiled(chosen.select("doc_id", "text_hash", "sid", "n", "copies", "cluster"), "cluster", sim)
    wanted = share(filter_bits(chosen, "text_hash", FILTER_BITS))
    texts = docs.select("doc_id", "text_hash", "text").mapInArrow(
        lean(lambda it: _maybe(it, "text_hash", wanted)), f"doc_id {id_type}, text_hash long, text string"
    )
    full = _row_join(texts, tiles, "inner").select("sid", "n", "copies", "cluster", "tile", "side", "same", "text")
    checked = staged(_in_python(full, "cluster", lambda it: _verified(it, sim, levels), "a long, b long, links long"), "links")

    # what is linked
    links = checked.where("links > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("a <> b").select("a", "b"))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()
    named = classes.join(roots, classes["sid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = named.join(least, "root").join(links, "sid", "left").select("sid", "root", "component_id", "copies", "links")
    out = rows.select("doc_id", "text_hash", "n", "sid").join(splittable(labels, "sid"), "sid", "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").alias("group_id"),
        F.when(empty, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
