"""Mixing to target weights with soft domain membership.

A classifier, fitted on a labelled table, gives each document a posterior over domains. Projected
gradient least squares then finds a rate r >= 0 for each document so that the expected
tokens of each domain, the sum over documents of r * tokens * posterior, meet their targets.

The gradient of a document's rate depends on the rest of the corpus only through one small vector,
the domains' residual. So an iteration is one aggregation over all documents, and a document's rate
is a fold over the residuals so far: nothing but a few numbers travels between iterations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lean, mix64, set_aside, staged, word_hashes

#: Buckets of the hashed words, and the classifier's sample: labelled rows of each domain, least hashes first.
BUCKETS, SAMPLE = 1 << 17, 1500
#: Domains that the classifier tells apart; the rarest labels beyond share one more, REST.
DOMAINS, REST = 32, "(rest)"
STEPS, RATE, DECAY = 400, 0.5, 1e-3
#: The residual (as a share of all tokens) at which the fit ends; or it ends when RECENT steps have together lessened the cost by less than GAIN of it.
TOLERANCE, GAIN, RECENT = 1e-4, 0.05, 10
#: Steps are halved down to this length.
SHORTEST = 2.0**-12
MILLION = 1_000_000
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
#: Shape features besides the words: a constant, five shares of a text's bytes, its repeated words and lines, its shortness.
SHAPES = 9
#: Words that the classifier uses stand in at least LEAST sample rows and set some domain apart by ASSOCIATED standard errors.
LEAST, ASSOCIATED = 5, 5.0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, marks not counting as parts of them, and the shape features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(_MARKS.sub(b" ", raw.lower()))
    distinct = np.unique((mix64(words) % np.uint64(BUCKETS)).astype(np.int32))
    data = np.frombuffer(raw, np.uint8)
    share = lambda *codes: float(np.isin(data, codes).mean()) if len(data) else 0.0
    upper = float(((data >= 65) & (data <= 90)).mean()) if len(data) else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    repeated = 1 - len(distinct) / len(words) if len(words) else 0.0
    marks = [10 * share(*m) for m in (b"!", b"|", b"#*$%&<>", b"0123456789")]
    return distinct, np.array([1.0, 4 * upper, *marks, 4 * again, 2 * repeated, 20 / (10 + len(words))])


@dataclass
class DomainModel:
    """A softmax over domains: weights of words (domains x buckets) and of shapes."""

    domains: list[str]
    words: np.ndarray
    shapes: np.ndarray

    def posterior(self, text: str | None) -> np.ndarray:
        found, shape = features(text)
        return _softmax((self.words[:, found].sum(axis=1) + self.shapes @ shape)[None, :])[0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DomainModel:
    """The classifier from docs (doc_id, text) and labels (doc_id, domain).

    It is fitted on at most `sample` labelled rows of each domain, with the domains' shares among all
    labels as priors. Of more than DOMAINS domains the commonest are told apart, and all rows of the others
    are one domain, REST. Without labelled documents there is one domain, "all".
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).select("doc_id", F.col("domain").cast("string"))
    sizes = labels.groupBy("domain").count().orderBy(F.desc("count"), "domain")
    counts = {r[0]: r[1] for r in sizes.limit(DOMAINS).collect()}
    if others := labels.count() - sum(counts.values()):
        labels = labels.withColumn("domain", F.when(F.col("domain").isin(list(counts)), F.col("domain")).otherwise(REST))
        counts[REST] = counts.get(REST, 0) + others
    domains = sorted(counts)
    chosen = None
    for d in domains:
        part = labels.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.string()),
                    "domain": batch.column("domain"),
                    "text_hash": batch.column("text_hash"),
                    "words": pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    "shapes": pa.array([f[1] for f in found], pa.list_(pa.float64())),
                }
            )

    rows = None
    if chosen is not None:
        few = F.broadcast(chosen.distinct())  # at most DOMAINS * sample ids
        found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(few, "doc_id").select("doc_id", "domain", "text_hash", "text")
        found = found.mapInArrow(lean(featured), "doc_id string, domain string, text_hash long, words array<int>, shapes array<double>")
        # one text for each of them, so that repeated ids don't lengthen the sample; only features are shuffled, never texts
        one = F.min_by(F.struct("words", "shapes"), "text_hash").alias("f")
        rows = found.groupBy("doc_id", "domain").agg(one).select("doc_id", "domain", "f.words", "f.shapes").toArrow()
    if rows is None or not rows.num_rows:
        return DomainModel(["all"], np.zeros((1, BUCKETS)), np.zeros((1, SHAPES)))
    rows = rows.sort_by([("doc_id", "ascending"), ("domain", "ascending")])
    y = np.array([domains.index(d) for d in rows["domain"].to_pylist()])
    lists = rows["words"].combine_chunks()
    owner, word = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()
    shape = np.array(rows["shapes"].to_pylist())
    return DomainModel(domains, *_descend(y, owner, word, shape, len(domains), np.array([counts[d] for d in domains], np.float64)))


def _telling(y, owner, word, k: int) -> np.ndarray:
    """Which word buckets set some domain's rows apart from the others'; all other words are left to chance."""
    rows = np.bincount(y, minlength=k)[:, None].astype(np.float64)
    within = np.stack([np.bincount(word[y[owner] == d], minlength=BUCKETS) for d in range(k)])
    total = within.sum(axis=0)
    inside, outside = (within + 0.5) / (rows + 1), (total - within + 0.5) / (len(y) - rows + 1)
    share = np.clip(total / len(y), 1e-9, 1 - 1e-9)
    error = np.sqrt(share * (1 - share) * (1 / np.maximum(rows, 1) + 1 / np.maximum(len(y) - rows, 1)))
    return (total >= LEAST) & ((np.abs(inside - outside) / error).max(axis=0) >= ASSOCIATED)


def _descend(y, owner, word, shape, k: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent with steps scaled to how often each feature occurs."""
    n = len(y)
    # a row's weight makes the sample's domains as common as they are among all labels
    weight = (counts / counts.sum())[y] / np.bincount(y, minlength=k)[y]
    chosen = _telling(y, owner, word, k)[word]
    owner = owner[chosen]
    used, word = np.unique(word[chosen], return_inverse=True)
    words, shapes = np.zeros((k, len(used))), np.zeros((k, shape.shape[1]))
    target = np.eye(k)[y]
    often = np.bincount(word, weights=weight[owner], minlength=len(used)) + 10.0 / n
    for _ in range(STEPS):
        logits = np.stack([np.bincount(owner, weights=words[d][word], minlength=n) for d in range(k)], axis=1) + shape @ shapes.T
        error = (_softmax(logits) - target) * weight[:, None]
        for d in range(k):
            gradient = np.bincount(word, weights=error[owner, d], minlength=len(used))
            words[d] -= RATE * (gradient / (often**0.5) + DECAY * words[d])
        shapes -= RATE * 4 * (error.T @ shape)
    full = np.zeros((k, BUCKETS))
    full[:, used] = words
    return full, shapes


def _posteriors(batches: Iterator[pa.RecordBatch], model, keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    m = model.value
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = batch.column(text).to_pylist()
            tokens = [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
            p = [np.rint(m.posterior(t) * MILLION).astype(np.int64) for t in texts]
            out = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(out | {"n_tokens": pa.array(tokens, pa.int64()), "membership": pa.array(p, pa.list_(pa.int64()))})


def memberships(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_tokens and membership, the posterior in millionths."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    text = "text" if "text" in keep else "__text"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col("text").alias(text)] * ("text" not in keep))
    return rows.mapInArrow(lean(lambda it: _posteriors(it, model, keep, text)), ", ".join([*fields, "n_tokens long, membership array<long>"]))


def rate_column(steps: list[np.ndarray]) -> Column:
    """A document's rate after these steps: from 1 on, each subtracts posterior . step and cuts at 0."""
    rate = F.lit(1.0)
    if steps:
        table = F.array(*[F.array(*[F.lit(float(x) / MILLION) for x in s]) for s in steps])
        moved = lambda s: F.aggregate(F.zip_with("membership", s, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
        rate = F.aggregate(table, rate, lambda r, s: F.greatest(F.lit(0.0), r - moved(s)))
    return F.round(rate, 6)


class Steps(list):
    """The steps of a fit; residual is what is left of the largest gap to a target, as a share of all tokens."""

    residual: float = 0.0


def fit_rates(rows: DataFrame, domains: list[str], shares: dict[str, float]) -> Steps:
    """The steps of projected gradient least squares over rows (n_tokens, membership).

    Each document's step is its gradient divided by its tokens, in the metric of the second moments of
    the documents whose rate is not 0, so that a step of length 1 would meet the targets if none were cut at 0. A
    step that doesn't lessen the residual is taken back and halved. Domains that shares don't name share what is left of
    1 as they do now. The fit ends at a residual of TOLERANCE, or where it is stationary: RECENT steps gain less
    than GAIN of the cost, or none gains however short. Targets that no rates can meet end there, and the
    residual tells how far from them.
    """
    k = len(domains)
    p = [F.element_at("membership", i + 1) / MILLION for i in range(k)]

    def state(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of the domains, and the second moments of the documents that still have a rate."""
        rate, n = F.col("rate"), F.col("n_tokens")
        active = F.when(rate > 0, n).otherwise(0)
        sums = [F.sum(rate * n * x).alias(f"t{i}") for i, x in enumerate(p)]
        sums += [F.sum(active * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        row = rows.withColumn("rate", rate_column(steps)).agg(*sums).first()
        second = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([row[f"t{i}"] or 0.0 for i in range(k)]), second

    mass, second = state([])
    total = mass.sum()
    steps = Steps()
    if total <= 0:
        return steps
    named = {d: max(0.0, shares[d]) for d in domains if d in shares}
    left, others = max(0.0, 1 - sum(named.values())), sum(mass[i] for i, d in enumerate(domains) if d not in named)
    target = np.array([named[d] if d in named else left * mass[i] / others if others else 0.0 for i, d in enumerate(domains)])
    if not target.sum():
        return steps
    target *= total / target.sum()
    metric, length = np.linalg.pinv(second, rcond=1e-9), 1.0
    cost = lambda m: float((m - target) @ metric @ (m - target))
    costs = [cost(mass)]
    while np.abs(mass - target).max() > TOLERANCE * total and length >= SHORTEST:
        if len(costs) > RECENT and costs[-1] > (1 - GAIN) * costs[-1 - RECENT]:
            break
        step = length * (np.linalg.pinv(second, rcond=1e-6) @ (mass - target))
        new_mass, new_second = state([*steps, step])
        if cost(new_mass) < cost(mass):
            steps.append(step)
            costs.append(cost(new_mass))
            mass, second, length = new_mass, new_second, min(1.0, 2 * length)
        else:
            length /= 2
    steps.residual = float(np.abs(mass - target).max() / total)
    return steps


def mixing(docs: DataFrame, labels: DataFrame, shares: dict[str, float], sample: int = SAMPLE) -> tuple[DataFrame, list[str], Steps]:
    """(doc_id, text_hash, n_tokens, membership, rate, copies), domains, steps.

    docs has doc_id and text, labels doc_id and domain; shares are the domains' target shares of all
    tokens, which total as many as now. A document's copies are its rate, rounded up or down by a fixed hash of
    its id and text, so that their expectation is the rate. Null and empty texts have no tokens
    and a membership like any; repeated rows are documents each and get the same rate. Labels
    of unknown documents don't matter; a document with several labels is learnt with each. Without labels or tokens
    all rates are 1. An empty table gives an empty result; other columns are ignored.
    """
    model = fit_domains(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = staged(memberships(keyed, shared, ["doc_id", "text_hash"]), "memberships")
    steps = fit_rates(rows, model.domains, shares)
    return with_copies(rows, steps), model.domains, steps


def with_copies(rows: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """rows (doc_id, text_hash, membership, ...) with rate and copies."""
    chance = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("copies")), F.lit(MILLION)) / MILLION
    return rows.withColumn("rate", rate_column(steps)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mixed_documents(docs: DataFrame, labels: DataFrame, shares: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """docs with each row as often as its copies say; nothing but the rates is fitted beforehand."""
    plain, restore = set_aside(docs, ["doc_id", "text"])
    model = fit_domains(plain, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = plain.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = staged(memberships(keyed, shared, ["doc_id", "text_hash"]), "memberships")
    steps = fit_rates(rows, model.domains, shares)
    again = with_copies(memberships(keyed, shared, keyed.columns), steps).where("copies > 0")
    return restore(again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
