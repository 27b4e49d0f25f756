"""Language identification by Bayesian evidence fusion.

Evidence: how likely the text's character trigrams are in each language; the language that the markup
or the table declares; the address suffix; and a prior of the host, which shrinks towards
its domain's and that towards the corpus's. The priors are sums of the text evidence's posteriors
over all rows, by grouped aggregation; they are counted in millionths, so that sums don't depend
on their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.llm.common import lean, mix64, staged

BUCKETS = 1 << 14
#: Labelled rows of each language that the trigram model is fitted on, chosen by a hash of the row.
SAMPLE = 1000
#: Languages that the model tells apart, the commonest labels; all rows of the others are one more, REST.
LANGUAGES, REST = 256, "(rest)"
#: Trigrams of a text that count as independent evidence; longer texts weigh no more.
EFFECTIVE = 60
#: Chance that a declaration or a suffix names the right language.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Pseudo-counts with which a host leans on its domain, and a domain on the corpus.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
#: A row is kept if its best language has at least this posterior.
CONFIDENT = 0.6
MILLION = 1_000_000
#: Hosts whose priors may be broadcast.
BROADCAST_HOSTS = 50_000
#: Country suffixes that point to one language (fixed values).
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "ie": "en", "au": "en"}
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible(html: str | None) -> str:
    """An HTML page's text without scripts, styles, navigation and tags."""
    import html as entities

    return entities.unescape(_HIDDEN.sub(" ", html or ""))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of the lower-case letters, with a space for each run of other characters."""
    letters = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    joined = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return (mix64(joined) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class TextModel:
    """log P(trigram bucket | language), one row for each language."""

    languages: list[str]
    log_likelihood: np.ndarray

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        """Log evidence for each language, and the number of trigrams."""
        found = trigrams(text)
        if not len(found) or not self.languages:
            return np.zeros(len(self.languages)), 0
        counts = np.bincount(found, minlength=BUCKETS).astype(np.float32)
        total = self.log_likelihood @ counts
        return (total / len(found) * min(len(found), EFFECTIVE)).astype(np.float64), len(found)


def normal(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max(initial=-np.inf)) if len(log_p) else log_p
    return p / p.sum() if len(p) else p


def named(declared: Column, languages: list[str]) -> Column:
    """The declared language as the model knows it."""
    return F.when(declared.isin(languages) | declared.isNull(), declared).otherwise(REST) if REST in languages else declared


def fit(rows: DataFrame, sample: int = SAMPLE) -> TextModel:
    """The model from rows (id, text, declared): at most `sample` labelled rows of each language, least hashes first.

    Rows without a declared language are not labelled. Without any, the model has no languages.
    """
    labelled = rows.where(F.col("declared").isNotNull())
    sizes = labelled.groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(LANGUAGES + 1).collect()
    languages = sorted([r[0] for r in sizes[:LANGUAGES]] + [REST] * (len(sizes) > LANGUAGES))
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    labelled = labelled.select("text", named(F.col("declared"), languages).alias("declared"), F.xxhash64("id", "declared").alias("at"))
    first = Window.partitionBy("declared").orderBy("at")
    few = labelled.select("declared", "at").withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    last = few.groupBy(F.col("declared").alias("of")).agg(F.max("at").alias("last"))  # a row for each language

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some), "n": pa.array(total[some])})

    chosen = labelled.join(F.broadcast(last), (F.col("declared") == F.col("of")) & (F.col("at") <= F.col("last"))).select("text", "declared")
    counts = chosen.mapInArrow(lean(counted), "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((len(languages), BUCKETS), 0.5)
    at_ = [languages.index(x) for x in table["lang"].to_pylist()]
    np.add.at(matrix, (at_, table["bucket"].to_numpy()), table["n"].to_numpy())
    return TextModel(languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32))


def address_columns(url: Column) -> tuple[Column, Column]:
    """(host, suffix) of an address, null without one."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return host, F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def declared_in(html: Column) -> Column:
    """The primary language of a page's markup, null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _scored(batches: Iterator[pa.RecordBatch], model, keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    """Each text's log evidence for the languages, the posterior by the text alone in millionths, and its trigrams."""
    m = model.value
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            found = [m.evidence(t) for t in batch.column(text).to_pylist()]
            votes = [np.rint(normal(e) * MILLION).astype(np.int64) if n else np.zeros(len(m.languages), np.int64) for e, n in found]
            out = {c: batch.column(c) for c in keep} | {
                "__evidence": pa.array([f[0] for f in found], pa.list_(pa.float64())),
                "__votes": pa.array(votes, pa.list_(pa.int64())),
                "n_trigrams": pa.array([f[1] for f in found], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out)


def host_priors(votes: DataFrame, k: int) -> DataFrame:
    """host, prior from (host, votes): array of k log priors, hosts smoothed towards their domains and those towards the corpus."""
    sums = [F.sum(F.element_at("votes", i + 1)).alias(f"v{i}") for i in range(k)]
    hosts = staged(votes.groupBy("host").agg(*sums), "hosts").withColumn("domain", _domain(F.col("host")))
    again = [F.sum(f"v{i}").alias(f"v{i}") for i in range(k)]
    corpus = hosts.agg(*[F.coalesce(s, F.lit(0)).alias(f"v{i}") for i, s in enumerate(again)]).first()
    shares = (np.array(corpus, np.float64) + MILLION) / (sum(corpus) + k * MILLION)
    domains = hosts.groupBy("domain").agg(*again)

    def smoothed(weight: float, towards: list[Column]) -> list[Column]:
        total = sum((F.col(f"v{i}") for i in range(k)), F.lit(0)) / MILLION
        return [(F.col(f"v{i}") / MILLION + weight * towards[i]) / (total + weight) for i in range(k)]

    up = F.array(*smoothed(DOMAIN_WEIGHT, [F.lit(float(s)) for s in shares])).alias("up")
    domains = domains.select(F.col("domain").alias("d"), up)
    joined = hosts.join(domains, F.col("domain").eqNullSafe(F.col("d")), "left")
    prior = [F.log(p) for p in smoothed(HOST_WEIGHT, [F.element_at("up", i + 1) for i in range(k)])]
    return joined.select(F.col("host").alias("p_host"), F.array(*prior).alias("prior"))


def fused(
    languages: list[str], log_p: np.ndarray, n: int, declared: str | None, suffix: str | None, prior: list[float] | None
) -> tuple[str | None, float]:
    """(language, posterior) from a text's log evidence and the rest; no language without trigrams or without languages."""
    if not n or not languages:
        return None, 0.0
    k = len(languages)
    if prior is not None:
        log_p = log_p + np.asarray(prior)
    for name, right in ((declared, DECLARED_RIGHT), (SUFFIX_LANGUAGE.get(suffix or ""), SUFFIX_RIGHT)):
        if name in languages and k > 1:
            wrong = np.full(k, np.log((1 - right) / (k - 1)))
            wrong[languages.index(name)] = np.log(right)
            log_p = log_p + wrong
    p = normal(log_p)
    best = int(p.argmax())
    return languages[best], float(p[best])


def _judged(batches: Iterator[pa.RecordBatch], languages: list[str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            columns = [batch.column(c).to_pylist() for c in ("__evidence", "n_trigrams", "__declared", "__suffix", "__prior")]
            found = [fused(languages, np.array(e), *rest) for e, *rest in zip(*columns, strict=True)]
            out = {c: batch.column(c) for c in keep} | {
                "detected": pa.array([f[0] for f in found], pa.string()),
                "confidence": pa.array([round(f[1], 6) for f in found], pa.float64()),
                "n_trigrams": batch.column("n_trigrams"),
                "kept": pa.array([f[0] is not None and f[1] >= CONFIDENT for f in found], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(out)


def identify(
    rows: DataFrame, row_id: Column, text: str, declared: Column, host: Column, suffix: Column, sample: int = SAMPLE, keep_text: bool = True
) -> DataFrame:
    """rows with detected (language), confidence, n_trigrams and kept; text names a column, the other evidence is columns over rows.

    A row without letters has no language, confidence 0, and isn't kept; others are kept from a
    confidence of CONFIDENT on. Any evidence may be null and then says nothing; a null host shares the
    prior of all rows without one. Ties go to the alphabetically first language. Repeated rows are
    judged each; an empty table gives an empty result. Columns of rows that have the name of a new
    column are replaced. Each text is scored once; without keep_text it is left out of the result.
    """
    spark = rows.sparkSession
    fitted = fit(rows.select(row_id.alias("id"), F.col(text).alias("text"), declared.alias("declared")), sample)
    languages, k = fitted.languages, len(fitted.languages)
    model = spark.sparkContext.broadcast(fitted)
    keep = [c for c in rows.columns if c not in ("detected", "confidence", "n_trigrams", "kept") and (keep_text or c != text)]
    evidence = {"__declared": named(declared, languages), "__suffix": suffix, "__host": host}
    asked = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], *[c.alias(n) for n, c in evidence.items()])
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    extra = [f"{c} string" for c in evidence] + ["__evidence array<double>", "__votes array<long>", "n_trigrams long"]
    carried = [*keep, *evidence]
    scored = asked.mapInArrow(lean(lambda it: _scored(it, model, carried, text)), ", ".join([*fields, *extra]))
    scored = staged(scored, "evidence")
    if k:
        priors = staged(host_priors(scored.select(F.col("__host").alias("host"), F.col("__votes").alias("votes")), k), "priors")
        if priors.count() <= BROADCAST_HOSTS:
            priors = F.broadcast(priors)
        scored = scored.join(priors, F.col("__host").eqNullSafe(F.col("p_host")), "left").drop("p_host").withColumnRenamed("prior", "__prior")
    else:
        scored = scored.withColumn("__prior", F.lit(None).cast("array<double>"))
    schema = ", ".join([*fields, "detected string, confidence double, n_trigrams long, kept boolean"])
    return scored.drop("__host", "__votes").mapInArrow(lean(lambda it: _judged(it, languages, keep)), schema)


def identify_documents(docs: DataFrame, sample: int = SAMPLE, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, lang, source) judged: lang is the declared language, and source the host."""
    none = F.lit(None).cast("string")
    return identify(docs, F.col("doc_id"), "text", F.col("lang"), F.col("source"), none, sample, keep_text)


def identify_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pages (page_id, url, html) judged by their visible text, markup and address."""

    @F.pandas_udf("string")
    def text_of(html):
        return html.map(visible, na_action="ignore")

    host, suffix = address_columns(F.col("url"))
    rows = pages.select("page_id", "url", text_of("html").alias("text"), declared_in(F.col("html")).alias("declared"))
    return identify(rows, F.col("page_id"), "text", F.col("declared"), host, suffix, sample, keep_text=False)
