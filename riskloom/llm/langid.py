"""Language identification by Bayesian evidence fusion.

For each row, log P(language | evidence) is, up to a constant, the sum of
- the text's likelihood under hashed character trigrams, tempered because neighbouring trigrams aren't independent,
- log P(declared markup language | language), from counts over all rows with additive smoothing,
- log P(address suffix | language), likewise,
- log P(language | host), smoothed towards the host's parent domain, and that towards the whole table, without the row's own verdict.
Counts take the text's own verdict as the language, by grouped aggregation over all rows. Only the trigram model is fitted on
a bounded sample: LABELLED rows of each language with the least hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, mix, raw_strings, written

#: Labelled rows of each language that the trigram model is fitted on, and languages at most (those with most rows).
LABELLED, MAX_LANGUAGES = 400, 64
BUCKETS, TEMPER, MOST_GRAMS, SMOOTH, STRENGTH = 1 << 15, 0.25, 400, 1.0, 20.0
#: Rows are rejected under this probability, or without a letter.
LEAST_POSTERIOR = 0.5
#: Hosts, domains and suffixes that are broadcast at most (under 100 bytes each); beyond that Spark joins by a shuffle.
MAX_BROADCAST_KEYS = 100_000
#: Rejected rows whose hashes are broadcast, at most 16 MB; beyond that documents are shuffled.
MAX_BROADCAST_REJECTED = 1_000_000
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_KEYS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each trigram of bytes with a letter; what is no letter counts as a blank. Texts are in lower case."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _LETTERS[data].astype(np.uint32)
    blank = x == 0x20
    h = x[:-2] * _KEYS[0] + x[1:-1] * _KEYS[1] + x[2:] * _KEYS[2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ok = ~(blank[:-2] & blank[1:-1] | blank[1:-1] & blank[2:])
    for back in (1, 2):  # not across texts
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    return doc[ok], (h[ok] >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """log P(bucket | language), languages in order of their rows."""

    languages: tuple[str, ...]
    table: np.ndarray

    def means(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean log likelihood of each text's trigrams for each language, and the number of trigrams."""
        doc, bucket = trigrams(data, offsets)
        n = np.bincount(doc, minlength=len(offsets) - 1)
        sums = np.stack([np.bincount(doc, weights=self.table[bucket, i], minlength=len(offsets) - 1) for i in range(len(self.languages))], axis=1)
        return sums / np.maximum(n, 1)[:, None], n


def fit_text_model(labelled: DataFrame, per_language: int = LABELLED, most: int = MAX_LANGUAGES) -> TextModel:
    """Fits trigram counts on labelled (id, text, lang): per_language rows of each of the most frequent languages."""
    lang = F.lower(F.substring_index(F.trim("lang"), "-", 1)).alias("lang")
    keys = labelled.where("lang is not null and trim(lang) <> '' and text is not null").select("id", lang)
    rows = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    languages = tuple(r["lang"] for r in rows)
    if not languages:
        raise ValueError("no labelled rows")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = keys.where(F.col("lang").isin(*languages)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("id", F.col("lang").alias("label"))
    sample = labelled.join(F.broadcast(chosen), "id").select("label", F.lower("text").alias("text"))  # most * per_language ids
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            label = np.array([number[x] for x in batch.column("label").to_pylist()], np.int64)
            for lo, hi in blocks(offsets):
                doc, bucket = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total += np.bincount(label[lo:hi][doc] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), 0.1)
    for r in counts.toLocalIterator():  # BUCKETS rows for each language at most
        table[r["bucket"], r["lang"]] += r["n"]
    return TextModel(languages, np.log(table / table.sum(axis=0)))


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """key columns, declared, suffix, domain, host, and text evidence of rows (key struct, text, declared, host)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("n_grams", pa.int64()), ("means", pa.list_(pa.float64()))])
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, width = sent.value, len(sent.value.languages)
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                means, n = model.means(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * width, pa.int32()), pa.array(means.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(n, pa.int64()), lists], names=[*kept, "n_grams", "means"])

    assert schema.names == ["n_grams", "means"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.select(*kept, F.lower("text").alias("text")).mapInArrow(run, f"{types}, n_grams bigint, means array<double>")


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = written(table, "langid-" + key)
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST_KEYS else table, key, "left")


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Fuses the evidence on rows (key columns, text, declared, host): see fused columns at the end.

    Null or empty text, and text without letters, has no language (und) and is rejected; null declarations, and hosts that are
    null or empty, are evidence of their own kind. Ties go to the language with more rows. Rows that repeat are judged each; texts are read whole, however long.
    An empty table gives no rows. Adds lang, posterior, text_lang, n_grams and rejected.
    """
    names, width = model.languages, len(model.languages)
    keys = [c for c in rows.columns if c not in ("text", "declared", "host")]
    said = F.lower(F.substring_index(F.trim(F.coalesce("declared", F.lit(""))), "-", 1))
    host = F.lower(F.coalesce("host", F.lit("")))
    parts = F.split(host, r"\.")
    rows = rows.withColumn("declared", F.when(said.isin(*names), said).when(said == "", "none").otherwise("other")).withColumn("host", host)
    found = evidence(rows, model)
    text = [F.col("means")[i] * F.least("n_grams", F.lit(MOST_GRAMS)) * TEMPER for i in range(width)]
    top = F.greatest(*text, F.lit(-1e300))
    verdict = F.when(F.col("n_grams") == 0, F.lit(None)).otherwise(F.coalesce(*(F.when(t == top, F.lit(i)) for i, t in enumerate(text))))
    found = found.withColumn("verdict", verdict.cast("int"))
    found = found.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")).withColumn("domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(host))
    found = written(found, "evidence")
    seen = found.where("verdict is not null")
    count = lambda i: F.sum((F.col("verdict") == i).cast("long"))
    total = seen.agg(*(F.coalesce(count(i), F.lit(0)).alias(f"t{i}") for i in range(width))).first()
    rows_of = [total[f"t{i}"] for i in range(width)]
    whole = sum(rows_of)
    prior = [(r + SMOOTH) / (whole + SMOOTH * width) for r in rows_of]

    def likelihood(column: str, kinds: int, tag: str) -> DataFrame:
        """log P(value | language) of each value of column, additively smoothed."""
        return seen.groupBy(column).agg(*(F.log((count(i) + SMOOTH) / F.lit(float(rows_of[i] + SMOOTH * kinds))).alias(f"{tag}{i}") for i in range(width)))

    suffixes = max(2, seen.select("suffix").distinct().count() + 1)
    by_domain = seen.groupBy("domain").agg(F.count("*").alias("nd"), *(count(i).alias(f"c{i}") for i in range(width)))
    by_host = seen.groupBy("host", "domain").agg(F.count("*").alias("nh"), *(count(i).alias(f"h{i}") for i in range(width)))
    by_host = _joined(by_host, by_domain, "domain").drop("domain")
    out = _joined(_joined(_joined(found, likelihood("declared", width + 2, "d"), "declared"), likelihood("suffix", suffixes, "s"), "suffix"), by_host, "host")

    def host_prior(i: int) -> Column:
        """log P(language | host) by the other rows of the host and its domain: a row's own verdict is no evidence for it."""
        own, one = F.coalesce((F.col("verdict") == i).cast("int"), F.lit(0)), F.col("verdict").isNotNull().cast("int")
        domain = (F.col(f"c{i}") - own + STRENGTH * prior[i]) / (F.col("nd") - one + STRENGTH)
        return F.log((F.col(f"h{i}") - own + STRENGTH * domain) / (F.col("nh") - one + STRENGTH))

    score = [
        text[i] + F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.coalesce(host_prior(i), F.lit(float(np.log(prior[i]))))
        for i in range(width)
    ]
    out = out.withColumns({f"score{i}": s for i, s in enumerate(score)})
    best = F.greatest(*(F.col(f"score{i}") for i in range(width)), F.lit(-1e300))
    share = F.lit(1.0) / sum((F.exp(F.col(f"score{i}") - best) for i in range(width)), F.lit(0.0))
    lang = F.coalesce(*(F.when(F.col(f"score{i}") == best, F.lit(x)) for i, x in enumerate(names)))
    none = F.col("n_grams") == 0
    out = out.withColumn("posterior", F.when(none, F.lit(0.0)).otherwise(share))
    rejected = F.col("posterior") < LEAST_POSTERIOR
    text_lang = F.coalesce(F.element_at(F.array(*map(F.lit, names)), F.col("verdict") + 1), F.lit(UNKNOWN))
    return out.select(*keys, F.when(rejected, UNKNOWN).otherwise(lang).alias("lang"), "posterior", text_lang.alias("text_lang"), "n_grams", rejected.alias("rejected"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows to identify: their lang column is what they declare, their source the host."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: page_id, their main text, the lang attribute of the markup, the host of the address."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("declared", pa.string()), ("host", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from .htmltree import host_of, main_text

        markup = re.compile(r"""<(?:html|body)\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
        for batch in batches:
            _, offsets = raw_strings(batch.column("html"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                pages = [x or "" for x in b.column("html").to_pylist()]
                said = [m[1] if (m := markup.search(x)) else None for x in pages]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(map(main_text, pages), pa.string()), pa.array(said, pa.string()), pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string())], schema=schema)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string, declared string, host string")


def labelled_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def accepted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) without the rejected ones. The model is fitted on a bounded sample of docs' own labels."""
    try:
        model = fit_text_model(labelled_documents(docs))
    except ValueError:
        return docs.limit(0)  # nothing declares a language, so nothing can be learnt or kept
    row, name = F.xxhash64("doc_id", "text", "lang", "source"), "_row"  # rows alike in all of these get one verdict
    while name in docs.columns:
        name += "_"
    rows = docs.select(row.alias(name), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
    bad = written(identify(rows, model).where("rejected").select(name).distinct(), "langid-rejected")
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_REJECTED else bad
    return docs.join(bad, row == F.col(name), "left_anti").select(*docs.columns)
