"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of

* the text's likelihood: a multinomial over hashed byte trigrams of the lower-cased letters, fitted on a
  bounded sample of labelled texts (`train_docs`, the only bounded step);
* the likelihoods of the declared language and of the address suffix, given the language; and
* the host's prior, smoothed towards the prior of its domain, which is smoothed towards that of all rows.

One class more stands for every language without labels: an even mixture of all fitted languages and of trigrams
drawn at random. A text of a fitted language is more probable under that language than under the mixture by up to
2 × the number of languages a trigram; letters of any other language, script or none are less probable. Texts in
several fitted languages are kept: the class must win against the best language of every BLOCK bytes. A text of
the class has an unknown language.

The declared language, suffix and host come from counts over all rows: (value, language that the text alone suggests), by grouped
aggregation; the class of unknown languages is one of them. The tables of hosts, domains, suffixes and declarations grow with the data: each is broadcast up
to a checked number of rows, so that a host or language with most of the rows stays spread, and joined by
sort-merge beyond, where Spark splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.texts import flat, limited_broadcast, text_slices
from packetloom.settings import settle

TRAIN_DOCS = 20_000
CODES = 1 << 16
#: Neighbouring trigrams overlap, so each counts as a third of a letter's evidence.
TEMPER = 1 / 3
SMOOTH_HOST, SMOOTH_VALUE = 8.0, 1.0
LEAST_LETTERS, LEAST_POSTERIOR = 4, 0.6
#: Bytes of a text that may be in a language of their own.
BLOCK = 128
# Letters in lower case, everything else one blank.
SHAPE = np.full(256, 0x20, np.uint8)
SHAPE[0x61:0x7B] = np.arange(0x61, 0x7B)
SHAPE[0x41:0x5B] = np.arange(0x61, 0x7B)
SHAPE[0x80:] = np.arange(0x80, 0x100)


def trigram_codes(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte a 16-bit code of it and its two neighbours, and whether it is a letter of a text.

    Outside its text, and for all but letters, a neighbour is blank.
    """
    shaped = np.full(len(buffer) + 2, 0x20, np.uint32)
    shaped[1:-1] = SHAPE[buffer]
    shaped[starts[1:]] = 0x20
    whole = (shaped[:-2] << np.uint32(16)) | (shaped[1:-1] << np.uint32(8)) | shaped[2:]
    return ((whole * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), shaped[1:-1] != 0x20


class TextModel:
    """Log-likelihoods of trigram codes, one table per language, and one of the class of unknown languages.

    A language keeps only the codes it was fitted on, so the model's size is bounded by the sample, not by
    the number of languages.
    """

    def __init__(self, languages: list[str], counts: Iterable[np.ndarray], smooth: float = 0.5):
        self.languages = languages
        self.seen: list[tuple[np.ndarray, np.ndarray, np.float32]] = []
        pooled = np.zeros(CODES)
        for row in counts:
            shares = (row + smooth) / (row.sum() + smooth * CODES)
            pooled += shares / len(languages)
            codes = np.flatnonzero(row)
            self.seen.append((codes.astype(np.uint16), np.log(shares[codes]).astype(np.float32),
                              np.float32(np.log(smooth / (row.sum() + smooth * CODES)))))
        self.unknown = np.log(0.5 * (pooled if languages else 1 / CODES) + np.full(CODES, 0.5 / CODES)).astype(np.float32)

    def tables(self) -> Iterator[np.ndarray]:
        for codes, values, other in self.seen:
            table = np.full(CODES, other, np.float32)
            table[codes] = values
            yield table
        yield self.unknown

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text its tempered log-likelihoods, the class of unknown languages last, and how many letters it has
        (bytes that are letters). What the best languages of the blocks gain over the best one of the whole text is
        taken from the class, so that both are compared with the same cut."""
        buffer, starts = flat(column)
        codes, good = trigram_codes(buffer, starts)
        letters = np.append(0, np.cumsum(good))
        blocks = np.maximum(1, -(-(starts[1:] - starts[:-1]) // BLOCK))
        first = np.append(0, np.cumsum(blocks))
        cuts = np.append(np.repeat(starts[:-1] - first[:-1] * BLOCK, blocks) + np.arange(first[-1]) * BLOCK, starts[-1])
        out = np.zeros((len(starts) - 1, len(self.languages) + 1))
        best = np.full(first[-1], -np.inf)
        for k, table in enumerate(self.tables()):
            total = np.append(0.0, np.cumsum(np.where(good, table[codes], 0.0), dtype=np.float64))
            out[:, k] = (total[starts[1:]] - total[starts[:-1]]) * TEMPER
            if k < len(self.languages):
                np.maximum(best, np.diff(total[cuts]), out=best)
        if self.languages and len(out):
            out[:, -1] -= np.add.reduceat(best, first[:-1]) * TEMPER - out[:, :-1].max(axis=1)
        return out, letters[starts[1:]] - letters[starts[:-1]]


def primary(tag: Column) -> Column:
    """The primary language of a tag such as `en-US`, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(tag.cast("string"), r"^([^-_]*)", 1))), F.lit(""))


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Broadcast:
    """A text model from (text, language), on a sample by hash of about `train_docs` distinct texts with a language.

    Labels count as their primary language; a repeated text counts once for each of its languages.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), primary(F.col("language")).alias("language")
                           ).where("text IS NOT NULL AND language IS NOT NULL")
    texts = rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    every = max(1, texts // train_docs)
    languages = [r.language for r in rows.select("language").distinct().orderBy("language").collect()]
    number = {name: k for k, name in enumerate(languages)}

    def packed(k: int, counts: np.ndarray) -> dict:
        codes = np.flatnonzero(counts)
        return {"k": [k], "codes": [codes.astype(np.uint16).tobytes()], "counts": [counts[codes].astype(np.int64).tobytes()]}

    def opened(codes: bytes, counts: bytes) -> np.ndarray:
        out = np.zeros(CODES, np.int64)
        out[np.frombuffer(codes, np.uint16)] = np.frombuffer(counts, np.int64)
        return out

    schema = pa.schema([("k", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(0)):
                part = batch.slice(first, last - first)
                of = np.array([number[x] for x in part.column(1).to_pylist()], np.int64)
                for k in np.unique(of).tolist():
                    codes, good = trigram_codes(*flat(part.column(0).filter(pa.array(of == k))))
                    yield pa.RecordBatch.from_pydict(packed(k, np.bincount(codes[good], minlength=CODES)), schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CODES, np.int64)
        for codes, counts in zip(table["codes"].to_pylist(), table["counts"].to_pylist()):
            total += opened(codes, counts)
        return pa.table(packed(table["k"][0].as_py(), total), schema)

    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    fields = "k int, codes binary, counts binary"
    found = {r.k: (r.codes, r.counts) for r in chosen.mapInArrow(count, fields).groupBy("k").applyInArrow(add, fields).collect()}
    counts = (opened(*found.get(k, (b"", b""))) for k in range(len(languages)))
    return labelled.sparkSession.sparkContext.broadcast(TextModel(languages, counts))


def host_of(address: Column) -> Column:
    """The host of an address, lower-cased: what stands behind any scheme and user, without the port."""
    return F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host of one label has none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def declared_in(html: Column) -> Column:
    """The primary language that a page's html element declares, lower-cased; null if none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles taken out of a page; entities become blanks."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"&[#A-Za-z0-9]+;", " ")


def identify(rows: DataFrame, model: Broadcast) -> DataFrame:
    """The language of `rows` (id, text, declared, address), one row per row.

    `language` is the most probable one, null if that is the class of unknown languages, `posterior` its
    probability, `text_language` what the text alone suggests, `kept` whether the language is known: at least LEAST_LETTERS letters (bytes of letters) and a
    posterior of LEAST_POSTERIOR. Any column may be null: a missing text has no letters, other missing
    evidence says nothing. A repeated or null id is a row of its own; an empty table gives no rows; without
    languages in the model nothing is kept. Ties go to the first language by name.
    """
    languages = model.value.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                scores, letters = model.value.score(part.column(1))
                best = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(scores), pa.list_(pa.float64())),
                     pa.array(np.where(letters >= LEAST_LETTERS, best, -1).astype(np.int32)),
                     pa.array(letters.astype(np.int64)), part.column(2), part.column(3)],
                    ["id", "scores", "best", "letters", "declared", "host"])

    picked = rows.select("id", F.col("text").cast("string").alias("text"),
                         primary(F.col("declared")).alias("declared"),
                         host_of(F.col("address").cast("string")).alias("host"))
    id_type = rows.schema["id"].dataType.simpleString()
    scored = settle(picked.mapInArrow(run, f"id {id_type}, scores array<double>, best int, letters long, "
                                           "declared string, host string"), "scores")
    scored = scored.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    if not languages:
        return scored.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                             F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
    cells = settle(scored.where("best >= 0").groupBy("host", "domain", "suffix", "declared", "best").agg(
        F.count(F.lit(1)).alias("n")), "evidence")
    spread = range(len(languages) + 1)

    def counts(key: str) -> DataFrame:
        return cells.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.array(*[
            F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).cast("double") for k in spread]).alias("counts"))

    whole = {r.best: r.n for r in cells.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    total = [float(whole.get(k, 0)) for k in spread]
    shares = [(n + 1) / (sum(total) + len(total)) for n in total]
    everywhere = F.array(*map(F.lit, shares))

    def smoothed(own: Column, parent: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, n: a + n)
        return F.zip_with(own, parent, lambda n, p: (n + SMOOTH_HOST * p) / (size + SMOOTH_HOST))

    domains = counts("domain").select(F.col("domain").alias("domain"), smoothed(F.col("counts"), everywhere).alias("domain_prior"))
    hosts = (counts("host").withColumn("domain", domain_of(F.col("host"))).join(domains.hint("merge"), "domain", "left")
             .select("host", smoothed(F.col("counts"), F.coalesce("domain_prior", everywhere)).alias("host_prior")))

    def likelihoods(key: str) -> DataFrame:
        """P(value | language): counts of the value against all of a language, smoothed by the value's share."""
        sized = counts(key).withColumn("size", F.aggregate("counts", F.lit(0.0), lambda a, n: a + n))
        return sized.select(key, F.zip_with("counts", F.array(*map(F.lit, total)), lambda n, t: F.log(
            (n + SMOOTH_VALUE * F.col("size") / max(1.0, sum(total))) / (t + SMOOTH_VALUE))).alias(f"{key}_likelihood"))

    joined = scored
    for side, key in ((hosts, "host"), (likelihoods("declared"), "declared"), (likelihoods("suffix"), "suffix")):
        joined = joined.join(limited_broadcast(side), key, "left")
    nothing = F.array(*[F.lit(0.0) for _ in spread])
    logs = F.transform(F.coalesce("host_prior", everywhere), lambda p: F.log(p))
    for part in (F.col("scores"), F.coalesce("declared_likelihood", nothing), F.coalesce("suffix_likelihood", nothing)):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    ranked = joined.select("id", "best", "letters", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    names = F.array(*map(F.lit, languages), F.lit(None).cast("string"))
    chosen = ranked.select(
        "id", "letters", F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int")).alias("language"),
        (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("posterior"),
        F.when(F.col("best") >= 0, F.get(names, F.col("best"))).alias("text_language"))
    return chosen.select("id", "language", "posterior", "text_language", (
        F.col("language").isNotNull() & (F.col("letters") >= LEAST_LETTERS) & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"))


def document_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, key: str = "doc_id") -> DataFrame:
    """Languages of documents (text, lang, source): `lang` is what a document declares and the label of the
    sample, `source` its address. One row per document, under the name of its key column."""
    model = fit(docs.select("text", F.col("lang").alias("language")), train_docs)
    rows = docs.select(F.col(key).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("address"))
    return identify(rows, model).withColumnRenamed("id", key)


def page_languages(pages: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Languages of pages (page_id, url, html) with a text model of labelled documents (text, lang)."""
    model = fit(labelled.select("text", F.col("lang").alias("language")), train_docs)
    html = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").alias("id"), visible_text(html).alias("text"),
                        declared_in(html).alias("declared"), F.col("url").alias("address"))
    return identify(rows, model).withColumnRenamed("id", "page_id")


def with_known_language(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents whose language is known, all columns kept. Rows with equal evidence share a verdict."""
    key = next(n for n in map("key_{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    evidence = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "lang", "source")]
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws("\0\0", *evidence).cast("binary"))))
    told = settle(document_languages(keyed, train_docs, key).where("NOT kept").select(key).distinct(), "unknown")
    return keyed.join(limited_broadcast(told), key, "left_anti").drop(key)
