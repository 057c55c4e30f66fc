"""Quality rules as learned decision lists, in DataFrame functions only.

Text statistics are computed for every document and stored. Rules for bad documents are learned from labelled
statistics by sequential covering: a rule grows by the threshold with the best information gain over the
documents it still covers, is pruned on documents held back for that, and is kept if it is precise there;
then the documents it covers are set aside and the next rule grows. Every step is one grouped aggregation over
quantile bins, whose result has as many rows as there are bins. The list is emitted as one ordered
conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.settings import settle

BLANKS = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "word_length", "symbol_share", "bang_share", "upper_share", "digit_share", "dup_line_share",
            "repeat_share", "words_per_line", "bar_share")
BINS = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are sorted by a hash with their position in its lower bits; neighbours of one hash are compared
    word by word; the starts of repeated windows are then added up, three words each without overlap.
    """
    def covered(starts: Column) -> Column:
        following = F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1)))
        gaps = F.zip_with(starts, following, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    def count(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        place = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

        def coded(i: Column) -> Column:
            spread = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", spread, bits).bitwiseOR(i.cast("bigint"))

        def same(a: Column, b: Column) -> Column:
            i, j = a.bitwiseAND(place).cast("int"), b.bitwiseAND(place).cast("int")
            upper = [F.call_function("shiftright", x, bits) for x in (a, b)]
            return ((upper[0] == upper[1]) & (F.get(w, i) == F.get(w, j))
                    & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))
                             | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(place)))

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), coded))
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(let(let(windows, starts), covered))

    return let(words, count)


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document of `docs` (doc_id, text): the base statistics and the features of rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bangs"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count(text, F.lit(r"\|")).cast("long").alias("n_bars"))
    flat = counted.select("doc_id", "w.*", "l.*", "n_symbols", "n_bangs", "n_upper", "n_digits", "n_bars")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_bangs") / words).alias("bang_share"), (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"), (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("n_words") / lines).alias("words_per_line"),
        (F.col("n_bars") / words).alias("bar_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """A threshold on a statistic."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list: false from the first rule that fires, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(fires(rule), F.lit(False)).otherwise(out)
    return out


def _edges(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct quantiles of every feature, at most BINS - 1 each."""
    shares = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, shares).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(found[f] or ())) for f in FEATURES}


def _bins(edges: dict[str, list[float]]) -> Column:
    """For every feature its number and the bin of its value: how many edges the value reaches."""
    return F.array(*[F.struct(F.lit(k).alias("feature"), sum(
        ((F.col(f) >= e).cast("int") for e in edges[f]), F.lit(0)).alias("bin")) for k, f in enumerate(FEATURES)])


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    (p, n), (q, m) = before, after
    return q * (log2(q / (q + m)) - log2(p / (p + n))) if q else 0.0


def _grow(rows: DataFrame, edges: dict[str, list[float]], most: int) -> Rule:
    """Add the best threshold as long as good documents are covered and something is gained."""
    rule: Rule = ()
    while len(rule) < most:
        cells = rows.where(fires(rule)).select("bad", F.explode("bins").alias("cell")).groupBy(
            "cell.feature", "cell.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        if not cells:
            break
        total = (sum(c.p for c in cells if c.feature == 0), sum(c.n for c in cells if c.feature == 0))
        if not total[0] or not total[1]:
            break
        best: tuple[float, Condition] | None = None
        for k, feature in enumerate(FEATURES):
            counts = {c.bin: (c.p, c.n) for c in cells if c.feature == k}
            p = n = 0
            for b, edge in enumerate(edges[feature]):
                p, n = p + counts.get(b, (0, 0))[0], n + counts.get(b, (0, 0))[1]
                for at_least, after in ((False, (p, n)), (True, (total[0] - p, total[1] - n))):
                    gain = _gain(total, after)
                    if gain > (best[0] if best else 1e-9):
                        best = gain, Condition(feature, at_least, float(edge))
        if best is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that does best on the rows held back, with what it covers there."""
    found = rows.agg(*[c for k in range(1, len(rule) + 1) for c in (
        F.sum(F.when(fires(rule[:k]), F.col("bad")).otherwise(0)).alias(f"p{k}"),
        F.sum(F.when(fires(rule[:k]), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}"))]).first()
    worth = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k in range(1, len(rule) + 1)
             for p, n in [(found[f"p{k}"] or 0, found[f"n{k}"] or 0)]]
    _, k, p, n = max(worth)
    return rule[:-k], p, n


def learn(statistics: DataFrame, labels: DataFrame, most_rules: int = 12, most_conditions: int = 4,
          precision: float = 0.95, least_cover: int = 3) -> list[Rule]:
    """A decision list for bad documents (quality 0) from labels (doc_id, quality) joined to statistics.

    All labelled rows count; documents that fail the base rules do not. Two thirds grow rules, a third prunes
    them. Learning ends with a rule that covers too little or is not precise on the held-back third. Null
    labels are left out; without bad documents the list is empty.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
                         ).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = statistics.where(~base_failed()).join(told, "doc_id").withColumn(
        "bad", (F.col("quality") == 0).cast("int"))
    edges = _edges(known)
    rows = settle(known.select(
        "bad", *FEATURES, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), _bins(edges).alias("bins")),
        "labelled")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(verdict(rules))
        grown = _grow(left.where("NOT held"), edges, most_conditions)
        if not grown:
            break
        rule, p, n = _prune(left.where("held"), grown)
        if p < least_cover or p < precision * (p + n):
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document of `docs` (doc_id, text): base statistics, base verdict, and whether it is kept.

    A document is kept if it passes the base rules and no learned rule fires. A null text has no words; a null
    or repeated doc_id is kept as a row of its own; other columns are not looked at; empty tables are allowed.
    """
    stored = settle(statistics(docs), "statistics")
    rules = learn(stored, labels)
    return stored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
