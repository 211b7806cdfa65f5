"""Quality rules: a learned decision list over text statistics, emitted as Spark conditionals.

Sequential covering on labelled statistics: a rule, a conjunction of thresholds, is grown test by
test for information gain on a growing set, pruned backwards on a pruning set, and kept while it is
precise there; the rows that it covers leave and the next rule is grown. The list becomes one ordered
`F.when(...).when(...).otherwise(...)` expression, so verdicts are plain Catalyst.

Training takes at most `SAMPLE` labelled rows, those with the smallest hashes of their ids.

Rows: null and empty texts have zeros and fail the base rule; null labels or ids are not trained on;
without labelled rows, or with one class only, the list is empty and keeps what the base rule keeps;
repeated rows each get a row. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, narrow_to, sliced, table, texts_of

#: Most labelled rows that the rules are learned from.
SAMPLE = 20_000
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_long long, n_alpha long"
#: Statistics as ratios, which the rules may test.
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "long_ratio", "alpha_ratio", "n_words", "words_per_line")
_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_NOT_LEAD = bytes(range(0x80, 0xC0))  # bytes that continue a code point
_NOT_ALPHA = bytes(b for b in range(128) if not chr(b).isalpha()) + _NOT_LEAD


def covered_by(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `width` words at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def statistics_of(text: bytes) -> tuple:
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = hash_words(words)
    grams = gram_hashes(h, 5)
    repeat = 0
    if len(grams):
        _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[where] > 1)
        repeat = int(covered_by(again, 5, len(words)).sum()) if len(again) else 0
    return (
        len(words),
        len(joined.translate(None, _NOT_LEAD)),
        len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(np.unique(h)),
        sum(len(w) > 15 for w in words),
        len(joined.translate(None, _NOT_ALPHA)),
    )


def _statistics(batches):
    for batch in sliced(batches):
        rows = [statistics_of(t) for t in texts_of(batch)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 9
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in STATS.split(", ")])


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, with the ratios in RATIOS."""
    s = docs.select("doc_id", "text").mapInArrow(_statistics, STATS)
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return s.withColumns({
        "mean_word": over("word_chars", "n_words"), "symbol_ratio": over("n_symbols", "n_words"), "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"), "distinct_ratio": over("n_distinct", "n_words"), "long_ratio": over("n_long", "n_words"),
        "alpha_ratio": over("n_alpha", "word_chars"), "words_per_line": over("n_words", "n_lines"),
    })


@dataclass
class Rule:
    """Rows that pass all tests (feature, '<=' or '>', threshold) are bad."""

    tests: list[tuple[str, str, float]]
    precision: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for name, op, t in self.tests:
            v = x[:, RATIOS.index(name)]
            ok &= v <= t if op == "<=" else v > t
        return ok

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, t in self.tests:
            out = out & ((F.col(name) <= t) if op == "<=" else (F.col(name) > t))
        return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> list[tuple[str, str, float]]:
    tests, ok = [], np.ones(len(x), bool)
    while len(tests) < most and bad[ok].any() and not bad[ok].all():
        p0 = np.log2(bad[ok].mean())
        best = (1e-9, None, None)
        for f, name in enumerate(RATIOS):
            v = x[ok, f]
            for t in np.unique(np.quantile(v, np.linspace(0.01, 0.99, cuts))):
                for op, take in (("<=", v <= t), (">", v > t)):
                    b = bad[ok][take].sum()
                    if b:
                        gain = b * (np.log2(b / take.sum()) - p0)
                        if gain > best[0]:
                            best = (gain, (name, op, float(t)), take)
        if best[1] is None:
            break
        tests.append(best[1])
        ok[np.flatnonzero(ok)[~best[2]]] = False
    return tests


def learn_rules(x: np.ndarray, bad: np.ndarray, rules: int = 12, cuts: int = 24, most: int = 4, precision: float = 0.9, seed: int = 7) -> list[Rule]:
    """Ordered rules for `bad` rows of x (columns RATIOS)."""
    order = np.random.default_rng(seed).permutation(len(x))
    cut = len(order) * 2 // 3
    (gx, gb), (px, pb) = ((x[i], bad[i]) for i in (order[:cut], order[cut:]))
    found: list[Rule] = []
    while len(found) < rules and gb.sum() >= 5 and pb.any():
        tests = _grow(gx, gb, cuts, most)
        if not tests:
            break

        def worth(ts):
            m = Rule(ts, 0).mask(px)
            return (pb[m].sum() - (~pb[m]).sum()) / max(1, m.sum()), pb[m].sum()

        while len(tests) > 1:  # drop the test whose loss helps the pruning set most
            shorter = max((tests[:i] + tests[i + 1 :] for i in range(len(tests))), key=worth)
            if worth(shorter) < worth(tests):
                break
            tests = shorter
        m = Rule(tests, 0).mask(px)
        if m.sum() < 3 or pb[m].mean() < precision:
            break
        rule = Rule(tests, float(pb[m].mean()))
        found.append(rule)
        (gx, gb), (px, pb) = ((a[~rule.mask(a)], b[~rule.mask(a)]) for a, b in ((gx, gb), (px, pb)))
    return found


def as_column(rules: list[Rule]) -> Column:
    """The decision list: the number of the first rule that holds, 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column | None = None, bound: int = SAMPLE) -> DataFrame:
    """At most `bound` labelled rows (doc_id, text, label): those of the smallest id hashes. A label
    that is given twice counts once, at its highest."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marks = marks if keep is None else marks.where(keep)
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    near = narrow_to(docs.select("doc_id", "text"), marks).dropDuplicates(["doc_id"])
    return near.join(marks, "doc_id")


def fit_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    rows = labelled(docs, labels, "quality")
    stats = text_statistics(rows).join(rows.select("doc_id", "_label"), "doc_id").select(*RATIOS, "_label").orderBy("doc_id").toPandas()
    if stats["_label"].nunique() < 2:
        return []
    return learn_rules(stats[list(RATIOS)].to_numpy(float), (stats["_label"] == 0).to_numpy())


def quality_verdicts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    s = text_statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    s = s.withColumn("base_failed", failed).withColumn("rule", as_column(rules))
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_verdicts(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
