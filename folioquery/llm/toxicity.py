"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and counts of lexicon words and lexicon stems, their nearness to
second-person words, and the rates of capitals, punctuation and obfuscated words. The lexicon is a
short list of insults in four languages together with the words and stems whose presence in the
labelled training rows tells the classes apart. Trees are boosted for logistic loss by histogram splits;
margins of rows that their trees haven't seen calibrate the output (pool adjacent violators), so that
a score is a probability.

Training takes at most `SAMPLE` labelled rows, those with the smallest hashes of their ids; the model
(a lexicon of at most 2 * LEXICON entries and TREES trees) is sent to all tasks.

Rows: null and empty texts have all-zero features and are scored like any other; null labels or ids
are not trained on; without labels of both classes every score is the share of label 1 (0.0 without
any). A row with a null id counts as not held out. Repeated rows each get a row. Extra columns are
not read; labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, stored, table, texts_of
from .quality import SAMPLE, labelled

LEXICON, STEM, TREES, DEPTH, RATE, BINS = 400, 5, 60, 3, 0.2, 32
#: Fixed lists: insults to start from, and second-person words.
SEEDS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb ugly imbecile crétin débile ordure salaud idiota imbécil estúpido basura asqueroso dumm abschaum widerlich".split()
SECOND_PERSON = {w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti usted ustedes".split()}
_STRIP = b".,;:!?\"'()[]{}<>*_~-"
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_PUNCT = bytes(b for b in range(256) if b not in b"!?.,;:")
_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_ODD = re.compile(rb"[a-z][0-9@$!*#]+[a-z]|(.)\1\1")
FEATURES = ("seed_density", "seed_count", "word_density", "word_count", "word_weight", "stem_density", "stem_count", "stem_weight", "top_weight", "near_second_person", "second_person_density", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "log_words")


def fold_words(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


@dataclass
class Lexicon:
    words: dict[bytes, float]
    stems: dict[bytes, float]
    seeds: frozenset


def _presence(batches):
    """Per batch of (text, _label, half): in how many texts, and texts of label 1, each word and stem is."""
    for batch in sliced(batches):
        bad, total = Counter(), Counter()
        for text, label, half in zip(texts_of(batch), batch.column("_label").to_pylist(), batch.column("half").to_pylist(), strict=True):
            words = set(fold_words(text))
            tokens = [(0, w, half) for w in words] + [(1, s, half) for s in {w[:STEM] for w in words if len(w) >= STEM}]
            total.update(tokens)
            if label == 1:
                bad.update(tokens)
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "token", "half", "bad", "total"])


def learn_lexicons(rows: DataFrame, size: int = LEXICON) -> list[Lexicon]:
    """From rows (text, _label, half): lexicons of half 0, of half 1 and of all rows. Each has the
    words and the stems of the highest smoothed log odds of presence, at most `size` of either, that
    stay above 0.7 by 1.6 standard errors."""
    ns = {r["half"]: (r["bad"] or 0, r["n"]) for r in rows.groupBy("half").agg(F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("text", "_label", "half").mapInArrow(_presence, "kind int, token binary, half int, bad long, total long")
    of = lambda c, *halves: F.sum(F.when(F.col("half").isin(*halves), F.col(c)).otherwise(0))
    groups = ((0,), (1,), (0, 1))
    counts = counts.groupBy("kind", "token").agg(*[of(c, *g).alias(f"{c}{i}") for i, g in enumerate(groups) for c in ("bad", "total")]).where("bad2 >= 3")
    counts = stored(counts, "toxic-words")
    found = []
    for i, g in enumerate(groups):
        bad = sum(ns.get(h, (0, 0))[0] for h in g)
        good = sum(ns.get(h, (0, 0))[1] for h in g) - bad
        b, r = F.col(f"bad{i}") + 0.5, F.col(f"total{i}") - F.col(f"bad{i}") + 0.5
        odds = F.log(b / (bad + 1)) - F.log(r / (good + 1))
        sure = counts.where((F.col(f"bad{i}") >= max(3, int(0.002 * bad))) & (odds - 1.6 * F.sqrt(1 / b + 1 / r) > 0.7)).select("kind", "token", odds.alias("odds"))
        both = []
        for kind in (0, 1):
            both.append({bytes(x["token"]): x["odds"] for x in sure.where(F.col("kind") == kind).orderBy(F.desc("odds"), "token").limit(size).collect()})
        found.append(Lexicon(*both, frozenset(s.encode() for s in SEEDS)))
    return found


def features_of(text: bytes, lex: Lexicon) -> list[float]:
    words = fold_words(text)
    n = len(words)
    seed, weight, stem_weight, top, stems, odd, near = 0, 0.0, 0.0, 0.0, 0, 0, 0.0
    hits, second = [], []
    get_word, get_stem = lex.words.get, lex.stems.get
    for i, w in enumerate(words):
        v = get_word(w, 0.0)
        s = get_stem(w[:STEM], 0.0)
        is_seed = w in lex.seeds
        if not w.isalpha() and w.isascii() and _ODD.search(w):
            odd += 1
            plain = w.translate(_LEET).replace(b"*", b"")
            v, s, is_seed = v or get_word(plain, 0.0), s or get_stem(plain[:STEM], 0.0), is_seed or plain in lex.seeds
        if v or s or is_seed:
            seed += is_seed
            weight += v
            stem_weight += s
            stems += s > 0
            top = max(top, v, s)
            hits.append((i, v > 0 or is_seed))
        if w in SECOND_PERSON:
            second.append(i)
    if hits and second:
        at, there = np.array([h[0] for h in hits]), np.array(second)
        after = np.searchsorted(there, at)  # the nearest is the one there or the one before
        gaps = np.minimum(np.abs(at - there[np.maximum(after - 1, 0)]), np.abs(at - there[np.minimum(after, len(there) - 1)]))
        near = float((1.0 / (1.0 + gaps)).max())
    d, size = max(1, n), max(1, len(text))
    found = sum(h[1] for h in hits)
    caps = len(text.translate(None, _UPPER))
    return [
        seed / d, seed, found / d, found, weight / d, stems / d, stems, stem_weight / d, top, near, len(second) / d,
        caps / size, sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / d, len(text.translate(None, _PUNCT)) / size,
        text.count(b"!") / size, odd / d, float(np.log1p(n)),
    ]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
    """(start, [(features, thresholds, leaves)]): complete trees, a row goes right where x > threshold.
    Newton leaves for logistic loss, splits from gradient histograms."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    out, raw = [], np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feats, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * (bins + 1) + binned[:, f]
                gs = np.bincount(key, g, count * (bins + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(key, h, count * (bins + 1)).reshape(count, -1).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain = np.where((hs > 0.5) & (ha - hs > 0.5), gain, 0)[:, : len(e)]
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), at] > best + 1e-9):
                    best[k] = gain[k, at[k]]
                    feats[first + k], cuts[first + k] = f, e[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feats[node]] > cuts[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        raw += value[leaf]
        out.append((feats, cuts, value))
    return start, out


def margins(x: np.ndarray, model) -> np.ndarray:
    start, trees = model
    raw = np.full(len(x), start)
    for feats, cuts, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(value)))):
            node = 2 * node + 1 + (x[np.arange(len(x)), feats[node]] > cuts[node])
        raw += value[node - (len(value) - 1)]
    return raw


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), to be interpolated; each pool is drawn
    towards 1/2 by one row's weight, so no score is exactly 0 or 1."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of margins
    for r, t in zip(raw[order], y[order], strict=True):
        pools.append([1.0, float(t), float(r)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            w, s, m = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + m]
    return np.array([m / w for w, _, m in pools]), np.array([(s + 0.5) / (w + 1) for w, s, _ in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: tuple
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        raw = margins(np.array([features_of(t, self.lexicon) for t in texts]), self.trees)
        at, p = self.knots
        # a small share of the margin itself keeps the order inside a pool
        return np.clip(0.998 * np.interp(raw, at, np.maximum.accumulate(p)) + 0.002 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _feature_rows(lexicons):
    def run(batches):
        for batch in sliced(batches):
            half = batch.column("half")
            x = pa.array([features_of(t, lexicons[h]) for t, h in zip(texts_of(batch), half.to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), half, x], ["doc_id", "_label", "half", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Cross-fitted: the features of each half of the sampled rows come from the other half's lexicon
    and their calibration margins from the other half's trees, as for texts never seen; the final
    lexicon and trees are from all sampled rows."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int")
    rows = stored(labelled(docs, labels, "toxic", keep=~held_out(F.col("doc_id")), bound=bound).select("doc_id", "text", F.col("_label").cast("int"), half.alias("half")), "toxic-train")
    lex0, lex1, lexicon = learn_lexicons(rows)
    data = rows.mapInArrow(_feature_rows({0: lex1, 1: lex0}), "doc_id long, _label int, half int, x array<double>").orderBy("doc_id").collect()
    y, h = np.array([float(r["_label"] == 1) for r in data]), np.array([r["half"] for r in data])
    if len(np.unique(y)) < 2:
        return Model(Lexicon({}, {}, frozenset()), (0.0, []), (np.array([0.0]), np.array([y.mean() if len(y) else 0.0])))
    x = np.array([r["x"] for r in data])
    trees, raw = boost(x, y), np.zeros(len(y))
    for k in (0, 1):
        there = h != k
        raw[h == k] = margins(x[h == k], boost(x[there], y[there]) if len(np.unique(y[there])) == 2 else trees)
    return Model(lexicon, trees, isotonic(raw, y))


def score_texts(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with its score as last column; one that docs has of that name is replaced."""
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            scores = pa.array(sent.value.score(texts_of(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
