"""Aggregates over primitives: font coverage, document totals, and agreement of two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def font_coverage(glyphs: DataFrame, samples: int = 12) -> DataFrame:
    """Per base font, and in total (base_font null): glyphs, unmapped ones, their share, a marker over
    5 %, flags and the smallest unmapped codes. Generated spaces don't count."""
    rows = glyphs.where("not is_generated_space").withColumn("_mute", F.col("text") == "")
    sums = rows.rollup("base_font").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_mute").alias("unmapped"), F.max("flags").alias("flags"), F.grouping("base_font").alias("_all"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("_mute"), F.col("code")))), 1, samples).alias("codes"),
    )
    share = F.round(100.0 * F.col("unmapped") / F.col("total"), 3)
    return sums.select(F.when(F.col("_all") == 1, None).otherwise(F.col("base_font")).alias("base_font"), "total", "unmapped", "flags", "codes", share.alias("pct"), (share > 5).alias("marked"))


def totals(primitives: DataFrame) -> DataFrame:
    """Per document, a row of files: glyphs, paths, images and its fonts."""
    ids = [c for c in ("doc_row", "doc_id") if c in primitives.columns]
    return primitives.groupBy(*ids).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("glyph", "path", "image")], F.array_sort(F.collect_set(F.when(F.col("base_font") != "", F.col("base_font")))).alias("fonts"))


# Ligatures and dashes that count as plain letters and hyphens, and what a word is.
def words_of(text: Column) -> Column:
    """Comparable words: ligatures and dashes folded, soft hyphens gone, lower case."""
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("­", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.lower(F.translate(text, "‐‑‒–—−’‘", "------''"))
    return F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z]+(?:['\-][0-9A-Za-z]+)*"), F.lit(0))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), lambda i: F.concat_ws(" ", F.try_element_at(words, i), F.try_element_at(words, i + 1))))


def agreement(pairs: DataFrame, least_words: int = 50) -> DataFrame:
    """pairs: id, ours, reference. Bigram recall, word Jaccard, length ratio and a verdict; references
    of fewer than least_words words are skipped (verdict null); figures that a side without words
    leaves open are null, and null texts have no words."""
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ours", "reference")})
    df = pairs.select("id", words_of(F.col("ours")).alias("o"), words_of(F.col("reference")).alias("r"))
    ob, rb = _bigrams(F.col("o")), _bigrams(F.col("r"))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    recall = F.when(F.size("r") > 0, share(F.size(F.array_intersect(rb, ob)), F.size(rb)))
    jaccard = share(F.size(F.array_intersect("r", "o")), F.size(F.array_union("r", "o")))
    df = df.select("id", F.size("r").alias("n_words"), F.round(recall, 4).alias("bigram_recall"), F.round(jaccard, 4).alias("jaccard"), F.round(share(F.size("o"), F.size("r")), 4).alias("length_ratio"))
    verdict = F.when(F.col("n_words") < least_words, None).when(F.col("bigram_recall") >= 0.80, "ok").when(F.col("bigram_recall") >= 0.55, "WEAK").otherwise("DIVERGENT")
    return df.withColumn("verdict", verdict)


def mean_agreement(rows: DataFrame) -> DataFrame:
    """The means over the documents that have a verdict, and how many these are."""
    judged = F.col("verdict").isNotNull()
    return rows.agg(F.count_if(judged).alias("n_docs"), *[F.avg(F.when(judged, F.col(c))).alias(c) for c in ("bigram_recall", "jaccard")])
