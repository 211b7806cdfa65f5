"""Whitening, suffix array and importance resampling against brute force, with nulls, ties, repeated rows, empty
tables and extra columns of clashing names."""

import dataclasses
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioquery.llm import context_mixing, html_text, resampling, suffixes, whitening
from folioquery.llm.common import keyed

SCHEMA = "doc_id long, text string, row string, rank string, score string, spans string, _row string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "r", "k", "s", "p", "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


# --- keys


def test_keys_are_distinct_whatever_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twice = docs.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = docs.join(docs.select("source").distinct().withColumn("x", F.lit(1)), "source")
    for df in (docs, docs.where("doc_id > 20").select("text"), twice, docs.unionAll(docs), joined):
        k = keyed(df, "key", "test-keys")
        assert k.select("key").distinct().count() == df.count() == k.count()


# --- suffix array


def brute_repeats(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone, [0]])) == 1).sum())
        yield len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g)).hexdigest()


def cut(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def wanted(texts, ids):
    return Counter((i, *r) for i, r in zip(ids, brute_repeats([(t or "").encode() for t in texts], 200), strict=True))


def passages():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, exact, short = prose(70), prose(90).encode()[:200].decode("utf-8", "ignore"), prose(60)[:199]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "x" * 900, "ab" * 300, "\0" * 450]
    texts += [prose(40) + common + prose(rng.integers(1, 30)) for _ in range(25)]
    texts += [prose(20) + exact + prose(20) for _ in range(3)] + [prose(20) + short + "." + prose(20) for _ in range(3)]
    texts += [common, common, common[:-1], common[1:], common + common, prose(2000)]
    near = prose(150)
    for _ in range(30):
        at = int(rng.integers(0, len(near) - 8))
        texts.append(near[:at] + word() + near[at + int(rng.integers(0, 4)) :])
    return texts


@pytest.mark.parametrize("size", [16 << 20, 30_000, 4_000])
def test_repeated_bytes(spark, monkeypatch, size):
    """In one bucket and in many, whose edges cut groups of equal leads."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", size)
    texts = passages()
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]
    assert cut(suffixes.remove_repeated_bytes(documents(spark, texts, ids).repartition(3))) == wanted(texts, ids)


def test_repeated_bytes_of_few_rows(spark):
    assert suffixes.remove_repeated_bytes(documents(spark, [])).count() == 0
    same = ["y" * 50 + "same text " * 30] * 2 + ["same"] * 2
    assert cut(suffixes.remove_repeated_bytes(documents(spark, same))) == wanted(same, range(4))


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(5)
    for letters in (26, 1, 2, 3):
        texts = [bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)) for n in (900, 0, 199, 200, 201, 1700, 5)]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        at, _, low, high = suffixes.anchors_of(data, sizes)
        h, owner = suffixes.lead_hashes(data), {}
        for s, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for p in range(a, b + 1):
                assert p not in owner
                owner[p] = s
        ends = np.cumsum(sizes)
        inside = [p for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) for p in range(e - n, e - 199)]
        assert owner == {p: p + int(np.argmin(h[p : p + suffixes.PLACES])) for p in inside}


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 24)).astype(np.uint8)
    rows[100:140] = rows[0]
    group = rng.integers(0, 4, 500)
    order = suffixes.multikey_order(rows.view(">u8"), group)
    keys = [(group[i], bytes(rows[i])) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))


# --- importance resampling


def brute_draw(rows, target):
    def feats(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w[:-1], w[1:], strict=True))]]

    ours, theirs = Counter(f for _, t in rows for f in feats(t)[1]), Counter(f for t in target for f in feats(t)[1])
    s, t = sum(ours.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (s + 10000) / ((ours[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        w, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def drawn(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_importance_resampling(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()
    rows = [(None if r["doc_id"] % 31 == 7 else r["doc_id"], r["text"]) for r in source]
    rows += [(2, None), (3, ""), (4, "A É 1-x\0z _Ab"), (5, "word " * 20), (5, "word " * 20), (6, "word " * 19), (7, ". , ;"), (None, "Größe " * 50), (None, "Größe " * 50)]
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, "", "same same"]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(4)
    bench = spark.createDataFrame([(t, "z") for t in target], "text string, bucket string")
    assert drawn(resampling.importance(docs, bench)) == brute_draw(rows, target)
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    got = resampling.resampled(read, bench)
    ranks = brute_draw(rows, target)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in ranks.elements() if r[4])


def test_features_of_slices():
    texts = pa.array([None, "A b É b", "", "zero one two Two", "b b b", None, "Größe x"])
    whole = resampling.features(texts)
    for step in (1, 2, 3):
        parts = [resampling.features(texts.slice(a, step)) for a in range(0, len(texts), step)]
        for k in range(4):
            at = [step * i * (k % 2 == 0) for i in range(len(parts))]
            assert np.concatenate([p[k] + a for p, a in zip(parts, at, strict=True)]).tolist() == whole[k].tolist()


def test_importance_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.importance(documents(spark, []), none).count() == 0
    rows = [(i, f"{i} word " * (i % 30)) for i in range(40)]
    assert drawn(resampling.importance(documents(spark, [t for _, t in rows]), none)) == brute_draw(rows, [])


def test_one_text_in_a_third_of_the_rows(spark):
    """Equal scores: ranks of all ties are distinct and in order."""
    rows = [(None, "the same words " * 10)] * 60 + [(i, f"other {i} words " * 12) for i in range(100)]
    assert drawn(resampling.importance(documents(spark, [t for _, t in rows], [i for i, _ in rows]), spark.createDataFrame([("the same words",)], "text string"))) == brute_draw(rows, ["the same words"])


# --- whitening


def check_whitening(got, rows, components=4):
    """rows: (vec_id, vector). Against numpy's solver for symmetric matrices, by length of the vectors."""
    kept = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = Counter()
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["deviation"], r["n"]), []).append(r)
    for d in {len(x) for _, x in kept}:
        xs = [x for _, x in kept if len(x) == d]
        fit = sorted(set(xs))
        n, s = len(fit), [sum(x[i] for x in fit) for i in range(d)]
        exact = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) for j in range(d)] for i in range(d)]
        v = np.array([[e / n**3 for e in row] for row in exact], float).reshape(d, d)
        values = np.linalg.eigvalsh(v)[::-1] if d else np.empty(0)
        rank = int((values > 1e-9 * values.max(initial=0)).sum()) if values.max(initial=0) > 0 else 0
        for i, x in kept:
            if len(x) == d:
                deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
                for c in range(min(components, rank)):
                    want[i, c + 1, n, deviation if deviation < 1 << 63 else None] += 1
        mine = [r for r in got if r["n"] == n]
        for c in range(min(components, rank)):
            shares = {r["explained"] for r in mine if r["component"] == c + 1}
            assert any(abs(e - values[c] / np.trace(v)) <= 1e-9 * values[c] / np.trace(v) for e in shares)
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    return want


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + [900.0, 0, -3, 5, 0, 1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (100, None), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (102, [float("nan")] * 6), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(3)
    got = whitening.whiten(df).collect()
    check_whitening(got, rows)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    once = [i for i in range(60)]
    w = np.array([[by[c][i] for i in once] for c in (1, 2, 3, 4)])
    assert np.allclose(np.cov(w, bias=True), np.eye(4), atol=1e-9) and np.allclose(w.mean(1), 0, atol=1e-9)
    x = np.floor(256 * np.array([rows[i][1] for i in once]))
    for c in range(4):  # each is a fixed linear form of the vectors, along an eigenvector
        y = x - x.mean(0)
        u = np.linalg.lstsq(y, w[c], rcond=None)[0]
        v = np.cov(x.T, bias=True)
        e = np.linalg.eigvalsh(v)[::-1][c]
        assert np.allclose(v @ u, e * u, atol=1e-9 * np.abs(u).max() * e) and np.isclose(u @ u * e, 1)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    whole = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema))
    assert whole([]).count() == 0 and whole([(1, [])]).count() == 0 and whole([(1, [2.0, 3.0])] * 5).count() == 0
    one = whole([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 1.0])]).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in one) == [(1, 1, 2, 65536, 1.0), (2, 1, 2, 65536, 1.0), (3, 1, 2, 65536, 1.0)]
    # lengths side by side, dependent columns, huge and tiny numbers
    rng = np.random.default_rng(4)
    rows = [(i, [c / 256, 2 * c / 256, d / 256]) for i, (c, d) in enumerate(rng.integers(-99, 99, (20, 2)).tolist())]
    rows += [(i, [float(c) * 1e-1, 5e15 + 3 * float(d) * 1e13]) for i, (c, d) in enumerate(rng.normal(size=(31, 2)))]
    got = whole(rows).collect()
    assert Counter((r["n"], r["component"]) for r in got) == {(20, 1): 20, (20, 2): 20, (31, 1): 31, (31, 2): 31}
    check_whitening([r for r in got if r["n"] == 20], rows[:20])
    assert all(r["deviation"] is None for r in got if r["n"] == 31) and got[0]["identity_error"] < 1e-6
    assert whole([(1, [1e300]), (2, [1.0]), (3, [4.0])]).count() == 2


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix, whose eigenvalues span 26 decades: known by its factor."""
    scale = np.diag(10.0 ** -np.arange(0, 14))
    rng = np.random.default_rng(3)
    q = rng.normal(size=(14, 14))
    v = scale @ (q @ q.T + 14 * np.eye(14)) @ scale
    values, columns = whitening.eigen(v)
    from fractions import Fraction

    exact = [[Fraction(x) for x in row] for row in v.tolist()]
    det = Fraction(1)
    for k in range(14):  # determinant without rounding
        det *= exact[k][k]
        for i in range(k + 1, 14):
            f = exact[i][k] / exact[k][k]
            exact[i] = [a - f * b for a, b in zip(exact[i], exact[k], strict=True)]
    assert len(values) == 14 and abs(math.prod(values.tolist()) / float(det) - 1) < 1e-10 and np.allclose(columns.T @ columns, np.eye(14), atol=1e-12)


def test_exact_products():
    rng = np.random.default_rng(6)
    for most in (10, 1 << 21, 1 << 40, 1 << 62):
        y = rng.integers(-most, most, (1100, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.exact_product(y).tolist() == want
        assert whitening.exact_sum(y).tolist() == [sum(map(int, y[:, i])) for i in range(3)]


# --- language scores


def brute_own(model, text):
    """Each decision's log odds from the counts less all that the text itself holds."""
    d = context_mixing.decide([text], model.code)
    x = np.empty(d.slots.shape)
    for k in range(context_mixing.PREDICTORS):
        own = Counter(zip(d.slots[:, k].tolist(), d.bits.tolist(), strict=True))
        for i, slot in enumerate(d.slots[:, k].tolist()):
            n = [int(model.counts[slot] >> 16 * b & 0xFFFF) - own[slot, b] for b in (0, 1)]
            x[i, k] = math.log(max(0, n[1]) + context_mixing.PRIOR) - math.log(max(0, n[0]) + context_mixing.PRIOR)
    return x


def test_a_text_that_repeats_itself_scores_alike_trained_on_or_not(spark, monkeypatch):
    source = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect() if r["text"]]
    words = sorted({w for t in source[:40] for w in t.split()})
    line = " ".join(words[i] for i in np.random.default_rng(1).integers(0, len(words), 14)) + "\n"  # known words in an order of its own
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(source) + 1]
    once = [*source, line * 30]
    rows = documents(spark, once, ids[: len(once)]).select("doc_id", "text")
    model, _ = context_mixing.train(rows, 4)
    scorer = context_mixing.Scorer(model)
    some = [t.encode() for t in (once[-1], once[3], "", once[5][:300])]
    d = context_mixing.decide(some, model.code)
    assert np.allclose(scorer.own_odds(d), np.concatenate([brute_own(model, t) for t in some]), atol=1e-5) and not scorer.mine.any()
    # as by a model that has the same code, and was never shown the text
    text = once[-1].encode()
    d = context_mixing.decide([text], model.code)
    counts = model.counts.copy().view(np.uint16)
    np.subtract.at(counts, (d.slots * 2 + d.bits[:, None]).ravel(), 1)
    unseen = context_mixing.Scorer(dataclasses.replace(model, counts=counts.view(np.uint32)))
    assert abs(scorer.log10([text], True)[0] / unseen.log10([text], False)[0] - 1) < 1e-5
    assert scorer.log10([text], False)[0] > 0.7 * scorer.log10([text], True)[0]  # its own counts would have told it
    long = once[-1].encode() + once[3].encode()
    whole = scorer.log10([long], True)[0]
    monkeypatch.setattr(context_mixing, "LONG", 100)
    monkeypatch.setattr(context_mixing, "TOGETHER", 700)
    assert abs(scorer.log10([long], True)[0] / whole - 1) < 0.02 and not scorer.mine.any()


def some_texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.zipf(1.4, 400) % 3000).encode() for _ in range(300)]
    data = np.frombuffer(b"\0\0" + b"".join(t + b"\xff" for t in texts), np.uint8).astype(np.int64)
    return texts, context_mixing.make_code(*np.unique(data[:-2] << 16 | data[1:-1] << 8 | data[2:], return_counts=True))


def sums_of(texts, code):
    batch = pa.record_batch([pa.array([t.decode() for t in texts])], ["text"])
    found = list(context_mixing._fill(code)(iter([batch])))
    return len(found), np.sum([np.concatenate([context_mixing.unpack(c, np.int64) for c in b.column("counts").to_pylist()]) for b in found], axis=0)


def test_own_counts_cost_little():
    """Training texts take less than three times the time of others; it was six times."""
    texts, code = some_texts()
    counts, none = sums_of(texts, code)[1].reshape(-1, 2).astype(np.uint32), np.empty(0, np.int64)
    scorer = context_mixing.Scorer(context_mixing.Model(1, 1, 1, code, counts[:, 0] | counts[:, 1] << np.uint32(16), none.view(np.uint64), none))
    took = {False: [], True: []}
    for own in (False, True) * 3:
        began = time.process_time()
        scorer.log10(texts, own)
        took[own].append(time.process_time() - began)
    assert min(took[True]) < 3 * min(took[False])


def test_sums_of_bits_are_sent_before_they_run_over(monkeypatch):
    texts, code = some_texts()
    want = np.zeros(2 * int(context_mixing.FIRST_SLOT[-1]), np.int64)
    for d in context_mixing.all_decisions(texts, code):
        for k in range(context_mixing.PREDICTORS):
            np.add.at(want, d.slots[:, k].astype(np.int64) * 2 + d.bits, np.int64(1))
    n, at_once = sums_of(texts, code)
    assert n == 1 and np.array_equal(at_once, want)
    monkeypatch.setattr(context_mixing, "PART", 1 << 16)
    monkeypatch.setattr(context_mixing, "MOST_SEEN", 1 << 19)
    n, in_parts = sums_of(texts, code)
    assert n > 1 and np.array_equal(in_parts, want)


def test_decisions_of_a_byte_are_side_by_side():
    """Each context has cells of its own for all ways, in its predictor's table; those of the eight heaviest nodes fill one line of memory."""
    texts, code = some_texts()
    for k, bits in enumerate(context_mixing.SLOT_BITS):
        assert context_mixing.FIRST_SLOT[k] % (1 << bits) == 0
        assert len(set(code.turns[:, k].tolist())) == 512 and code.turns[:, k].max() < 2 << bits
        assert set((code.turns[:16, k] >> 1).tolist()) == set(range(8))
    passed = np.zeros(255, np.int64)
    d = context_mixing.decide(texts, code)
    at = 0
    for t in texts[:20]:
        data = b"\0\0" + t + b"\xff"
        for i in range(2, len(data)):
            r = code.rank[data[i - 1] | data[i - 2] << 8, data[i]]
            near = [j for j in range(int(code.length[r])) if code.path[r, j] < 8]
            assert all(len(set((d.cells[[at + j for j in near], k] >> 4).tolist())) == 1 for k in range(context_mixing.PREDICTORS))
            passed[code.path[r, : code.length[r]]] += 1
            at += int(code.length[r])
    assert passed[:8].min() > passed[40:].max()


def test_words_of_texts():
    texts = ["", None, " \t\r\n\x0b\x0c", " Two  words\n", "two WORDS\x1f\u00a0\u2003x Two", "\u00c4 \u00e4 \u0130", "\0 nul\0 two"] * 3
    hashes, doc, word = context_mixing.words_of(pa.array(["left out", *texts]).slice(1))
    assert len(set(hashes.tolist())) == len(hashes)
    for i, t in enumerate(texts):
        want = context_mixing.hash_words((t or "").encode().lower().split())
        assert hashes[word[doc == i]].tolist() == want.tolist()
    assert [len(x) for x in context_mixing.words_of(pa.array([None, " "]))] == [0, 0, 0]


# --- HTML


def test_pages_made_of_known_blocks():
    """200 pages of article blocks among clutter: the text is the planted blocks, whatever their length and classes."""
    rng = np.random.default_rng(17)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(n)).capitalize() + "."
    clutter = lambda: pick(
        f"<nav><a href=x>{prose(2)}</a></nav>", f"<div class='{pick('ad', 'ad-box', 'cookie-notice', 'share-buttons', 'related-posts', 'newsletter', 'comments', 'comment-list', 'sidebar')}'><p>{prose(9)}</p></div>",
        f"<form><label>{prose(3)}</label><input></form>", f"<script>{prose(3)}</script>", f"<aside><p>{prose(12)}</p></aside>", f"<style>{prose(3)}</style>", "<!-->", f"<!-- {prose(4)} -->", "<!--->",
    )

    def block():
        n, text = int(pick(1, 3, 8, 40)), ""
        text = prose(n)
        return pick(f"<p>{text}</p>", f"<h2>{text}</h2>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<section class='{pick('related-work', 'comments-on-method', 'social-impact', 'skip-connections')}'><p>{text}</p></section>", f"<div><p>{text}</p></div>"), text

    for _ in range(200):
        blocks = [block() for _ in range(int(rng.integers(3, 12)))] + [(f"<p>{(t := prose(60))}</p>", t)]
        rng.shuffle(blocks)
        inside = "".join(html + (clutter() if rng.random() < 0.4 else "") for html, _ in blocks)
        shape = pick("article", "main", "both", "two")
        texts = [t for _, t in blocks]
        if shape == "both":
            inside, texts = f"<main><h1>Title</h1><p>Intro.</p><article>{inside}</article><p>Outro.</p></main>", ["Title", "Intro.", *texts, "Outro."]
        elif shape == "two":
            inside, texts = f"<div><article>{inside}</article>{clutter()}<article><p>Short one.</p></article></div>", [*texts, "Short one."]
        else:
            inside = f"<{shape}>{inside}</{shape}>"
        page = f"<html><head><title>x</title></head><body><header><a href=y>{prose(3)}</a></header>{clutter()}{inside}{clutter()}<footer>{prose(6)}</footer></body></html>"
        assert html_text.extract(page) == "\n".join(texts), page
