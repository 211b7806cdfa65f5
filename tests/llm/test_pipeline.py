from collections import Counter

import corpus_pipeline
import numpy as np
from folioquery.llm import decontam, mixing
from folioquery.llm.common import keyed, stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        ids = {r[0] for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SMALL), "test-stage")
        if name == "token_records":
            break
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= ids
        if name != "mix":
            assert 0.7 * before < docs.count() <= before
            before = docs.count()
    out = docs.orderBy("start").collect()
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:i]) for i in range(len(out))]


def test_rows_with_null_and_repeated_ids_are_mixed(spark):
    rows = [(None if i % 2 else i // 4, f"t{i} " + "word " * 9, s) for i in range(60) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mix(spark, docs, SMALL)
    got = Counter(tuple(r) for r in out.collect())
    assert out.columns == docs.columns and set(got) <= set(rows)
    # 1,200 words, five parts to a and two to b
    by = {s: sum(n for r, n in got.items() if r[2] == s) for s in ("a", "b")}
    assert abs(by["a"] - 1200 * 5 / 7 / 10) <= 1 and abs(by["b"] - 1200 * 2 / 7 / 10) <= 1
    assert {r[1] for r in got if r[0] is None and r[2] == "a"} == {r[1] for r in rows if r[0] is None and r[2] == "a"}


def test_items_without_id_are_searched(spark):
    bench = spark.createDataFrame([(None, "a passage of the benchmark")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here is a passage of the benchmark, copied"), (None, "nothing of it")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.uncontaminated(docs, bench).collect()] == [None]


def test_rows_with_null_and_repeated_ids_are_deduplicated(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(5, base, "a"), (4, base, "b"), (5, "another text of more than five words here", "a"), (None, base + " end", "c"), (None, "a text without an id, and nothing like it", "c"), (7, None, "a"), (7, "", None), (7, None, "a"), (4, base, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _group string")
    got = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())
    assert got == Counter([rows[1], rows[2], rows[4], rows[5], rows[6], rows[7]])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SMALL).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on rows with nulls, copies, repeated ids and passages, given the toxic ones."""
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(160).collect()]
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    texts += [t + " and a tail" for t in texts[:20]] + texts[:10] + [None, "", "one", f"Here it says: {passage}"]
    rows = [(None if i % 37 == 5 else i % 150, t, "abc"[i % 3], "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, label = [shingles(r[1]) for r in rows], list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    groups: dict = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(i)
    kept = [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    key = lambda i: rows[i]
    assert Counter(tuple(r) for r in got.collect()) == Counter(map(key, kept))
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r["text"]]
    patterns = set()
    for t in bench:
        w = decontam.bench_words(t.encode())
        patterns |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(p) for p in patterns}

    def hit(t):
        w = decontam.bench_words((t or "").encode())
        return any(tuple(w[i : i + n]) in patterns for n in sizes for i in range(len(w) - n + 1))

    clean = [i for i in kept if not hit(rows[i][1])]
    got = stored(corpus_pipeline.decontaminate(spark, stored(got, "test-stage"), SMALL), "test-stage")
    assert Counter(tuple(r) for r in got.collect()) == Counter(map(key, clean)) and len(clean) < len(kept)
    mixed = stored(corpus_pipeline.mix(spark, got, SMALL), "test-stage")
    out = mixed.collect()
    total = sum(len((rows[i][1] or "").encode().split()) for i in clean)
    by = Counter()
    for r in out:
        by[r["source"]] += len(r["text"].encode().split())
    caps = {s: 3 * sum(len((rows[i][1] or "").encode().split()) for i in clean if rows[i][2] == s) for s in "abc"}
    level = max(total * 5 / 8, 0)
    assert max(Counter(tuple(r) for r in out).values()) <= 3 * max(Counter(map(key, clean)).values())
    assert abs(by["a"] - min(level, caps["a"])) < 0.1 * total
    records = corpus_pipeline.token_records(spark, mixed, SMALL).collect()
    assert Counter(r["doc_id"] for r in records) == Counter(r["doc_id"] for r in out)


def test_mixing_shuffles_no_texts_and_copies_rows_to_the_nearest_number(spark, monkeypatch):
    """As by each row's own number of words; rows of null and equal ids, of no source, and without words among them."""
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 700)
    rnd = np.random.default_rng(8)
    data = [(None if i % 11 == 0 else i // 3, " ".join(["w"] * int(rnd.integers(0, 40))) + f" t{i}" * (i % 5 > 0), [None, "a", "b", "c"][min(3, int(rnd.zipf(1.7)) - 1)]) for i in range(600)]
    docs = stored(spark.createDataFrame([*data, (5, None, "a"), (6, " \n", "zz")], "doc_id long, text string, source string"), "test-mix")
    rows = keyed(docs, "row", "test-mix-rows")
    want = Counter()
    for r in mixing.mix_targets(rows, shard_tokens=700, row="row").where("size > 0").collect():
        want[r["row"]] = int(r["taken"] / r["size"] + 0.5)
    copied = mixing.whole_copies(rows, "row")
    assert Counter(r["row"] for r in copied.collect()) == +want and set(want.values()) >= {0, 1, 3}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.mix(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not [x for x in plan.splitlines() if "Join" in x and "BroadcastHashJoin" not in x] and "text" in plan
