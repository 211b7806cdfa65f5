"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from folioquery.llm import context_mixing, decontam, html_text, mixing, near_dedup, quality, repeats, token_counts, token_records, toxicity
from folioquery.llm.common import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _key string, kept string, bucket string"
LONG = " ".join(f"w{i % 977}" for i in range(9000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", [None, "a", "b", "c"][(i or 0) % 4], None, 1.0, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [
    None, "", "  \t\n ", "one", "one", "one two", LONG, LONG, LONG + " tail", BASE, BASE.replace("mu", "MU"), BASE.replace("omega", "end", 1), BASE + " plus some more words at the end of it all",
    "x\0y é ñ z", BASE[40:], "Some; other, text. With: marks!\nSome; other, text. With: marks!\n" * 4, "#" * 50, "a b c d e f g h i j k l m n o p q r s t u v w x y z " + BASE[:300],
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t):
    return (t or "").encode().split()


def test_near_duplicates(spark, docs, nothing):
    def shingles(t, k):
        w = words((t or "").encode().lower().decode())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    for k, percent in ((3, 85), (5, 80)):
        sets = [shingles(t, k) for t in TEXTS]
        label = list(range(len(TEXTS)))
        for _ in TEXTS:
            for a, b in combinations(range(len(TEXTS)), 2):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        found = rows(near_dedup.near_duplicates(docs, k, percent))
        assert {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label, strict=True))} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()}
    assert near_dedup.near_duplicates(nothing).count() == 0
    twice = near_dedup.near_duplicates(documents(spark, [BASE, BASE, "", None, BASE], [5, 5, 6, None, None]))
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in twice.collect()) == Counter({(5, 5, True): 2, (6, 6, True): 1, (None, None, True): 2})


def test_a_group_of_near_copies_that_needs_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rnd = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for at in rnd.choice(120, rnd.integers(1, 7), replace=False):
            w[at] = f"r{rnd.integers(1 << 30)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    label = list(range(40))
    for _ in range(40):
        for a, b in combinations(range(40), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    found = rows(near_dedup.near_duplicates(documents(spark, texts), 3, 85))
    assert [found[i]["component_id"] for i in range(40)] == label and len(set(label)) > 3


def test_similarity_estimates_are_near():
    rnd = np.random.default_rng(1)
    for overlap in (0.5, 0.85, 0.95):
        n = 2000
        both = rnd.integers(0, 1 << 63, int(n * overlap), dtype=np.uint64)
        a, b = (np.concatenate([both, rnd.integers(0, 1 << 63, n - len(both), dtype=np.uint64)]) for _ in range(2))
        true = len(both) / (2 * n - len(both))
        ra, rb = near_dedup.registers(a), near_dedup.registers(b)
        est = near_dedup.similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(est - true) < 0.2
        assert (near_dedup.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()


def test_repeats(spark, docs, nothing):
    seen = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for s in range(len(w) - 12):
            seen.setdefault(tuple(w[s : s + 13]), i)
    want = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = {j for s in range(len(w) - 12) if seen[tuple(w[s : s + 13])] < i for j in range(s, s + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    for batches in (1, 2, 4):
        assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in rows(repeats.remove_repeats(docs, batches)).items()} == want
    assert repeats.remove_repeats(nothing).count() == 0
    odd = repeats.remove_repeats(documents(spark, [BASE, BASE, BASE, BASE], [None, 7, 7, 8]))
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in odd.collect()) == [("7", 0), ("7", 0), ("8", 72), ("None", 0)]


def test_contamination(spark, docs, nothing):
    items = [(1, BASE[:200]), (2, "one"), (3, None), (None, "two"), (4, "Marks! Some other"), (5, ""), (20, BASE[:200]), (6, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: decontam.bench_words((t or "").encode())
    found = rows(decontam.contamination(docs, bench))
    some = rows(decontam.contamination(docs, bench, pattern_bytes=100))
    for i, t in enumerate(TEXTS):
        w, hit, named = norm(t), set(), set()
        for item, text in items:
            p = norm(text) if item is not None else []
            m = min(10, len(p))
            for s in range(len(p) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[s : s + m]:
                        hit |= set(range(at, at + m))
                        named.add(str(item))
        want = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
        for r in (found[i], some[i]):
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    clean = decontam.uncontaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in found.items() if not r["contaminated"]}
    assert decontam.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontam.contamination(docs, bench.limit(0))).values())


def test_statistics_and_rules(spark, docs, nothing):
    for t in TEXTS:
        s = (t or "").encode()
        w = s.split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in s.split(b"\n") if x.split()]
        got = quality.statistics_of(s)
        assert got[:5] == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in s.decode()), len(lines) - len(set(lines)), len(repeat))
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    good = [f"plain words number {i} of a calm text about things and places" for i in range(200)]
    texts = [good[i // 2] if i % 2 == 0 else f"a{i} ### $$$ ||| %%% b ## c $$ d || e {i}" for i in range(400)]
    rules = quality.fit_rules(documents(spark, texts), labels)
    found = rows(quality.quality_verdicts(documents(spark, texts), rules))
    assert rules and sum(found[i]["kept"] == (i % 2 == 0) for i in range(400)) > 390
    assert quality.fit_rules(nothing, labels) == [] and quality.quality_verdicts(nothing, rules).count() == 0
    plain = rows(quality.quality_verdicts(docs, []))
    assert plain[0]["base_failed"] and not plain[6]["kept"] == plain[6]["base_failed"]


def test_toxicity(spark, docs, nothing):
    rnd = np.random.default_rng(0)
    text = lambda bad: " ".join([*rnd.choice(["sun", "tree", "walk", "road", "blue", "you"], 30), *(["vilewordo"] if bad else []), *rnd.choice(["sea", "hill"], 5)])
    texts = [text(i % 3 == 0) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    df = documents(spark, texts)
    model = toxicity.train(df, labels)
    scored = toxicity.score_texts(df, model)
    found = rows(scored)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i]["score"] >= 0.5) == (i % 3 == 0) for i in held) / len(held) > 0.97
    assert scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in found.values())
    assert toxicity.score_texts(docs, model).count() == len(TEXTS) and toxicity.score_texts(nothing, model).count() == 0
    none = toxicity.train(df, labels.limit(0))
    assert toxicity.score_texts(df.limit(3), none).count() == 3


def test_nearness_to_second_person_in_texts_of_any_length():
    at = toxicity.FEATURES.index("near_second_person")
    lex = toxicity.Lexicon({}, {}, frozenset({b"idiot"}))
    for n in (3, 1100):  # 1,100 hits and as many second-person words, 50 words apart
        assert toxicity.features_of(b"idiot " * n + b"calm " * 49 + b"you " * n, lex)[at] == 1 / 51
    rnd = np.random.default_rng(4)
    for _ in range(50):
        words = rnd.choice([b"idiot", b"you", *[b"calm"] * 20], 60).tolist()
        gaps = [abs(i - j) for i, a in enumerate(words) if a == b"idiot" for j, b in enumerate(words) if b == b"you"]
        assert toxicity.features_of(b" ".join(words), lex)[at] == (1 / (1 + min(gaps)) if gaps else 0.0)


def test_isotonic_is_monotone():
    knots, p = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(knots) > 0).all() and (np.diff(p) >= 0).all()


def test_token_records(spark, docs, nothing):
    enc = token_records.Encoder(token_records.default_tokenizer())
    whole = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in TEXTS]
    root = work_dir(spark, "records")
    manifest = token_records.write_records(docs, root, shards=3)
    found, start = rows(token_records.read_records(manifest, root, with_ids=True, chunk=2)), 0
    for i, ids in enumerate(whole):
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd = documents(spark, ["b", "a", "a"], [None, 4, 4])
    root = work_dir(spark, "records")
    assert sorted(str(r["doc_id"]) for r in token_records.read_records(token_records.write_records(odd, root), root).collect()) == ["4", "4", "None"]
    root = work_dir(spark, "records")
    assert token_records.read_records(token_records.write_records(nothing, root), root).count() == 0


def test_records_notice_damage():
    data = bytearray(token_records.frame(3, np.array([1, 2, 3], "<u2").tobytes(), 2))
    assert [(d, ids.tolist()) for d, ids in token_records.parse(memoryview(data))] == [(3, [1, 2, 3])]
    for at in (0, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            list(token_records.parse(memoryview(bad)))


@pytest.mark.parametrize("text", ["word, x.", "a!, b", "é, ñ?! 1. 2,", "a  b   c", "x\n\ny", "<|endoftext|> q", "don't 's", "tab\tx", "end ", "\nfoo", " ", "😀 ok 😀", "a\0b", "a b　c"])
def test_pieces_encode_like_whole_texts(text):
    enc = token_records.Encoder(token_records.default_tokenizer())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_are_looked_up_once_in_texts_taken_together(monkeypatch):
    looked = []

    class Pieces(dict):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    enc = token_records.Encoder(token_records.default_tokenizer())
    enc.pieces = Pieces()
    texts = ["the cat, the dog\nthe cat! " * 200, " the é 😀 dog.", "", "two  spaces", "\n", "the " * 3000 + "end", "a\nthe\n the"]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_all(texts)] == want
    assert len(looked) < 60  # by piece it was above 4,000
    monkeypatch.setattr(token_records, "CUT_CHARS", 20)
    monkeypatch.setattr(token_records, "STRETCH", 7)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode_all(texts)] == want


def test_mixing(spark, docs, nothing):
    sizes = [len(words(t)) for t in TEXTS]
    found = rows(mixing.mix_targets(docs, block_tokens=1))
    again = rows(mixing.mix_targets(docs.repartition(5), block_tokens=1))
    assert {i: r["taken"] for i, r in found.items()} == {i: r["taken"] for i, r in again.items()}
    source = lambda i: [None, "a", "b", "c"][i % 4]
    per = {s: sum(n for i, n in enumerate(sizes) if source(i) == s) for s in (None, "a", "b", "c")}
    weight, left, target = {"a": 5, "b": 2, "c": 1, None: 5}, float(sum(sizes)), {}
    open_ = dict(weight)
    while True:  # water filling, one source at a time
        level = left / sum(open_.values())
        full = [s for s in open_ if 3 * per[s] < level * open_[s]]
        if not full:
            break
        s = min(full, key=lambda s: 3 * per[s] / open_[s])
        target[s] = 3.0 * per[s]
        left -= target[s]
        del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    for i, r in found.items():
        assert r["size"] == sizes[i] and r["source_size"] == per[source(i)] and abs(r["target"] - target[source(i)]) < 1e-6 and 0 <= r["taken"] <= 3 * sizes[i]
    for s in per:
        assert abs(sum(r["taken"] for i, r in found.items() if source(i) == s) - target[s]) <= 1
    assert mixing.mix_targets(nothing).count() == 0
    assert {r["taken"] for r in mixing.mix_targets(documents(spark, ["", None])).collect()} == {0}


def test_apportionment_by_highest_quotients(spark):
    rnd = np.random.default_rng(2)
    for seats in (0, 1, 3, 7, 50, 1001):
        votes = [(int(i), float(v)) for i, v in enumerate(rnd.integers(0, 1000, 9))]
        got = [0] * 9
        for _ in range(seats):
            best = max(range(9), key=lambda i: (votes[i][1] / (2 * got[i] + 1), -i))
            got[best] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in votes], "i int, v double, n long")
        found = rows(mixing.sainte_lague(df, [], "v", "n", ["i"]), "i")
        assert [found[i]["quota"] for i in range(9)] == got


def test_token_rollup(spark, docs, nothing):
    root = work_dir(spark, "rollup")
    total = {tuple(r[:3]): tuple(r[3:]) for r in token_counts.maintained_counts(docs, root).collect()}
    want = Counter()
    firsts = {t: min(i for i, x in enumerate(TEXTS) if x == t) for t in TEXTS if t is not None}
    for i, t in enumerate(TEXTS):
        if t is None or firsts[t] == i:
            want[[None, "a", "b", "c"][i % 4]] += len(words(t))
    assert {s: total[s, "en", "words-1"][1] for s in want} == dict(want)
    rollup = token_counts.TokenRollup(spark, root)
    counts = spark.createDataFrame([("a", "en", "words-1", 5)], "source string, lang string, tokenizer string, n_tokens long")
    assert rollup.commit("more", token_counts.inserted(counts)) and not rollup.commit("more", token_counts.inserted(counts))
    small = rollup.compact(work_dir(spark, "rollup"))
    now = {tuple(r[:3]): tuple(r[3:]) for r in small.totals().collect()}
    assert now["a", "en", "words-1"] == (total["a", "en", "words-1"][0] + 1, total["a", "en", "words-1"][1] + 5)
    assert not small.commit("more", token_counts.inserted(counts))
    assert token_counts.maintained_counts(nothing, work_dir(spark, "rollup")).count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more &lt; x", "just text & more < x"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>One,  two\n three &eacute;.<p>Four<br>five</article><aside><p>Ad, ad, ad</p></aside><footer>&copy; me</footer></body></html>", "Title\nOne, two three é.\nFour five"),
    ("<body><div id=cookie-notice>We use cookies, ok</div><div class=sidebar><p>Popular, now</p></div><div class=content><h2>Head</h2><p>Body text, with commas, and length enough to win the day.</p><form><p>Join, us</p></form><ul><li>first<li>second</ul></div><div class=comments><p>I think, you, are, all, wrong, about, this, and, that, too, really.</p></div>", "Head\nBody text, with commas, and length enough to win the day.\nfirst\nsecond"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>hidden</p> -->", "yes"),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    found = rows(html_text.extract_text(df), "page_id")
    assert [found[i]["text"] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert html_text.extract_text(df.limit(0)).count() == 0


LONG_P = "<p>" + "Words, and more words, of a long section, " * 12 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        (f"<body><div class=wrap><h2>First</h2><div class=section>{LONG_P * 3}</div><h3>Then</h3><ul><li>an item</ul><blockquote>Said so</blockquote><pre>x = 1</pre><table><tr><td>a cell</table><p>Short.</p><div class=section><p>Brief section</p></div></div>", ["First", "Then", "an item", "Said so", "x = 1", "a cell", "Short.", "Brief section"], []),
        (f"<body><div><div><div>{LONG_P * 3}</div></div><div><div><p>Brief section</p></div></div></div>", ["Brief section"], []),
        (f"<body><article>{LONG_P}<ul><li><a href=x>Source one</a><li><a href=y>Source two</a></ul></article>", ["Source one", "Source two"], []),
        (f"<body><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div>{LONG_P}<ul><li><a href=x>Source one</a><li><a href=y>Source two</a></ul></div><div><a href=x>More</a> <a href=y>News</a></div>", ["Source one", "Source two"], ["Home", "About", "More", "News"]),
        (f"<body><div><div>{LONG_P}</div><div><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><p>{'Text of another part. ' * 9}</p></div></div>", ["Text of another part."], ["Home", "About"]),
        (f"<body><ul><li><a href=x>Home</a><li><a href=y>About</a></ul>{LONG_P}<h2>Last</h2><p>Brief.</p>", ["Last", "Brief."], ["Home", "About"]),
    ],
)
def test_html_keeps_all_parts_of_the_text(page, kept, gone):
    text = html_text.extract(page)
    assert all(t in text for t in ["Words, and more words", *kept]) and not any(t in text for t in gone)


@pytest.mark.parametrize("page", [lambda n: "<span>" * n + "</b>" * n + "end", lambda n: "<span>word " * n, lambda n: "<span>" * n + "<div>x</div>" * n, lambda n: "<a href=x>" * n + "<li>x" * n])
def test_html_of_odd_nesting_takes_time_by_length(page):
    import time

    def seconds(n):
        began = time.process_time()
        assert html_text.extract(page(n))
        return time.process_time() - began

    assert seconds(16_000) < 12 * max(0.02, seconds(4_000))  # in proportion: 4 times; by the square: 16


def test_a_header_inside_an_article_is_part_of_it():
    page = f"<body><header><p>Site name</p></header><article><header><h1>Title</h1><p>What it is about.</p></header>{LONG_P}</article>"
    text = html_text.extract(page)
    assert text.startswith("Title\nWhat it is about.\nWords") and "Site name" not in text


def test_language_scores(spark, docs, nothing):
    import math

    found = rows(context_mixing.language_scores(docs))
    train = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    for i, t in enumerate(TEXTS):
        if not held[i]:
            train.update(words((t or "").encode().lower().decode()))
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        w = [*words((t or "").encode().lower().decode()), "end"]
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(train[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert context_mixing.language_scores(nothing).count() == 0


def test_bits_of_all_texts_add_up_to_one():
    """The code is a prefix code, so the probabilities of the next byte sum to 1."""
    code = context_mixing.make_code(np.arange(0, 1 << 24, 77), np.arange(0, 1 << 24, 77) % 1000 + 1)
    assert abs(sum(2.0 ** -int(code.length[r]) for r in range(256)) - 1) < 1e-12
    assert b"".join(context_mixing.pieces_of(b"some text\nwith  pieces ")) == b"some text\nwith  pieces \xff"


def test_scores_see_what_stands_before_a_word(spark):
    rnd = np.random.default_rng(5)
    follow = {w: rnd.choice(60, 2) for w in range(60)}
    names = ["".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(60)]

    def fluent():
        w, out = 0, []
        for _ in range(200):
            out.append(names[w])
            w = int(rnd.choice(follow[w]))
        return out

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [fluent() for _ in range(400)]
    salad = [list(rnd.permutation(t)) if i in held[::2] else t for i, t in enumerate(texts)]
    for between in (" ", ""):  # the latter: nowhere to cut
        found = rows(context_mixing.language_scores(documents(spark, [between.join(t) for t in salad])))
        worse, better = (np.mean([found[i]["score"] for i in part]) for part in (held[::2], held[1::2]))
        assert worse < 1.3 * better < 0


def test_mixing_learns():
    rnd = np.random.default_rng(0)
    bits = (rnd.random(20000) < 0.5).astype(np.uint8)
    x = np.zeros((20000, context_mixing.PREDICTORS), np.float32)
    x[:, 0] = np.where(bits, 2.0, -2.0)  # one predictor is right, the others say nothing
    assert -context_mixing.mix_bits(x, bits, np.zeros(20000, np.uint8)) / 20000 < 0.45


def test_weights_adapt_in_short_and_long_texts():
    rnd = np.random.default_rng(6)

    def bits_and_odds(n, wrong_from):
        bits = (rnd.random(n) < 0.5).astype(np.uint8)
        x = np.zeros((n, context_mixing.PREDICTORS), np.float32)
        x[:, 0] = np.where(bits, 2.0, -2.0)
        x[wrong_from:, 0] *= -1
        return x, bits, np.zeros(n, np.uint8)

    cost = lambda n, wrong: -context_mixing.mix_bits(*bits_and_odds(n, wrong))
    assert cost(200, 200) / 200 < 0.9 * cost(16, 16) / 16
    assert (cost(62_000, 34_000) - cost(34_000, 34_000)) / 28_000 < 0.5  # a predictor that turns wrong late


def test_texts_side_by_side_are_mixed_each_on_its_own():
    rnd = np.random.default_rng(7)
    counts = np.array([5, 700, 0, 32, 33, 1500])
    n = int(counts.sum())
    x, bits, gates = rnd.normal(size=(n, context_mixing.PREDICTORS)).astype(np.float32), (rnd.random(n) < 0.5).astype(np.uint8), rnd.integers(0, context_mixing.GATES, n).astype(np.uint8)
    start = rnd.random((context_mixing.GATES, context_mixing.PREDICTORS)).astype(np.float32)
    both, ends = context_mixing.mix(x, bits, gates, counts, start)[0], np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
        w, total = start.copy(), 0.0
        first = a
        while first < b:
            step = min(max(first - a, context_mixing.FIRST_STEP), context_mixing.STEP)
            part, first = slice(first, min(b, first + step)), first + step
            p = 1 / (1 + np.exp(-(x[part] * w[gates[part]]).sum(axis=1)))
            total += np.log2(np.where(bits[part] == 1, p, 1 - p)).sum()
            np.add.at(w, gates[part], context_mixing.LEARN * (bits[part] - p)[:, None] * x[part])
        assert abs(both[i] - total) < 1e-3 * max(1, abs(total))


def test_triples_of_bytes_are_spread_over_buckets():
    import pyarrow as pa

    text, got, buckets = " ".join(TEXTS[-1:] + [BASE]), Counter(), set()
    for batch in context_mixing._count(8)(iter([pa.record_batch([pa.array([text])], ["text"])])):
        for r in batch.to_pylist():
            if r["bucket"] < 0:
                buckets.add(r["bucket"])
                got.update(dict(zip(context_mixing.unpack(r["hashes"]).tolist(), context_mixing.unpack(r["counts"], np.int64).tolist(), strict=True)))
    data = b"\0\0" + text.encode() + b"\xff"
    assert got == Counter(int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)) and len(buckets) == 8


def test_an_index_is_opened_again_and_compacted(spark):
    """Ten batches by three openings, one of them twice: as all at once."""
    rnd = np.random.default_rng(9)
    shared = [" ".join(f"s{k}w{i}" for i in range(30)) for k in range(6)]
    texts = [" ".join([f"d{d}", *rnd.choice(400, 40).astype(str), shared[int(rnd.integers(6))], *rnd.choice(400, 20).astype(str)]) for d in range(60)]
    texts[7] = " ".join(f"only{i}" for i in range(100))
    docs, root = documents(spark, texts), work_dir(spark, "test-index")
    for batch in range(10):
        index = repeats.FingerprintIndex(spark.newSession() if batch in (4, 7) else spark, root, 8)
        part = docs.where(f"doc_id >= {6 * batch} and doc_id < {6 * batch + 6}")
        index.append(part, batch)
        if batch == 5:
            index.append(part, batch)
    assert index.runs() == [(0, 3), (4, 7), (8, 8), (9, 9)]
    plan = index.postings((8, 8)).join(index.postings((9, 9)), "at")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    opened = repeats.FingerprintIndex(spark, root, 8)
    found = rows(repeats.rewritten(docs, repeats.repeated_windows(docs, opened)))
    seen, lost = set(), set()
    for d, t in enumerate(texts):
        w = t.split()
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        if grams & seen:
            lost.add(d)
        seen |= grams
    assert set(found) == lost and all(r["n_removed"] == 30 for r in found.values())


def test_segments_of_long_texts(monkeypatch):
    """Decisions of a text in segments are those of the whole text, unless a piece is longer than a segment."""
    rnd = np.random.default_rng(11)
    words = [bytes(rnd.integers(97, 123, rnd.integers(1, 12)).astype(np.uint8)) for _ in range(4000)]
    text = b"".join(w + (b" ", b"\n", b"  ")[i % 3] for i, w in enumerate(words)) + b"\0tail"
    code = context_mixing.make_code(np.arange(0, 1 << 24, 77), np.arange(0, 1 << 24, 77) % 1000 + 1)
    whole = context_mixing.decide([text], code)
    monkeypatch.setattr(context_mixing, "TOGETHER", 1000)
    parts = [context_mixing.decide([part], code, skip, ended) for part, skip, ended in context_mixing.segments_of(text)]
    assert len(parts) > 20
    for name in ("slots", "bits", "gates"):
        assert np.array_equal(np.concatenate([getattr(d, name) for d in parts]), getattr(whole, name))
    for odd in (b"", b" " * 5000, b"x" * 5000, b"ab " + b"y" * 3000 + b" z", b"\0"):
        found = list(context_mixing.segments_of(odd))
        assert b"".join(part[skip:] for part, skip, _ in found) == odd.replace(b"\0", b"")
        assert [ended for *_, ended in found] == [False] * (len(found) - 1) + [True]
