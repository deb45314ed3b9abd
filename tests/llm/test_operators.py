"""Small tables with nulls, repeats and clashing columns, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, langid, linededup, neardup, neighbours, packing, token_counts, toxicity, urlfilter

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "po") for b in ("ra", "si", "tu", "ve", "wo", "xa")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 60) for _ in range(30)]
    texts += [t + " extra" for t in texts[:10]] + texts[:5] + [None, "", "one", "one", "  "]
    return spark.createDataFrame([(k, t, "en", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, lang string, node long, key long")


def shingle_set(text, width):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def test_neardup(spark, docs):
    rows = {r["doc_id"]: r for r in neardup.link_documents(docs).collect()}
    sets = {r["doc_id"]: shingle_set(r["text"], 4) for r in docs.collect()}
    root = {k: k for k in sets}
    for _ in range(5):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert {k: r["component_id"] for k, r in rows.items()} == root
    assert {k: r["n_shingles"] for k, r in rows.items()} == {k: len(s) for k, s in sets.items()}
    assert neardup.link_documents(docs.limit(0)).count() == 0


def components(sets, percent=80):
    """The smallest id that each of {id: set} can reach, by comparing all pairs."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def test_neardup_template_family(spark):
    """Pairs over one template (pair similarity 0.93, across 0.77): large buckets of many components."""
    rng = random.Random(11)
    template, second = ([f"{x}{k}" for k in range(105)] for x in "ts")
    texts = []
    for k in range(150):
        own = [f"own{k}x{j}" for j in range(15)]
        texts += [" ".join(template + own), " ".join(template + own[:-1] + [f"other{k}"])]
    texts += [" ".join(second[:100] + [f"n{rng.randrange(40)}" for _ in range(rng.randrange(4, 30))]) for _ in range(150)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = components({k: shingle_set(t, 4) for k, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in neardup.link_documents(d).collect()} == want
    assert len(set(want.values())) > 160


def test_drop_near_duplicates(spark):
    long = " ".join(f"word{k % 700}" for k in range(60_000))
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " end", "b"), (3, "one two", "c"), (4, "one two", "d"), (5, None, "e"), (6, "", "f"), (None, "x y z", "g"), (None, "x y z", "h"), (None, "q", "i"), (7, None, "j")]
    d = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("_m_id", F.lit(1))
    kept = neardup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (True, 0), (True, 0)]


def test_viterbi():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 4, (300, 3)).astype(np.float32)
    bounds = np.array([0, 200, 200, 203, 300])
    path = langid.viterbi(scores, bounds, 3.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        best = scores[a].astype(float).copy()
        for t in range(a + 1, b):
            best = np.array([max(best[j] - 3.0 * (i != j) for j in range(3)) for i in range(3)]) + scores[t]
        got = sum(scores[t, path[t]] for t in range(a, b)) - 3.0 * sum(path[t] != path[t - 1] for t in range(a + 1, b))
        assert math.isclose(got, best.max(), rel_tol=1e-4)


def test_language(spark):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("пёс и кот", "ru")] * 8)] + [(99, None, "en"), (98, "123 !", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    found = {r["doc_id"]: r for r in langid.identify(d, model, with_spans=True).collect()}
    assert all(found[k]["lang_pred"] == l for k, _, l in rows[:24])
    assert found[99]["lang_pred"] == found[98]["lang_pred"] == "und" and found[99]["score"] == 0
    mixed = langid.identify(spark.createDataFrame([(1, "the cat and the dog and the cat пёс и кот пёс и кот", "x")], d.schema), model, with_spans=True).first()
    assert [s["lang"] for s in mixed["spans"]] == ["en", "ru"] and mixed["lang_pred"] == "en"
    assert langid.identify(d, langid.fit(d.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_of_far_letters_and_many_languages(spark):
    rows = [(k, chr(0x61 + k % 26) * 3 + chr(0x61 + k // 26) * 4 + " " + chr(0x3B1 + k % 20) * 2, f"l{k:03d}") for k in range(200)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, model).collect()}
    assert len(model[0]) == 200 and all(x in model[0] for x in found.values())
    odd = spark.createDataFrame([(1, "\U0001D400 \U0001D401"), (2, "123 \U000E0100\U000E0041"), (3, "word " * 3_000), (3, "word")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"] == "und") for r in langid.identify(odd, model).orderBy("doc_id").collect()]
    assert got == [(1, False), (2, True), (3, False), (3, False)]
    assert len(langid.fit(d, languages=5)[0]) == 5


def test_line_dedup(spark):
    shared = "\n".join(f"shared line number {k} here" for k in range(12))
    texts = [f"a{k}\nb{k}\n{shared}\nc{k}" for k in range(4)] + [None, "", "\n\n\n", "\n\n\n", "solo\nx"]
    d = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, gone string")
    found = {r["doc_id"]: r for r in linededup.drop_repeated_lines(d).collect()}
    assert found[0]["text"] == texts[0] and len(found[1]["text"]) < len(texts[1]) and "a1" in found[1]["text"]
    assert [found[k]["text"] for k in (4, 5, 6, 7, 8)] == texts[4:] and found[0]["gone"] == "s"


def test_passages_go_whole(spark):
    """Against a plain loop, and planted passages of 2 to 10 lines between foreign lines."""
    rng = random.Random(12)
    passages = [[f"passage {n} line {k} {rng.random()}" for k in range(n)] for n in range(2, 11)]
    texts, own = [], []
    for k in range(40):
        own.append([f"own {k} {j}" for j in range(12)])
        planted = dict(zip(rng.sample(range(12), 3), rng.sample(passages, 3)))
        texts.append("\n".join(line for j, x in enumerate(own[k]) for line in (*planted.get(j, []), x)))
    texts[0] = "\n".join(line for p in passages for line in (*p, "apart " + p[0]))
    texts += ["a\na\na", "b\nb\nb\nb\nb", "a\na\nz", "solo", "", "\n\n\n", "\n\n\n", None, texts[3]]
    d = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, _gone2 string")
    seen, want = {}, {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        out = set()
        for i in range(len(lines) - 1):
            if (lines[i] + lines[i + 1]).strip():
                first = seen.setdefault((lines[i], lines[i + 1]), (k, i))
                if first not in ((k, i), (k, i - 1)):
                    out |= {i, i + 1}
        want[k] = t and "\n".join(x for i, x in enumerate(lines) if i not in out)
    found = {r["doc_id"]: r for r in linededup.drop_repeated_passages(d).collect()}
    assert {k: r["text"] for k, r in found.items()} == want
    assert all(found[k]["text"].split("\n") == own[k] for k in range(1, 40)) and found[48]["lines_out"] == 0
    assert [found[k]["text"] for k in (40, 41, 42)] == ["a\na\na", "b\nb", "z"]


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, 20) + (" vile" if k % 3 == 0 else "") + (". the women spoke" if k % 6 == 0 else ""), int(k % 3 == 0)) for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d)
    new = [(1, "women"), (2, "men"), (3, "vile"), (4, None), (5, "")]
    s = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    loose = toxicity.fit(d, fairness=0.0)
    t = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), loose).collect()}
    assert s[3] > 0.5 and s[4] == s[5] < 0.5 and abs(s[1] - s[2]) < abs(t[1] - t[2])
    assert toxicity.score(d, toxicity.fit(d.limit(0))).where("score > 0.01").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = [rng.normal(size=4).tolist() for _ in range(300)]
    x[7] = x[8] = x[100]
    x[50], x[51], x[52], x[53] = None, [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0]
    d = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(d, F.col("vec_id") % 100 == 0, probes=1000, leaf=8).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 100, 200):
        near = sorted((math.dist(x[q], x[k]), k) for k in range(300) if k != q and k not in (50, 51, 52, 53))[:10]
        want += [(q, r, k) for r, (_, k) in enumerate(near, 1)]
    assert got == want and neighbours.nearest(d.limit(0), F.lit(True)).count() == 0


def test_neighbours_beyond_the_probes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(d, F.col("vec_id") % 100 == 0, trees=2, leaf=16, probes=4).collect()}
    want = {}
    for q in range(0, 3000, 100):
        near = np.argsort(np.sqrt(((x - x[q]) ** 2).sum(axis=1)))[1:11]
        want |= {(q, r): int(k) for r, k in enumerate(near, 1)}
    assert got == want


def test_neighbours_of_repeated_ids(spark):
    rows = [(1, [1.0, 2.0])] * 12 + [(k, [1.0, 2.0]) for k in range(2, 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("vec_id") == 7, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_decontaminate(spark):
    rng = random.Random(6)
    items = [sentence(rng, n) for n in (20, 35, 58)]
    texts = [sentence(rng, 80) for _ in range(6)]
    texts[1] += " " + items[0] + " " + sentence(rng, 30)
    texts[2] = items[1]
    texts[3] = sentence(rng, 13) + " " + items[2].upper() + " tail"
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, d string")
    b = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()} == {0, 4, 5, 6, 7}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0


def test_decontaminate_altered_passages(spark):
    """Parts and interleaved copies of items, against all windows of all pairs."""
    rng = random.Random(13)
    items = [[f"i{k}w{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate((12, 17, 25, 40, 40, 63, 90))]
    items[4] = items[4][:8] * 5
    own = lambda n: [f"own{rng.randrange(500)}" for _ in range(n)]
    texts = []
    for item in items:
        n = len(item)
        for share in (1.0, 0.9, 0.86, 0.84, 0.8, 0.7):
            part = max(1, round(share * n))
            texts += [own(33) + item[:part] + own(21), own(9) + item[n - part :] + own(30)]
        middle = n // 2
        texts += [own(7) + item[:middle] + own(max(2, n // 8)) + item[middle:] + own(5), own(7) + item[:middle] + own(2 * n) + item[middle:], item[:8] * 3 + own(4)]
    cut = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            s = cut(item)
            size = math.ceil(len(item) * 1.05)
            span = size + 2 * max(2, math.ceil(size * 0.2)) - 4
            here = cut(t)
            best = max(sum(min(here[a : a + span].count(x), s.count(x)) for x in set(s)) for a in range(len(here)))
            if 100 * best >= 80 * len(s):
                want[d, i] = best / len(s)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    for some in ([*range(len(items))], [2], [5]):
        bench = spark.createDataFrame([(i, " ".join(items[i])) for i in some], "item_id long, text string")
        found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()}
        assert found == {k: v for k, v in want.items() if k[1] in some}
    assert len(want) > 50


def test_packing(spark, docs):
    rows = packing.pack(docs, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    m = np.random.default_rng(1).integers(0, 5, (20, 20)) + np.eye(20) * 9
    assert np.allclose(packing.inverted(m) @ m, np.eye(20))


def test_url_filter(spark):
    urls = [(1, "https://www.Example.com/en/1", "allow"), (2, "http://a.example.com/en/2?x=1", "block"), (3, "http://q.net/es/3#t", "block"), (4, "http://q.com", "allow"), (5, None, "allow"), (6, "no scheme", "allow"), (7, "http://z.com/", "allow")]
    d = spark.createDataFrame([(k, u, "t") for k, u, _ in urls], "page_id long, url string, tokens string")
    found = {r["page_id"]: r for r in urlfilter.judge(d).collect()}
    assert [found[k]["rule"] for k in range(1, 8)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, "com/"]
    assert [found[k]["verdict"] for k in (1, 2, 3, 7, 5)] == ["allow", "block", "block", "allow", "allow"] and found[5]["host"] == found[6]["path"] == ""


def test_url_rules_are_mined_from_other_tokens(spark):
    """The fixed rules' own tokens (en) judge nothing else; 25 tokens that always come together make no 2^25 patterns."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        word = rng.choice(["pills", "casino"] if bad and rng.random() < 0.9 else ["news", "blog"])
        host = f"{word}.example.com" if bad else "www.example.com"
        rows.append((k, f"http://{host}/en/{word}/a1/b2/c3/d4/e5/f6/g7/h8/i9/j10/k11/l12/m13/n14/o15/p16/q17/r18/s19/t20/u21/v22/w23"))
    rows += [(1000, "http://x.org/pills/1"), (1001, "http://x.org/news/1"), (1002, "http://x.org/en/1"), (1003, "http://example.org/" + "long/" * 20_000)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit("t"))
    found = {r["page_id"]: r for r in urlfilter.judge(d).collect()}
    assert [found[k]["verdict"] for k in (1000, 1001, 1002, 1003)] == ["block", "allow", "allow", "allow"]
    assert all("pills" in x for x in found[1000]["matched"])
    assert found[0]["rule"] and urlfilter.judge(d.limit(0)).count() == 0


def test_chat(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "human", None, "x"]), "hi") for c in range(12) for t in range(7)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (2, 256):
        out = chat.repair(d, block=block).orderBy("conv_id", "turn").collect()
        for c in range(12):
            roles = [{"human": "user", "x": None}.get(r, r) for i, _, r, _ in rows if i == c]
            best = min(sum(chat.costs(r)[chat.STATES.index(a), chat.STATES.index(b)] for r, a, b in zip(roles, ("start", *p), p)) for p in itertools.product(chat.STATES[1:], repeat=7))
            mine = [r for r in out if r["conv_id"] == c]
            assert mine[0]["cost"] == best
            p = [r["role"] for r in mine]
            assert sum(chat.costs(r)[chat.STATES.index(a), chat.STATES.index(b)] for r, a, b in zip(roles, ("start", *p), p)) == best
    assert chat.repair(d.limit(0)).count() == 0


def test_token_counts(spark, docs):
    from lectern.llm.tokens import encoder

    encode = encoder(as_text=True)
    want = {r["doc_id"]: len(encode(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_documents(docs, block_ids=16).collect()} == want
