"""The audit against sums over all terms in plain integers."""

import random
import re
from collections import Counter, defaultdict

from lectern.llm import divergence


def plain(rows, least=3, top=200):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    documents, found = defaultdict(Counter), []
    for lang, _, w in words:
        documents[lang].update(set(w))
    for lang in {x[0] for x in words}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        n = {s: Counter(t for l, x, w in words if (l, x) == (lang, s) for t in w) for s in {x[1] for x in words if x[0] == lang}}
        n[None] = Counter(t for l, _, w in words if l == lang for t in w)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in n.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in n:
            if s is None:
                continue
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in n if o is not None and o != s)
            own = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t])[:top]
            found += [(lang, s, part, o.decode(), -v, k + 1) for part, each in (("pair", pairs), ("term", own)) for k, (v, o) in enumerate(each)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, value int").repartition(5)


def test_equal_to_sums_over_all_terms(spark, monkeypatch):
    """Null columns, groups without terms, a language without kept terms, other scripts, ties, and tables handed on early."""
    rng = random.Random(12)
    pool = ["the", "The", "of", "été", "ÉTÉ", "漢字", "x1y", "a-b", *("w%s" % chr(97 + k) * 2 for k in range(20))]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), rng.choice([None, "", " 12 !", " ".join(rng.choices(pool, k=rng.randrange(1, 60)))])) for _ in range(200)]
    rows += [("xx", "a", "only here"), ("xx", "b", None), ("yy", "lone", "w w w"), ("en", "empty", "")]
    rows += [("en", "long", "The long of " * 20_000)] * 2
    docs = table(spark, rows)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(tuple(r) for r in divergence.audit(docs, 1, 2).collect()) == plain(rows, 1, 2)
    assert divergence.audit(docs.limit(0)).count() == 0
