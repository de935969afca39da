from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import crc, rows
from tickloom.llm import bpe, components, exactdup, langid, license, lmscore, mixing, neardup, packing, search, substring, tokencount

BYTES, WORDS, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
OPERATORS = {
    "near": neardup.near_duplicates,
    "language": lambda d: langid.identify(d, PIECES),
    "lm": lmscore.lm_scores,
    "license": license.license_scan,
    "mixing": mixing.mix_documents,
    "substring": substring.remove_repeats,
    "exact": exactdup.exact_duplicates,
    "packing": lambda d: packing.pack(d, WORDS),
    "tokens": lambda d: tokencount.token_counts(d, BYTES),
    "search": lambda d: search.search(d, d.select("doc_id", "text").withColumnRenamed("doc_id", "query_id")),
}


def words(text, lower=True):
    data = (text or "").encode()
    return [w.decode() for w in (data.lower() if lower else data).split()]


def frame(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(none, name):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(odd, clashing, name):
    def told(d):
        return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in OPERATORS[name](d).collect())

    if name == "packing":  # windows depend on the order of rows within partitions
        assert OPERATORS[name](odd).groupBy().sum("length").first() == OPERATORS[name](clashing).groupBy().sum("length").first()
    else:
        assert told(odd) == told(clashing)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"packing", "search"}))
def test_one_row_per_document(odd, name):
    assert sorted(map(repr, (r["doc_id"] for r in OPERATORS[name](odd).select("doc_id").collect()))) == sorted(repr(r[0]) for r in rows())


def test_near_duplicates_against_brute_force(odd):
    def shingles(t):
        w = words(t)
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    docs = [(r[0], shingles(r[1])) for r in rows()]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, s in docs:
        for j, t in docs:
            if i is not None and j is not None and i < j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = frame(neardup.near_duplicates(odd))
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == top(r["doc_id"]), r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    size = collections.Counter((r["doc_id"], r["n_shingles"]) for r in got)
    assert size == collections.Counter((i, len(s)) for i, s in docs)


@pytest.mark.parametrize("docs,shingles", [(2048, 1 << 20), (3, 1 << 20), (2048, 2000)])
def test_a_template_crowd_against_brute_force(spark, monkeypatch, docs, shingles):
    """One bucket of texts on a template, just unlike; links are between late ids, after a star that finds none."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", docs)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    r = random.Random(5)
    template = [f"w{k}" for k in range(400)]

    def changed(base, name, n):
        own = list(base)
        for i in r.sample(range(0, 400, 5), n):
            own[i] = f"{name}_{i}"
        return own

    texts = [changed(template, f"own{k}", 8) for k in range(40)]
    texts += [changed(texts[k], f"copy{k}", 10) for k in range(30, 40)]
    least = neardup.signatures(*neardup.shingle_sets(pa.array([" ".join(t) for t in [template, *texts]])), 1)[:, 0]
    texts = [t for t, x in zip(texts, least[1:], strict=True) if x == least[0]]
    sets = [{tuple(t[i : i + 5]) for i in range(396)} for t in texts]
    links = [(j, i) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    top = list(range(len(texts)))
    for i, j in links:
        low, high = sorted((top[i], top[j]))
        top = [low if x == high else x for x in top]
    assert len(links) >= 3 and min(i for i, _ in links) >= 2
    got = frame(neardup.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), bands=1, rows=1))
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(top))


def test_a_large_template_crowd_keeps_every_link(spark):
    """Hundreds of texts at a similarity just below the share, with links among them that no hub has."""
    r = random.Random(8)
    template = [f"w{k}" for k in range(300)]

    def changed(base, name, n):
        own = list(base)
        for i in r.sample(range(0, 300, 5), n):
            own[i] = f"{name}_{i}"
        return own

    texts = [changed(template, f"own{k}", 7) for k in range(400)]
    texts += [changed(texts[k], f"copy{k}", 7) for k in range(250, 400)]
    sets = [{tuple(t[i : i + 5]) for i in range(296)} for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if top[i] != top[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    assert 50 < len(set(top)) < len(top) - 50
    got = frame(neardup.near_duplicates(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")))
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(top))


def test_rows_without_an_id_are_judged_by_their_own_text(spark):
    t, u, v = "one two three four five six", "seven eight nine ten eleven", "a b c d e f g"
    schema = "doc_id long, text string"
    kept = lambda data: sorted(map(repr, (tuple(r) for r in neardup.keep_one(spark.createDataFrame(data, schema)).collect())))
    assert kept([(1, t), (None, t), (None, u)]) == ["(1, '%s')" % t, "(None, '%s')" % u]
    assert kept([(None, t), (None, t.upper()), (2, u), (3, u), (3, v)]) in ([repr((2, u)), repr((3, v)), repr((None, x))] for x in (t, t.upper()))


def test_a_family_whose_original_is_not_its_hub(spark):
    """Copies of one text that are like it but not like one another, all with smaller ids than it."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    data = []
    for k in range(30):
        own = list(base)
        for i in r.sample(range(0, 400, 5), 11):
            own[i] = f"new{k}_{i}"
        data.append((k, " ".join(own)))
    data.append((99, " ".join(base)))
    got = frame(neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {x["component_id"] for x in got} == {0}


def test_signatures_estimate_similarity():
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(600)]
    other = [w if r.random() > 0.02 else "new" for w in base]
    bounds, sets = neardup.shingle_sets(pa.array([" ".join(base), " ".join(other)]))
    a, b = (set(sets[bounds[k] : bounds[k + 1]].tolist()) for k in range(2))
    samples = neardup.signatures(bounds, sets, 1024)
    assert abs((samples[0] == samples[1]).mean() - len(a & b) / len(a | b)) < 0.08


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_languages_are_told_apart_on_held_out_documents(spark):
    from tests.llm.conftest import prose

    data = [(k, prose(k, 25, "en" if k % 2 else "de"), "en" if k % 2 else "de") for k in range(300)]
    got = frame(langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), PIECES))
    want = {i: lang for i, _, lang in data}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and all(r["lang_pred"] == want[r["doc_id"]] for r in held)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)


def test_no_letters_is_und(odd):
    got = {r["doc_id"]: r for r in frame(langid.identify(odd, PIECES))}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (4, 5, 6, 7))


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba"])
    p = np.array([[0.1, 0.2, 0.3, 0.15, 0.05, 0.07, 1e-7]])
    nodes, size, groups = lattice.arcs(["ab", "aba", "az"])
    got = langid.forward(nodes, size, groups, p)[0, nodes + size]
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.3, "ab": 0.15, "▁a": 0.05, "ba": 0.07}

    def brute(w):
        return 1.0 if not w else sum(brute(w[n:]) * (pieces.get(w[:n], 1e-7 if n == 1 else 0)) for n in range(1, len(w) + 1))

    assert np.allclose(got, [brute("▁ab"), brute("▁aba"), brute("▁az")])


def test_predictions_against_a_plain_forward_algorithm(odd):
    pieces, langs, p = langid.fitted(odd, PIECES)
    number = {x: k for k, x in enumerate(pieces)}
    assert langs == sorted({r[2] for r in rows() if r[2] and r[0] is not None and crc(r[0], 4) != 2})

    def likely(word, q):
        marked = langid.MARK + word
        sums = [1.0] + [0.0] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(end):
                if (k := number.get(marked[start:end])) is not None:
                    sums[end] += sums[start] * q[k]
            if marked[end - 1] not in number:
                sums[end] += sums[end - 1] * langid.UNKNOWN
        return math.log(sums[-1])

    def plain(text):
        found = ["".join(c for c in w if c.isalpha()) for w in re.findall(r"[^\W\d_]{1,24}", (text or "").lower())]
        found = [w for w in found if w]
        if not found:
            return "und", 0.0
        total = [sum(n * likely(w, q) for w, n in collections.Counter(found).items()) for q in p]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)

    got = sorted(frame(langid.identify(odd, PIECES)), key=lambda r: (str(r["doc_id"]), r["lang_pred"], r["score"]))
    want = sorted(((r[0], *plain(r[1])) for r in rows()), key=lambda w: (str(w[0]), w[1], w[2]))
    for r, (i, lang, score) in zip(got, want, strict=True):
        assert (r["doc_id"], r["lang_pred"]) == (i, lang) and math.isclose(r["score"], score, rel_tol=1e-6, abs_tol=1e-9)
        assert r["held_out"] == (None if i is None else crc(i, 4) == 2)


def test_base_scores_and_gain_of_the_class_model(odd):
    docs = [(r[0], [*words(r[1]), None]) for r in rows()]
    c = collections.Counter(w for i, t in docs if i is not None and crc(i, 5) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    got = sorted(frame(lmscore.lm_scores(odd)), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    for r, (i, t) in zip(got, sorted(docs, key=lambda d: (str(d[0]), len(d[1]))), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0
    small = frame(lmscore.lm_scores(odd, lmscore.Settings(head=5, symbols=3)))  # almost all words outside the head
    assert sorted(round(r["base_score"], 8) for r in small) == sorted(round(r["base_score"], 8) for r in got)


@pytest.mark.parametrize("how", [lmscore.Settings(), lmscore.Settings(head=20, symbols=6, pools=5, classes=4)])
def test_class_scores_against_brute_force(odd, how):
    """Given each word's class, the counts and the score of every text, word by word."""
    texts = [["\n", *words(r[1]), "\n"] for r in rows()]
    learned = [t for t, r in zip(texts, rows(), strict=True) if r[0] is not None and crc(r[0], 5) != 1]
    train = odd.where("doc_id is not null").selectExpr("text", "doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) as part").where("part <> 1").selectExpr("coalesce(text, '') as text")
    model = lmscore.learn(train, lmscore.word_totals(train), how)
    number = {w: k for k, w in enumerate(model.symbols.head.to_pylist())}
    end = how.classes
    pool = lambda w: int(model.of[model.symbols.of(pa.array([w]))[1][0]])
    kind = lambda w: end if w == "\n" else int(model.of_head[number[w]]) if w in number else pool(w)
    c = collections.Counter(w for t in learned for w in t[1:])
    size, kinds = collections.Counter(), collections.Counter()
    for w, n in c.items():
        size[kind(w)] += n
        kinds[kind(w)] += 1
    steps = collections.Counter((kind(a), kind(b)) for t in learned for a, b in zip(t, t[1:]))
    after = collections.Counter()
    for (a, _), n in steps.items():
        after[a] += n

    def score(t):
        out = 0.0
        for a, b in zip(t, t[1:]):
            alone = (size[kind(b)] + 0.5) / (sum(size.values()) + 0.5 * (how.classes + 1))
            pair = steps[kind(a), kind(b)] / after[kind(a)] if after[kind(a)] else alone
            out += math.log10(how.mixed * pair + (1 - how.mixed) * alone)
            if b != "\n":
                out += math.log10((c[b] + 0.5) / (size[kind(b)] + 0.5 * (kinds[kind(b)] + 1)))
        return out

    got = sorted(round(r["score"], 6) for r in frame(lmscore.lm_scores(odd, how)))
    assert got == pytest.approx(sorted(round(score(t), 6) for t in texts), abs=2e-6)


def test_a_word_joins_the_class_of_words_with_its_contexts():
    table = np.array([[0.0, 40, 1], [40, 0, 1], [1, 1, 0]])
    into, out = np.array([[6.0, 0, 0], [0, 6, 0]]), np.array([[6.0, 0, 0], [0, 6, 0]])
    assert lmscore.best_class(into, out, table, np.array([0, 0])).tolist() == [1, 0]


def test_exchange_separates_alternating_words():
    n = 9
    pairs = np.zeros((n, n), np.int64)
    for a in range(4):
        for b in range(4, 8):
            pairs[a, b] = pairs[b, a] = 10
    of = lmscore.exchange(pairs, 2, 10)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 2


def test_license_base_places(odd):
    for r in frame(license.license_scan(odd)):
        for i, t, *_ in rows():
            if i == r["doc_id"] and i is not None:
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
                at = [(k, lab) for p, lab in license.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
                assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({a[1] for a in at})))
                assert (r["first_word"], r["last_word"]) == (min((a[0] for a in at), default=None), max((a[0] for a in at), default=None))
                assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules():
    scan = lambda t: set(filter(None, license.scan(t.encode())[5].split(",")))
    assert scan("Licensed under the Apache License, Version 2.0 (the License)") == {"apache-2.0"}
    assert scan("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3.0"}
    assert scan("permission to use, the expat license") == {"mit"}
    assert scan("nothing of the kind") == set()
    assert len(license.RULES) >= 200
    spans = license.scan(b"under the GNU Lesser General Public License, version 2.1")[7]
    assert [s[2] for s in spans] == ["lgpl-2.1"] or {"lgpl-2.1"} <= {s[2] for s in spans}


def test_suppression_is_interval_containment():
    r = random.Random(3)
    for _ in range(200):
        found = [(s := r.randrange(20), s + 1 + r.randrange(6), r.randrange(3), k) for k in range(r.randrange(12))]
        rank = lambda f: (-f[2], -(f[1] - f[0]), f[0], f[3])
        stay = []
        for f in sorted(found, key=rank):
            if not any(g[0] <= f[0] and g[1] >= f[1] for g in stay):
                stay.append(f)
        assert sorted(found[k] for k in license.suppress(found)) == sorted(stay)


def test_mixing_meets_its_marginals(spark):
    from tests.llm.conftest import prose

    data = [(k, prose(k, 20 + (k * 37) % 500, "en"), ("en", "de")[k % 5 == 0], f"s{k * 7 % 11 % 3}") for k in range(150)]
    got = frame(mixing.mix_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    total = sum(r["n_tokens"] for r in got)
    for label, power in (("source", 0.7), ("lang", 0.7), ("topic", 0.8)):
        have = collections.Counter()
        told = collections.Counter()
        for r in got:
            have[r[label]] += r["n_tokens"]
            told[r[label]] += r["n_tokens"] * r["weight"]
        share = {k: v**power if v else 0.0 for k, v in have.items()}
        for k in have:
            assert math.isclose(told[k] / total, share[k] / sum(share.values()), abs_tol=1e-4), (label, k)
    assert all(0 <= r["probability"] <= 1 for r in got)


@pytest.mark.parametrize("pairs,rounds", [(2048, 60), (1, 3)])
def test_raking_against_brute_force(spark, monkeypatch, pairs, rounds):
    monkeypatch.setattr(mixing, "MOST_PAIRS", pairs)  # by the driver's factors, and in tables
    cells = {(s, l, t): 1 + (7 * i + 3 * j + 5 * k) % 11 for i, s in enumerate(("a", "b", None)) for j, l in enumerate(("en", None)) for k, t in enumerate(("x", "y"))}
    narrow = spark.createDataFrame([(*k, v) for k, v in cells.items()], "src string, lng string, top string, tokens long")
    found, scale = mixing.fit(narrow, mixing.Mix(source_shares={"a": 2.0}, lang_shares={"en": 40.0}, rounds=rounds))
    got = {(r["src"], r["lng"], r["top"]): r["weight"] for r in found.collect()}
    w = {k: float(v) for k, v in cells.items()}
    total = sum(w.values())
    marks = {axis: {x: sum(v for k, v in cells.items() if k[axis] == x) ** power for x in {k[axis] for k in cells}} for axis, power in ((0, 0.7), (1, 0.7), (2, 0.8))}
    marks[0]["a"], marks[1]["en"] = 2.0, 40.0
    for _ in range(rounds):
        for axis, want in ((x, marks[x]) for x in (1, 2, 0)):
            z = sum(want.values())
            for label, x in want.items():
                part = sum(v for k, v in w.items() if k[axis] == label)
                for k in w:
                    if k[axis] == label:
                        w[k] *= total * x / z / part
    for k, v in cells.items():
        assert math.isclose(got[k] * v, w[k], rel_tol=1e-4)
    assert math.isclose(sum(v * min(1, got[k] * scale) for k, v in cells.items()), 0.6 * total, rel_tol=1e-9)


def test_a_tiny_source_does_not_shrink_the_others(spark):
    data = [(k, "w " * 100, "en", "big") for k in range(400)] + [(1000 + k, "w", "en", f"tiny{k}") for k in range(3)]
    got = frame(mixing.mix_documents(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    expected = sum(r["n_tokens"] * r["probability"] for r in got)
    assert math.isclose(expected, 0.6 * sum(r["n_tokens"] for r in got), rel_tol=1e-6)
    assert all(r["probability"] == 1 for r in got if r["source"] != "big")


@pytest.mark.parametrize("how", [
    search.Settings(tasks=3, shard_docs=8, block=2, k=3, frequent=30, batch=5),
    search.Settings(tasks=1, shard_docs=1000, block=4, k=5, frequent=4, broadcast_pairs=300),
    search.Settings(tasks=2, shard_postings=50, held_postings=120, block=3, k=1, frequent=10_000),
    search.Settings(),
])
def test_search_against_brute_force(odd, how):
    """BM25 over all distinct words of every query, by whatever shards, blocks and turns."""
    asked = odd.where("doc_id % 4 = 0").selectExpr("doc_id as query_id", "text")
    got = collections.defaultdict(list)
    for r in search.search(odd, asked, how).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    docs = [(i, collections.Counter(words(t))) for i, t, *_ in rows() if i is not None and t is not None]
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    df = collections.Counter(w for _, c in docs for w in c)
    idf = {w: math.log(1 + (len(docs) - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    for q in {i for i, _ in docs if i % 4 == 0}:
        terms = {w for i, c in docs if i == q for w in c}
        scored = [(i, sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(terms) if w in c)) for i, c in docs]
        want = sorted((-round(x, 6), i) for i, x in scored if x > 0)[: how.k]
        assert [(-x, i) for i, x in got[q]] == want


@pytest.mark.parametrize("pairs", [8_000_000, 300])
def test_search_in_rounds_finds_the_same(odd, monkeypatch, pairs):
    """Rounds begin with the k-th best of those before, take each document once and leave out no result."""
    asked = odd.where("doc_id % 4 = 0").selectExpr("doc_id as query_id", "text")
    want = sorted(map(tuple, search.search(odd, asked, search.Settings(k=3)).collect()))
    real, least = search._kth, []
    monkeypatch.setattr(search, "_kth", lambda *a: [least.append(b.value) or b for b in real(*a)])
    how = search.Settings(tasks=2, k=3, shard_docs=8, block=2, broadcast_pairs=pairs, round_growth=2, first_round=10)
    got = sorted(map(tuple, search.search(odd, asked, how).collect()))
    assert len(least) >= 2 and any((x > 0).any() for x in least)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_thresholds_of_earlier_rounds_spare_blocks():
    """With the k-th score of earlier rounds, a shard scores no block that stays below it."""
    r = np.random.default_rng(4)
    parts = [(np.arange(400), np.full(400, 10), np.repeat(np.arange(400), 10), np.concatenate([np.sort(r.choice(60, 10, replace=False)) for _ in range(400)]), np.ones(4000, np.int64))]
    how = search.Settings(block=20, frequent=60, k=3)
    shard = search.Shard(parts, np.ones(60), 10.0, how)
    found = []
    for least in (None, np.array([100.0])):
        best = search.Best(search.Queries(np.array([7]), np.array([0, 10]), np.arange(10, dtype=np.int32), np.arange(60), np.ones(60), least), how)
        shard.ask(best, how)
        found.append(sum(len(x[0]) for x in best.held))
    assert found[0] > 0 and found[1] == 0


def test_blocks_below_the_threshold_are_not_scored():
    """Texts of two kinds: a query of one kind takes no sums over blocks of the other, and finds the best."""
    r = np.random.default_rng(3)
    n, terms = 400, 60
    kind = np.arange(n) % 2
    parts = [(np.arange(n), np.full(n, 10), np.repeat(np.arange(n), 10), np.concatenate([k * 30 + np.sort(r.choice(30, 10, replace=False)) for k in kind]), np.ones(10 * n, np.int64))]
    how = search.Settings(block=20, frequent=terms, k=3)
    shard = search.Shard(parts, np.ones(terms), 10.0, how)
    queries = search.Queries(np.array([7]), np.array([0, 10]), np.arange(30, 40, dtype=np.int32), np.arange(terms), np.ones(terms))
    scored = []

    class Dense(np.ndarray):
        def __getitem__(self, at):
            scored.append(at)
            return np.asarray(super().__getitem__(at))

    shard.dense = shard.dense.view(Dense)
    best = search.Best(queries, how)
    shard.ask(best, how)
    best.settle()
    assert 0 < len(scored) <= 15 and (best.docs[0] % 2 == 1).all()


def test_terms_that_share_a_hash_are_hashed_anew(odd, monkeypatch):
    """With a hash that lets all terms clash at first, results stay those of BM25."""
    asked = odd.where("doc_id % 4 = 0").selectExpr("doc_id as query_id", "text")
    want = sorted(map(tuple, search.search(odd, asked).collect()))
    real = search.term_counts
    seeds = []

    def clashing(rows, seed):
        seeds.append(seed)
        found = real(rows, seed)
        return found.selectExpr("kind", "code", "n", "low - 1 as low", "high") if seed == 0 else found

    monkeypatch.setattr(search, "term_counts", clashing)
    got = sorted(map(tuple, search.search(odd, asked).collect()))
    assert seeds == [0, 1] and [g[:3] for g in got] == [w[:3] for w in want]


@pytest.mark.parametrize("text", [b"(c) 2019 Jane Doe", b"(C) 1998 Acme", b"copyright 2019 Jane Doe"])
def test_every_copyright_form_passes_its_gate(text):
    assert "copyright" in license.scan(text)[5]


def test_substrings_against_brute_force(odd):
    docs = [(r[0], words(r[1], lower=False)) for r in rows()]
    least = {}
    for i, w in docs:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, 1 << 70), 1 << 63 if i is None else i)
    want = collections.Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < (1 << 63 if i is None else i):
                gone |= set(range(k, k + 50))
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    for hot in ((200, 50_000), (1, 50_000), (1, 2)):
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame(substring.remove_repeats(odd, hot=hot)))
        assert got == want
    assert any(k[2] for k in want)


def test_exact_duplicates_against_brute_force(odd):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = collections.Counter()
    for i, t, *_ in rows():
        best = min(groups[norm(t)])
        want[(i, best[3], len(groups[norm(t)]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame(exactdup.exact_duplicates(odd)))
    assert got == want
    unchecked = exactdup.recipes(odd.select("doc_id", "text"), verified=False)
    assert unchecked.select("recipe").distinct().count() == len(groups)


def test_packing_is_an_exact_round_trip(odd):
    import zlib

    tokenizer = Tokenizer.from_file(WORDS)
    ids = {}
    for i, t, *_ in rows():
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        ids.setdefault(i, []).append(np.array(own, "<u4"))
    pieces = frame(packing.pack(odd, WORDS))
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in ids[p["doc_id"]])
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0 and at == own[0]["context"]
    one = [p for p in pieces if p["doc_id"] == 11]
    assert sorted((p["start"], p["start"] + p["length"]) for p in one)[0][0] == 0 and sum(p["length"] for p in one) == one[0]["doc_tokens"]


def test_packer_keeps_every_token_over_blocks():
    r = random.Random(4)
    packer, out = packing.Packer((64, 32, 16)), []
    sizes = [r.randrange(1, 200) for _ in range(500)]
    for k, n in enumerate(sizes):
        packer.add(k, n, out)
        if k % 37 == 0:
            packer.flush(out, False)
    packer.flush(out, True)
    seen = collections.defaultdict(list)
    for size, window in out:
        assert sum(w[2] for w in window) == size and size & (size - 1) == 0 and size <= 64
        for d, s, n in window:
            seen[d].append((s, n))
    for k, n in enumerate(sizes):
        at = 0
        for s, m in sorted(seen[k]):
            assert s == at
            at += m
        assert at == n


def test_token_counts_are_the_librarys(odd):
    tokenizer = Tokenizer.from_file(BYTES)
    want = collections.Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "").ids), len(tokenizer.encode(t or "").ids) > 512) for i, t, *_ in rows())
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in frame(tokencount.token_counts(odd, BYTES))) == want


def test_step_groups_hold_equal_tokens_over_all_partitions(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "concat_ws(' ', sequence(1, cast(1 + (id * id) % 900 as int))) as text").repartition(7)
    got = packing.pack(docs, WORDS, group_tokens=4 * 4096).toPandas()
    windows = got.groupby("sequence_id").agg(context=("context", "first"), tokens=("length", "sum"), groups=("step_group", "nunique"), step_group=("step_group", "first"))
    assert (windows["tokens"] == windows["context"]).all() and (windows["groups"] == 1).all()
    sums = windows.groupby("step_group").agg(size=("context", "first"), sizes=("context", "nunique"), tokens=("tokens", "sum"))
    assert (sums["sizes"] == 1).all() and (sums.groupby("size")["tokens"].apply(lambda t: (t != 4 * 4096).sum()) <= 1).all() and (sums["tokens"] <= 4 * 4096).all()
    assert len(sums[sums["size"] == 4096]) > 7  # more groups than partitions, none cut short by one
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_both_tokenizers_on_odd_texts():
    r = random.Random(1)
    parts = [*"abstST'  \n\t\r.!12²½éßªÉ \x85\x1c\x1fµ<´ÀÞ中文😀　Σİ", "'s", "'LL", "'re", " '", "aaaa", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(4000)] + ["a" * 1000, "ab" * 800, "", "\n" * 50]
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    assert tokencount.count_texts(texts, BYTES).tolist() == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]
    bounds, ids = packing.encode_texts(texts, WORDS)
    assert all(ids[bounds[k] : bounds[k + 1]].tolist() == e.ids for k, e in enumerate(word.encode_batch(texts, add_special_tokens=False)))


def test_overlapping_pairs_merge_from_the_left():
    model = bpe.RaggedBpe(BYTES)
    for word in ("aaaaa", "ababab", "!!!!!!!"):
        want = Tokenizer.from_file(BYTES).encode(word).ids
        assert model.encode([word.encode()], latin1=False, want_ids=True)[1].tolist() == want
