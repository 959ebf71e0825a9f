"""Resampling, source divergence and source mixture against brute force and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF

from ptclake.llm import divergence, mixture, resampling
from ptclake.llm.queries import QUERIES


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def features(text, order=2):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, order=2, percent=25, least=20):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t, order)[1])

    s, t = counts(x for _, x in docs), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(s_all + 10000) / (float(s[b] + 1) * float(t_all + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        words, f = features(text, order)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = Counter((r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100]))
    return rows, drawn


ODD_WORDS = ["a-b_c", "É" * 50 + " " + "é" * 20, "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "9to5 9 TO 5", "日本語" * 30 + " 日本", " nbsp em", "UPPERİ", "one"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_feature_hashes_are_checksums_of_the_runs(order):
    texts = [*ODD_WORDS, "", " ".join(random.Random(3).choices(["a", "bb", "ccc" * 9, "d" * 70], k=200))]
    words, doc, crc = resampling.feature_hashes(pa.array(texts, pa.large_string()), order)
    for i, t in enumerate(texts):
        w, f = features(t, order)
        assert words[i] == len(w)
        assert sorted(crc[doc == i].tolist()) == sorted(zlib.crc32(x.encode()) for x in f)


def test_planes_hold_the_counts():
    docs, buckets = np.array([0] * 9 + [2] * 5 + [3]), np.array([5] * 7 + [130, 6399, 0, 0, 0, 64, 64, 1])
    n, planes = resampling.count_planes(docs, buckets, 5, 100)
    assert n.tolist() == [3, 0, 2, 1, 0]
    bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")
    base = np.cumsum(n) - n
    count = lambda d, b: sum(int(bits[base[d] + j, b]) << j for j in range(n[d]))
    assert [count(0, 5), count(0, 130), count(0, 6399), count(2, 0), count(2, 64), count(3, 1), count(0, 6)] == [7, 1, 1, 3, 2, 1, 0]


@pytest.mark.parametrize("order", [2, 3])
def test_resampling_is_that_of_brute_force(spark, duck, odd_docs, order):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(500 + i, t) for i, t in enumerate(ODD_WORDS)] + duck.sql("select doc_id + 1000, text from documents limit 120").fetchall()
    target = [*[r[0] for r in duck.sql("select text from benchmark").fetchall()], None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, n_words long, planes int, able int")
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), order=order).collect()
    rows, drawn = brute_resample(docs, target, order)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in rows)
    assert Counter((tuple(r)[:4], r["rank"]) for r in got if r["rank"] is not None) == drawn


def test_resampling_query_is_that_of_brute_force(spark, duck):
    docs = duck.sql("select doc_id, text from documents").fetchall()
    rows, drawn = brute_resample(docs, [r[0] for r in duck.sql("select text from benchmark").fetchall()])
    ranks = {r[0]: k for r, k in drawn}
    assert {tuple(r) for r in QUERIES["op11_importance_resampling"](spark, SF).collect()} == {(*r[:4], ranks.get(r[0])) for r in rows}
    assert len(drawn) > 20


def test_resampling_without_texts_or_target(spark, odd_docs, no_docs):
    assert resampling.resample(no_docs, odd_docs).count() == 0
    got = resampling.resample(odd_docs, no_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["weight"] for r in got if r["n_features"] == 0} == {0}


def brute_divergence(docs, least=3, top=200):
    terms = [((lang or "", source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))) for lang, source, t in docs]
    df, n, of_lang = Counter(), Counter(), defaultdict(set)
    for (lang, source), ts in terms:
        of_lang[lang].add(source)
        df.update((lang, t) for t in set(ts))
        n.update((lang, s, t) for t in ts for s in (source, None))
    out = []
    for lang, sources in of_lang.items():
        kept = [t for (x, t), k in df.items() if x == lang and k >= least]

        def shares(s, lang=lang, kept=kept):
            total = sum(n[lang, s, t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[lang, s, t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(s) for s in sources}, shares(None)
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            own = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return out


def test_divergence_is_that_of_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "é", "zz", "日", "q")] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    docs = []
    for k in range(400):
        source = rng.choice(["s1", "s1", "s2", "s3", None, "", "Ω"])
        docs.append((rng.choice(["en", "en", "fr", None]), source, " ".join(rng.choices(vocabulary[: 60 + 40 * (k % 8)], weights=[1 / (i + 1) for i in range(60 + 40 * (k % 8))], k=rng.randrange(60))) + rng.choice(["", "!", " X9Y"])))
    docs += [("en", "none", None), ("en", "none", "123 !"), ("de", "a", None), ("de", "b", "only two"), ("de", "b", "only two"), ("xx", "alone", "word word"), ("yy", "one", "ja nein"), ("yy", "two", "ja ja"), ("yy", "two", "JA")]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "lang string, source string, text string, p long, n int, term string")
    for chunk, cells, tile in ((2048, 1 << 20, 512), (32, 50, 2)):
        monkeypatch.setattr(divergence, "TILE", tile)
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "CELLS", cells)
        for top in (200, 7):
            got = [tuple(r) for r in divergence.divergence(df, top=top).collect()]
            assert sorted(got) == sorted(brute_divergence(docs, top=top))


def test_divergence_of_large_shares(spark):
    """Counts whose products leave 64 bits."""
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 40000000000L AS n, 90000000000L AS total, 1000L AS terms").select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()
    assert row[0] == 1 + 10**9 * (4 * 10**10 + 1) // (9 * 10**10 + 1000)


def test_divergence_on_odd_documents(spark, odd_docs, no_docs):
    assert divergence.divergence(no_docs).count() == 0
    docs = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in divergence.divergence(odd_docs).collect()) == sorted(brute_divergence(docs))


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Rounds over all sources with fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, total, clamped = {s: weights[k % 3] for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        rest = total - sum(epochs * sizes[s] for s in clamped)
        share = {s: Fraction(w[s] * rest, sum(w[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else float(epochs * sizes[s]) for s in order}
        clamped |= over


def check_mixture(rows, docs):
    sizes, taken = Counter(), Counter()
    for _, s, t in docs:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    goal = brute_targets(dict(sizes))
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    sources = defaultdict(set)
    for i, s, t in docs:
        sources[i, len(re.findall("[^\x20\x09-\x0d]+", t or ""))].add(s)
    for r in rows:
        of = [s for s in sources[r["doc_id"], r["size"]] if sizes[s] == r["source_size"] and math.isclose(goal[s], r["target"])]
        assert of and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["whole"] * r["size"] + r["part"]
        if len(of) == 1:
            taken[of[0]] += r["taken"]
    return goal, taken


def test_mixture_reaches_its_targets(spark):
    rng = random.Random(9)
    sizes = {"a": 30, "b": 3000, "c": 40, "d": 5, "Z": 200, "é": 700, None: 20, "": 10}
    docs = [(k, s, "w " * rng.randrange(40)) for k, (s, m) in enumerate((s, m) for s, m in sizes.items() for _ in range(m))]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, source string, text string, size int, target int, start int")
    rows = mixture.mix(df).collect()
    goal, taken = check_mixture(rows, docs)
    assert {s: taken[s] for s in goal} == {s: math.floor(g + 0.5) for s, g in goal.items()}
    assert sorted(rows) == sorted(mixture.mix(df.repartition(7)).collect())
    assert len({(r["source_size"], r["target"] / r["source_size"]) for r in rows if r["target"] == 3 * r["source_size"]}) >= 2
    again = mixture.mix(df, seed=14).collect()
    assert sorted(again) != sorted(rows)


def test_mixed_texts_are_taken_as_said(spark):
    docs = [(1, "a", "one two  three four"), (2, "a", "five\nsix"), (3, "b", "seven " * 40), (4, "b", None), (5, "c", "eight"), (6, "b", "nine ten " * 15)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mixed = mixture.mix(df, keep=("text",)).cache()
    taken = Counter()
    for r in mixture.mixed_texts(mixed).collect():
        taken[r["doc_id"]] += len(r["text"].split())
    assert {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]} == dict(taken)


def test_mixture_on_odd_documents(spark, odd_docs, no_docs):
    assert mixture.mix(no_docs).count() == 0
    docs = [(r["doc_id"], r["source"], r["text"]) for r in odd_docs.collect()]
    check_mixture(mixture.mix(odd_docs).collect(), docs)
    empty = spark.createDataFrame([(1, "a", None), (2, "b", " "), (3, None, "")], "doc_id long, source string, text string")
    assert {tuple(r)[1:5] for r in mixture.mix(empty).collect()} == {(0, 0, 0.0, 0)}


def test_water_level_takes_few_rounds(spark):
    sources = spark.range(1000).selectExpr("id * id AS source_size", "CAST(element_at(array(5, 2, 1), CAST(id % 3 + 1 AS INT)) AS INT) AS weight").cache()
    rest, weight, rounds = mixture.water_level(sources, 3)
    want = brute_targets({f"{k:04}": k * k for k in range(1000)})
    for k in (1, 999, 998, 500):
        assert want[f"{k:04}"] == min(3.0 * k * k, (5, 2, 1)[k % 3] * rest / weight)
    assert rounds < 12
