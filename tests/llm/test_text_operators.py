"""Tokens, pieces, packing, rules, classifier, LM and n-gram join against brute force and on odd input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import SF, same_rows

from ptclake.llm import lm, packing, pieces, quality_classifier, quality_rules, token_files, tokens
from ptclake.llm.components import components
from ptclake.llm.ngram_join import ngram_components, ngram_sets, trie_links
from ptclake.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    if name != "pipeline":
        same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(file, odd_docs, duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    texts = [r["text"] or "" for r in odd_docs.collect() if len(r["text"] or "") < 10_000] + [r[0] for r in duck.sql("select text from documents limit 40").fetchall()] + ["don't I'LL 'S", "a \n b", "a\n \nb", " \n x", "Σ ΑΣ İ ǅ", "á b", "<|endoftext|>"]
    offsets, ids = tokens.WordCachedEncoder(P.path(file)).encode(pa.array(texts, pa.large_string()), 7)
    for i, x in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 7], x


def best_path(v, text):
    """The plain search over a whole text by sums of scores."""
    text = " " + text if text else text
    best, back = [0.0] + [None] * len(text), [0] * (len(text) + 1)
    scores = {p: v.node_score[v.trie.place[p]] for p in v.ids}
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            score = scores.get(text[i:j], v.unknown_score if j == i + 1 else None)
            if score is not None and (best[j] is None or best[i] + score > best[j]):
                best[j], back[j] = best[i] + score, i
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [i for b, a in zip(cuts[-2::-1], cuts[:0:-1], strict=True) for i in v.of(text[a:b])]


def test_the_type_and_normaliser_are_those_of_the_model_file():
    from pathlib import Path

    model = Path(P.path("piece_bpe_32k.model")).read_bytes()
    assert pieces.is_bpe(model)
    other = {k: v for k, v in pieces.proto_fields(model) if k in (2, 3)}
    message = lambda k, body: bytes([k << 3 | 2]) + bytes([len(body) & 127 | 128, len(body) >> 7]) + body
    assert len(other[2]) >= 128 and pieces.is_bpe(message(2, other[2]) + message(3, other[3]))
    kinds = {k: other[2].replace(b"\x18\x02", bytes([0x18, k]), 1) for k in (1, 3)}
    assert not pieces.is_bpe(message(2, kinds[1]) + message(3, other[3]))
    for trainer, normalizer, words in ((kinds[3], other[3], "neither unigram nor BPE"), (other[2], other[3] + b"\x20\x01", "extra spaces"), (other[2], other[3] + b"\x18\x00", "no dummy prefix"), (other[2], other[3] + b"\x12\x03abc", "normaliser")):
        with pytest.raises(ValueError, match=words):
            pieces.is_bpe(message(2, trainer) + message(3, normalizer))


@pytest.mark.parametrize("kind", ["merges", "scores"])
def test_pieces_are_the_librarys_or_those_of_the_plain_search(odd_docs, duck, kind):
    """By merges the ids are the library's; by scores, as for a unigram model, those of a search over whole texts."""
    import sentencepiece

    e = pieces.PieceEncoder(P.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert e.vocabulary.merges
    if kind == "scores":
        e.vocabulary.merges = None
    texts = [r["text"] or "" for r in odd_docs.collect() if len(r["text"] or "") < 5_000 and "▁" not in (r["text"] or "")]
    texts += [r[0] for r in duck.sql(f"select text from documents where text is not null limit {200 if kind == 'merges' else 15}").fetchall()]
    texts += ["Donaudampfschifffahrtsgesellschaftskapitaen " * 3, "a" * 40 + " " + "ab" * 300, "日本語の長い文章" * 40, "Zq" * 33 + "\u0e01" * 3, "aaa aaaa aaaaa", "\ue000x\ue000 \ue000", "tab\tand\nline  two   three "]
    texts += ["".join(random.Random(k).choices("aeinrst ", k=80)) for k in range(60)]
    want = [library.encode(x) if kind == "merges" else best_path(e.vocabulary, x) for x in texts]
    offsets, ids = e.encode(pa.array(texts, pa.large_string()))
    assert e.commits > 0
    back, rng = e.decode_texts(offsets, ids), random.Random(5)
    for i, x in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == want[i] and back[i].decode() == x, x[:80]
        if i > 40 and len(x) > 2000:
            continue
        stream, got, k, y = pieces.StreamingViterbi(e.vocabulary), [], 0, " " + x if x else ""
        while k < len(y):
            n = rng.randint(1, 50)
            got += stream.feed(y[k : k + n])
            k += n
        assert got + (stream.feed("", last=True) if y else []) == own
        assert stream.widest < 700 or len(set(x)) < 4  # paths through few letters may never meet


def test_pieces_frame(spark, odd_docs, no_docs):
    model = P.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in pieces.decode_pieces(pieces.encode_pieces(odd_docs, model), model).collect()}
    assert got[1]["text"] == "" and got[10]["text"] == "x" * 60_000
    assert all(r["round_trip"] for r in pieces.piece_digests(odd_docs.filter("doc_id <> 12"), model).collect())
    assert pieces.piece_digests(no_docs, model).count() == 0


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_token_ids(odd_docs, path, P.path("byte_bpe_50k.json"), 0)
    files = token_files.read_token_ids(spark, path)
    got = sorted((r.asDict() for r in token_files.token_digests(files).collect()), key=lambda r: r["start"])
    assert len(got) == odd_docs.count()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    (one,) = token_files.lookup(spark, path, [4]).collect()
    assert zlib.crc32(np.array(one["ids"], "<u4").tobytes()) == next(r["ids_crc32"] for r in got if r["doc_id"] == 4)
    assert "doc_id" in token_files.lookup(spark, path, [4])._jdf.queryExecution().toString().split("PushedFilters")[1][:80]
    token_files.write_token_ids(no_docs, f"file://{tmp_path}/none", P.path("byte_bpe_50k.json"), 0)


def library_ids(file, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_rows_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want, at = {}, 0
    for d, ids in zip(docs, library_ids("byte_bpe_50k.json", [d["text"] for d in docs], 0), strict=True):
        want[d["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op8_token_files"](spark, SF).collect()} == want


def test_token_files_have_filters_indexes_and_run_lengths(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_token_ids(spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), path, P.path("byte_bpe_50k.json"), 0, row_index_stride=1000)
    orc, jvm = spark._jvm.org.apache.orc, spark._jvm
    (file, *_) = [str(f) for f in sorted((tmp_path / "ids").glob("part-*"))]
    reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    kinds = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds and not any(k.startswith("BLOOM") and c != 1 for c, k in kinds)
    assert str(footer.getColumns(1).getKind()) == str(footer.getColumns(5).getKind()) == "DIRECT_V2" and reader.getRowIndexStride() == 1000


def check_packs(rows, limit):
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(packs) == list(range(len(packs)))
    return len(packs)


def test_packing(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, P.path("word_bpe_49k.json"), 2, 64).collect()
    packs = check_packs(rows, 64)
    assert packs <= 1.05 * sum(r["length"] for r in rows) / 64 + 2
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert by_doc[1] == [(0, 1, 1)] and len(by_doc[9]) == 2 * len(by_doc[7])
    long = sorted(by_doc[11])
    assert sum(x[1] for x in long) == long[0][2] == 60_001
    assert packing.pack_documents(no_docs, P.path("word_bpe_49k.json"), 2).count() == 0


def test_packed_pieces_are_the_librarys(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = dict(zip(docs, library_ids("word_bpe_49k.json", docs.values(), 2), strict=True))
    rows = QUERIES["op2_packing"](spark, SF).collect()
    check_packs(rows, 4096)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
    assert {d: sorted((r["start"], r["start"] + r["length"]) for r in rows if r["doc_id"] == d) for d in docs} == {d: [(k, min(k + 4096, len(x))) for k in range(0, len(x), 4096)] for d, x in ids.items()}


def test_packing_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, 10 + k % 7, "a", 5, 6) for k in range(100)], "pos long, length long, base string, sequence_id int, first int")
    got = packing.assign(rows, 64).collect()
    assert check_packs(got, 64) and sorted((r["pos"], r["length"], r["base"], r["first"]) for r in got) == sorted((k, 10 + k % 7, "a", 6) for k in range(100))


@pytest.mark.parametrize("h", [{100: 1000}, {2048: 1, 100: 1000}, {1500: 10, 300: 5000}])
def test_few_lengths_pack_within_a_twentieth(h):
    packs = sum(n for _, n in packing.pack_histogram(h, 4096))
    assert packs <= 1.05 * sum(k * n for k, n in h.items()) / 4096 + 1


def test_histogram_packing_steps_follow_lengths():
    rng = random.Random(2)
    h = {k: rng.randint(1, 10**9) for k in range(1, 4097)}
    patterns = packing.pack_histogram(h, 4096)
    back = {}
    for lengths, packs in patterns:
        assert sum(lengths) <= 4096 and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            back[x] = back.get(x, 0) + packs
    assert back == h and len(patterns) < 20_000


@pytest.mark.parametrize("h", [{50: 1_000_000}, {50: 1_000_000, 51: 3, 700: 1000, 4096: 10}, {1: 5000}, {3000: 10, 40: 999_999, 39: 1}])
def test_a_dominant_short_length_fills_its_packs(h):
    patterns, back = packing.pack_histogram(h, 4096), {}
    for lengths, packs in patterns:
        assert sum(lengths) <= 4096
        for x in lengths:
            back[x] = back.get(x, 0) + packs
    assert back == h
    assert sum(packs for _, packs in patterns) <= 1.02 * sum(k * n for k, n in h.items()) / 4096 + 4


def test_copies_of_a_short_text_share_packs(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('text number ', id), 'the same short text') AS text")
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 2, 256).collect()
    assert len(rows) == 900 and check_packs(rows, 256) <= 1.05 * sum(r["length"] for r in rows) / 256 + 2


@pytest.mark.parametrize("h", [{2049: 10**6}, {2100: 10**4}, {1400: 10**5}, {820: 10**5}, dict.fromkeys(range(2050, 2500), 100), dict.fromkeys(range(1, 4097), 7)])
def test_any_histogram_packs_with_little_padding(h):
    patterns, cuts = packing.pack(h, 4096, packing.GRAIN)
    tokens = sum(k * n for k, n in h.items())
    assert sum(n for _, n in patterns) * 4096 <= 1.02 * tokens
    assert len(packing.part_table(h, patterns, cuts)) < 20_000
    assert cuts or h == dict.fromkeys(range(1, 4097), 7)


def test_parts_of_pieces_cover_them_once():
    rng = random.Random(1)
    for _ in range(200):
        limit = rng.choice([64, 128, 256])
        h = {rng.randrange(1, limit + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}
        patterns, cuts = packing.pack(h, limit, 8)
        parts, packs = {}, {}
        for length, first, last, start, size, shift, sequence, copies, offset in packing.part_table(h, patterns, cuts):
            assert start % 8 == 0
            for r in range(first, last + 1):
                parts.setdefault((length, r), []).append((start, size))
                packs.setdefault(sequence + (r + shift) // copies, []).append((offset + (r + shift) % copies * size, size))
        assert set(parts) == {(k, r) for k, n in h.items() for r in range(n)}
        for (length, _), own in [*parts.items(), *(((None, k), v) for k, v in packs.items())]:
            at = 0
            for start, size in sorted(own):
                assert start == at
                at += size
            assert at <= limit if length is None else at == length
        assert sorted(packs) == list(range(len(packs)))


def test_cut_documents_are_the_librarys_ids(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "Épsilon", "x"], k=150 if k % 4 else 140 + k % 3))) for k in range(300)]
    ids = dict(zip((k for k, _ in docs), library_ids("word_bpe_49k.json", [t for _, t in docs], 2), strict=True))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), P.path("word_bpe_49k.json"), 2, 320).collect()
    assert len(rows) > 320 and check_packs(rows, 320) * 320 <= 1.1 * sum(map(len, ids.values()))
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[at : at + r["length"]])
            at += r["length"]
        assert at == len(own)


def test_quality_rules(spark, odd_docs, no_docs):
    got = {}
    for r in quality_rules.quality_rules(odd_docs).collect():
        got[r["doc_id"]] = r
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[11]["n_words"] == 60_000 and got[11]["n_repeat_words"] == 60_000 and got[11]["base_failed"]
    assert quality_rules.quality_rules(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd_docs.filter("doc_id < 9").collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {k + d for k, x in enumerate(win) if win.count(x) > 1 for d in range(5)}
        assert got[i]["n_repeat_words"] == len(twice)
    plan = quality_rules.quality_rules(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifier(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() >= 0.95
    w = quality_classifier.train(docs, labels.limit(0))
    scores = [r["score"] for r in quality_classifier.score(odd_docs, w).collect()]
    assert len(scores) == odd_docs.count() and set(scores) == {0.5}
    assert quality_classifier.score(no_docs, w).count() == 0


def test_classifier_ignores_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    fold = quality_classifier.held_out()
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality_classifier.classify(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_sparse_scores_equal_dense():
    bits, texts = 10, pa.array(["a b c a b", "", "X! x?"], pa.large_string())
    offsets, index = quality_classifier.features(texts, bits)
    assert np.diff(offsets).tolist() == [5 + 4 + 5 + 4 + 3, 0, 2 + 1 + 2 + 1]
    w = quality_classifier.train_ftrl([(index[offsets[0] : offsets[1]], 1), (index[offsets[2] : offsets[3]], 0)] * 20, bits, 0.5, 1.0, 0.0, 0.01)
    x = np.bincount(index[offsets[0] : offsets[1]], minlength=1 << bits)
    assert w[:-1] @ x > w[:-1] @ np.bincount(index[offsets[2] : offsets[3]], minlength=1 << bits)


def test_scores_equal_brute_force(spark, odd_docs):
    """Whole features by their definition, dense dot products in plain loops."""
    bits = 12
    w = np.random.default_rng(1).normal(0, 1, (1 << bits) + 1).astype(np.float32)
    m = (1 << 64) - 1

    def mix(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by & m
        return x ^ x >> 31

    import xxhash

    golden = 0x9E3779B97F4A7C15
    docs = odd_docs.select("doc_id", "text").filter("doc_id <> 9").unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id > 20 AND doc_id < 40").select("doc_id", "text"))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, w).collect()}
    for r in docs.filter("doc_id IS NOT NULL AND doc_id <> 11").collect():
        words = WORD.findall(r["text"] or "")
        h = [xxhash.xxh3_64_intdigest(x.encode()) for x in words]
        s = [xxhash.xxh3_64_intdigest(quality_classifier._shape(x).encode()) * (3 if i and words[i - 1] == x else 1) & m for i, x in enumerate(words)]
        grams = [(1, x) for x in h] + [(2, (a * golden + b) & m) for a, b in zip(h, h[1:])] + [(3, x) for x in s] + [(4, (a * golden + b) & m) for a, b in zip(s, s[1:])]
        grams += [(5, ((a * golden + b) * golden + c) & m) for a, b, c in zip(s, s[1:], s[2:])]
        x = np.zeros(1 << bits)
        for salt, g in grams:
            x[mix(g + salt * golden & m) >> 64 - bits] += 1
        z = w[:-1].astype(float) @ x / (np.sqrt((x * x).sum()) or 1) + w[-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def brute_components(ids, texts, percent=80):
    sets, root = sets_of(texts), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_ngram_join_on_a_group_of_near_copies(spark, monkeypatch, hot):
    """Near copies at all distances, many blocks: no link between different texts is lost, whether n-grams count as very frequent or not."""
    from ptclake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(140):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            t[k : k + 1] = [[], [rng.choice(words)], [t[k], rng.choice(words)]][rng.randrange(3)]
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + " " + " ".join(base[:12]) for _ in range(60)] + texts[:5]
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs, bits=10, filter_bits=10, block=16).collect()}
    assert got == brute_components(ids, texts)


def test_ngram_join_of_a_short_and_a_long_text_with_one_id(spark):
    """The long text has a few n-grams in common with a text of its size, fewer than it needs; the short one's link stays."""
    rng = random.Random(3)
    short, head, one, two = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(k)) for k in (8, 30, 1970, 1970))
    rows = [(1, short), (1, f"{head} {one}"), (2, f"{short} more"), (3, f"{head} {two}"), (10, f"{one} {two}"), (11, f"{one} {two} end")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2, 5] == 1 and got[3, 1996] == 3 and got[11, 3937] == 10


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(50)]
    levels = np.zeros(1 << 8, np.uint8)
    left, right = np.arange(25), np.arange(10, 50)
    got = {frozenset(p) for p in trie_links(sets, levels, left, right, 80)}
    want = {frozenset((int(i), int(j))) for i in left for j in right if i != j and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert got == want


def test_ngram_join_on_odd_rows(spark, odd_docs, no_docs):
    got = {}
    for r in ngram_components(odd_docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(0, 1)} and got[3] == {(0, 3)} and got[4] == {(1, 4)}
    assert {c for _, c in got[5] | got[6]} == {5} and {c for i in (7, 8, 9) for _, c in got[i]} == {7}
    assert {c for _, c in got[None]} == {None, 7}
    assert ngram_components(no_docs).count() == 0


def test_shingle_sets_count_words():
    texts = ["A b\tc d e f", "a b", "", "a b c d e a b c d e a b c d e"]
    offsets, _ = ngram_sets(pa.array(texts, pa.large_string()))
    assert np.diff(offsets).tolist() == [len(s) for s in sets_of(texts)]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {100: 90}


def softmax_log_likelihood(w, shape, ids, share):
    """The sum of log-probabilities of one text's ids, place by place in plain 64-bit arithmetic."""
    embeddings, bias, classes, class_bias, members, member_bias = (x.astype(float) for x in shape.parts(w))
    total = 0.0
    for i, t in enumerate(ids):
        h = bias.copy()
        for k, d in enumerate([*range(-shape.window, 0), *range(1, shape.window + 1)]):
            h += embeddings[k][ids[i + d] if 0 <= i + d < len(ids) else shape.ids]
        h = np.tanh(h)
        for z, hit in ((h @ classes + class_bias, t // shape.members), (members[t // shape.members] @ h + member_bias[t // shape.members], t % shape.members)):
            total += z[hit] - np.log(np.exp(z).sum())
        total += share[t]
    return total


def test_lm_probabilities_sum_to_one_and_start_as_counts():
    shape = lm.Shape(8, 8, 4)
    w = np.random.default_rng(0).normal(0, 1, shape.size).astype(np.float32)
    ids, offsets = np.array([3, 60, 5, 5, 9]), np.array([0, 3, 3, 5])
    row, at = lm.padded(offsets, ids, shape)
    assert row[at].tolist() == ids.tolist()
    near = lm.contexts(row, at, shape)
    assert near[:, 0].tolist() == [64, 64, 60, 5] and near[:, 3].tolist() == [64, 64, 9, 64]
    for k in range(5):  # probabilities of all tokens at a place sum to one
        assert np.exp(lm.log_probabilities(w, shape, np.repeat(near[:, k : k + 1], 64, axis=1), np.arange(64)).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    n = np.arange(64)
    assert np.exp(lm.log_probabilities(shape.start(n), shape, np.zeros((4, 64), int), n)) == pytest.approx((n + 0.5) / (n + 0.5).sum(), rel=1e-4)


def test_lm_sums_equal_brute_force(spark, odd_docs, no_docs):
    shape = lm.Shape(4, 8, 3)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j * j + j) % 40}" for j in range(30 + k))) for k in range(20)] + [(99, None), (100, "")], "doc_id long, text string")
    words = lm.vocabulary(docs, shape)[: shape.words]
    counts = lm.word_counts(docs)
    n = {r["word"]: r["n"] for r in counts.collect()}
    w = np.random.default_rng(3).normal(0, 0.7, shape.size).astype(np.float32)
    got = {r["doc_id"]: r for r in lm.score(docs, words, w, shape, counts).collect()}
    tokens = lm.TokenIds(words, shape)
    for k, text in [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"]]:
        own = text.split()
        ids = tokens.of_words(pa.array(own)).tolist()
        beyond = sum(np.log((n[x] + 0.5) / (sum(c + 0.5 for y, c in n.items() if tokens.of_words(pa.array([y]))[0] == i) + 0.5)) for x, i in zip(own, ids, strict=True) if i >= shape.words)
        assert got[k]["log_likelihood"] == pytest.approx(softmax_log_likelihood(w, shape, ids, np.zeros(shape.ids)) + beyond, rel=1e-4)
        assert got[k]["n_tokens"] == len(own)
    assert (got[99]["n_tokens"], got[99]["log_likelihood"], got[99]["mean_log_likelihood"]) == (0, 0.0, None) and got[100]["n_tokens"] == 0
    assert lm.pseudo_likelihood(odd_docs, shape).count() == odd_docs.count() and lm.pseudo_likelihood(no_docs, shape).count() == 0


def test_lm_trains_on_every_token_once_at_any_partitioning(spark, monkeypatch):
    """Weights equal those of a plain loop over rounds, blocks and their texts, bit for bit."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "BLOCK", 400)
    shape = lm.Shape(4, 8, 3)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j * j + j) % 40}" for j in range(30 + k))) for k in range(60)] + [(7, None)], "doc_id long, text string")
    words = lm.vocabulary(docs, shape)[: shape.words]
    totals = lm.id_totals(lm.word_counts(docs), words, shape)[0]
    assert totals.sum() == sum(30 + k for k in range(60))
    a, b = (lm.train(docs.repartition(k), words, totals, shape) for k in (1, 7))
    assert (a == b).all()
    n = -(-int(totals.sum()) // 400)
    turn = F.xxhash64("doc_id", "text")
    dealt = docs.filter("text IS NOT NULL").select("text", F.pmod(turn, F.lit(n)).alias("block"), F.pmod(F.xxhash64(turn), F.lit(2**62)).alias("turn")).collect()
    w, tokens, seen = shape.start(totals), lm.TokenIds(words, shape), 0
    for k in range(4):
        total, steps = np.zeros(shape.size, np.int64), 0
        for block in range(k, n, 4):
            texts = [tokens.of_words(pa.array(r["text"].split())) for r in sorted((r for r in dealt if r["block"] == block), key=lambda r: r["turn"])]
            own = w.copy()
            m = lm.train_block(own, shape, texts, 0.2)
            total, steps, seen = total + m * np.rint(own.astype(float) / lm.UNIT).astype(np.int64), steps + m, seen + sum(map(len, texts))
        w = (total / steps * lm.UNIT).astype(np.float32)
    assert seen == totals.sum() and (a == w).all()


def test_lm_cuts_the_block_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 100)
    shape = lm.Shape(4, 8, 3)
    text = " ".join(f"w{j * j % 11}" for j in range(30))
    docs = spark.createDataFrame([(None, text)] * 40, "doc_id long, text string")
    words = lm.vocabulary(docs, shape)[: shape.words]
    totals = lm.id_totals(lm.word_counts(docs), words, shape)[0]
    a, b = (lm.train(docs.repartition(k), words, totals, shape) for k in (1, 5))
    ids, total, steps = lm.TokenIds(words, shape).of_words(pa.array(text.split())), np.zeros(shape.size, np.int64), 0
    for n in [7] * 5 + [5]:  # 210 tokens reach twice the block's size
        own = shape.start(totals)
        m = lm.train_block(own, shape, [ids] * n, 0.2)
        total, steps = total + m * np.rint(own.astype(float) / lm.UNIT).astype(np.int64), steps + m
    assert (a == b).all() and (a == (total / steps * lm.UNIT).astype(np.float32)).all()


@pytest.mark.parametrize("partitions", [1, 8])
def test_lm_beats_the_unigram_table_on_texts_it_has_not_seen(spark, partitions):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").select("doc_id", "text").repartition(partitions)
    known, new = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    shape = lm.Shape()
    counts = lm.materialize(lm.word_counts(known), "test-words")
    words = [w for w, _ in lm.most_frequent(counts, lm.FREQUENT)[: shape.words]]
    totals = lm.id_totals(counts, words, shape)
    w = lm.train(known, words, totals[0], shape)
    mean = lambda w: (lambda r: r[0] / r[1])(lm.score(new, words, w, shape, counts, totals).selectExpr("sum(log_likelihood)", "sum(n_tokens)").first())
    assert mean(w) > mean(shape.start(totals[0])) + 0.25


def test_most_frequent_takes_whole_levels(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 500), ("c", 500), *[(f"x{k}", 1) for k in range(50)]], "word string, n long")
    assert lm.most_frequent(counts, 10) == [("a", 1000), ("b", 500), ("c", 500)]
    assert lm.most_frequent(counts, 2) == [("a", 1000)] and lm.most_frequent(counts, 0) == [] and len(lm.most_frequent(counts, 53)) == 53


@pytest.mark.parametrize("frequent", [1 << 16, 0])
def test_lm_scores_words_not_buckets(spark, monkeypatch, frequent):
    """Words of one bucket are told apart by their counts in all documents; with those that occur nowhere they sum to one."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    shape = lm.Shape(2, 4, 2, 1)  # 6 words, 2 buckets
    docs = spark.createDataFrame([(1, "a a a b b b c c c d d d e e e f f f " + "g g " * 40 + "h h h1 h2 h3 h4 h5 h6")], "doc_id long, text string")
    counts, words = lm.word_counts(docs), list("abcdef")
    n = {r["word"]: r["n"] for r in counts.collect() if r["word"] not in words}
    probes = [*n, *words, "nowhere", "nowhere2", "nowhere3"]
    rows = lm.score(spark.createDataFrame(list(enumerate(probes)) + [(None, "nowhere h h"), (None, "nowhere h h"), (99, None)], "doc_id long, text string"), words, shape.start(), shape, counts).collect()
    assert len(rows) == len(probes) + 3
    got = {probes[r["doc_id"]]: r["log_likelihood"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 99}
    bucket = dict(zip(probes, lm.TokenIds(words, shape).of_words(pa.array(probes)).tolist(), strict=True))
    p = 1 / shape.ids  # of any id, before training
    for x in words:
        assert got[x] == pytest.approx(np.log(p), abs=1e-5)
    for i in (6, 7):
        inside = {x: k for x, k in n.items() if bucket[x] == i}
        total = sum(inside.values()) + 0.5 * (len(inside) + 1)
        for x in [y for y in probes if bucket[y] == i]:
            assert got[x] == pytest.approx(np.log(p * (n.get(x, 0) + 0.5) / total), abs=1e-5)
    twice = [r["log_likelihood"] for r in rows if r["doc_id"] is None]
    assert twice == pytest.approx([got["nowhere"] + 2 * got["h"]] * 2, abs=1e-5)


def test_pipeline(spark, odd_docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    one = stages["quality rules"](spark, docs, SF)
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == kept
    good = {r["doc_id"] for r in quality_classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    two = stages["quality classifier"](spark, one, SF)
    assert {r["doc_id"] for r in two.collect()} == kept & good
    rows = two.select("doc_id", "text").collect()
    groups = brute_components([r["doc_id"] for r in rows], [r["text"] for r in rows])
    three = stages["near duplicates"](spark, two, SF)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({c for _, c in groups.values()})
    packed = corpus_pipeline.run(spark, SF).collect()
    check_packs(packed, 4096)
    assert {r["doc_id"] for r in packed} == {c for _, c in groups.values()}
    odd = stages["near duplicates"](spark, odd_docs, SF)
    assert odd.columns == odd_docs.columns and sorted(r["doc_id"] for r in odd.filter("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7, 10, 11, 12, 13, 14]
    assert [r["text"] for r in odd.filter("doc_id IS NULL").collect()] == ["no id at all"]


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    more = odd_docs.withColumns({"_n": F.lit(1), "number": F.lit("x"), "row2": F.create_map(F.lit("k"), F.col("doc_id")), "a.b": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SF)
        if name != "packing":
            assert out.dtypes == more.dtypes
        assert out.count() > 0 if name != "quality rules" else out.count() >= 0
        assert stage(spark, no_docs.limit(0), SF).count() == 0
    assert stage is corpus_pipeline.packing_stage and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd_docs.collect()}


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = spark.createDataFrame([(7, one), (7, two), (7, two), (8, one + " more"), (3, two + " end"), (None, one), (None, "alone")], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(7, one), (3, two + " end"), (None, "alone")], key=str)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from ptclake.llm.common import scratch

    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    assert scratch(session("local[4]"), "x").startswith("file://")
    with pytest.raises(ValueError, match="must name a folder"):
        scratch(session("spark://host:7077"), "x")
