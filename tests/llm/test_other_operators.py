"""Chat formatting, WARC fixity and top-k search against brute force and on odd input."""

import json
import random

import numpy as np
import pytest

from ptclake.llm import chat, topk, warc


def test_template_is_reversible():
    rng = random.Random(1)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", "s>", "/", "a", " ", "<\\s>", "[\\INST]"]
    for _ in range(3000):
        role, text = ("".join(rng.choices(parts, k=rng.randint(0, n))) for n in (3, 7))
        segment, a, b = chat.format_turn(role, text)
        assert chat.read_turn(segment) == (role, text) and chat.unescape(segment[a:b]) == text
        assert segment.count("</s>") == 1 and segment.count("[/INST]") == 1 and segment.count("<s>") == 1


def test_layouts(spark):
    rows = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}), (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}), (3, {"prompt": "q", "response": "a"}),
        (4, {"instruction": "q", "input": "x", "output": "a"}), (5, {"question": "q", "answer": "a"}), (6, {"other": 1}), (7, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(v) if v else None) for k, v in rows], "conv_id long, payload string")
    got = {}
    for r in chat.json_turns(df, "conv_id", "payload").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for k in (1, 2, 3, 5):
        assert sorted(got[k]) == [(0, "user", "q"), (1, "assistant", "a")]
    assert sorted(got[4])[0] == (0, "user", "q\nx") and got[6] == got[7] == [(None, None, None)]
    more = [
        ({"prompt": 5, "response": "x"}, [(0, "user", "5"), (1, "assistant", "x")]), ({"messages": [{"role": 1, "content": 2.5}, "loose"], "id": 9}, [(0, "1", "2.5"), (1, "", '"loose"'.strip('"'))]),
        ({"messages": [{"role": "user", "content": None}, {"role": "user", "content": [{"type": "text"}]}]}, [(0, "user", ""), (1, "user", '[{"type": "text"}]')]), ({"messages": []}, [(None, None, None)]), ({"messages": {}}, [(None, None, None)]),
        ({"instruction": {"a": 1}, "output": "x"}, [(None, None, None)]), ([1], [(None, None, None)]), ({"conv_id": 77, "turn": 2, "role": "gpt", "text": "t", "extra": {"x": []}}, [(2, "assistant", "t")]),
        ({"conv_id": "a", "turn": 1e30, "role": None, "text": True}, [(None, "", "true")]), ({"prompt": "\ud800", "response": None}, [(0, "user", "\ufffd"), (1, "assistant", "")]), ({}, [(None, None, None)]),
    ]
    raw = [(100 + k, json.dumps(v)) for k, (v, _) in enumerate(more)] + [(None, "{"), (300, "[" * 100_000), (301, "NaN")]
    got = chat.json_turns(spark.createDataFrame([(k, v, "x") for k, v in raw], "k long, conv_id string, payload string"), "k", "conv_id").collect()
    for k, (_, want) in enumerate(more):
        own = {7: 77, 8: None}.get(k, 100 + k)
        assert [(r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == own and (own is not None or r["layout"])] == want, more[k]
    assert len(got) == sum(len(w) for _, w in more) + 3
    assert chat.json_turns(df.limit(0), "conv_id", "payload").count() == 0
    mixed = spark.createDataFrame([("a", 1, 2)], "conv_id string, prompt int, response long")
    assert [tuple(r) for r in chat.canonical_turns(mixed).orderBy("turn").collect()] == [(None, 0, "user", "1"), (None, 1, "assistant", "2")]
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 1, **rows[0][1], "extra": 3})]))
    assert [(r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(table).orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é\n</s>"), (None, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "assistant", "y" * 50_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chat(chat.canonical_turns(df))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"], got[None]["loss_chars"], got[3]["loss_chars"]) == (2, 6, 2, 0, 50_000)
    assert chat.chat_digests(chat.format_chat(chat.canonical_turns(df.limit(0)))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, pos string, start int")


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>\r\n\r\n" * (k % 4)) for k in range(50)] + [(60, None, None), (61, "u", "é" * 30_000)]
    rows += [(62, "u\r\nContent-Length: 3", "a WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.0\r\n"), (63, "é%0D\n", "\r\n"), (None, "x", "y")]
    warc.write_warc(pages(spark, rows), f"file://{tmp_path}/w", records_per_file=7)
    got = sorted(((r["page_id"], r["url"], r["html"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()), key=str)
    assert got == sorted(((a, b or "", c or "") for a, b, c in rows), key=str)
    with pytest.raises(ValueError, match="no WARC record at byte 0"):
        list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nhi"))


def audited(spark, rows, other, **options):
    return sorted(((r["status"], r["page_id"]) for r in warc.audit(warc.records(pages(spark, rows)), warc.records(pages(spark, other)), **options).collect()), key=lambda r: (r[0], r[1] is None, r[1]))


def test_warc_audit(spark):
    rows = [(k, "u", f"page {k} " * (k % 5)) for k in range(300)] + [(None, None, None), (7, "u", "second"), (8, "u", "page 8 " * 3)]
    other = [(k, u, h if k != 33 else h + "!") for k, u, h in rows if k not in (0, 250)] + [(999, "u", "new")]
    assert audited(spark, rows, other, fanout=4, depth=2) == [("changed", 33), ("extra", 999), ("lost", 0), ("lost", 250)]
    a = warc.records(pages(spark, rows))
    assert warc.audit(a, a, fanout=4, depth=2).count() == 0
    assert warc.audit(a, a.limit(0)).count() == len(rows) and warc.audit(a.limit(0), a).filter("status = 'extra'").count() == len(rows)
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_audit_of_clumped_sparse_and_repeated_ids(spark):
    rows = [(5, "u", f"copy {k}") for k in range(90)] + [(5, "u", "same")] * 40 + [(k * 10**15 - 3 * 10**15, "u", str(k)) for k in range(9)] + [(None, "u", str(k)) for k in range(20)]
    other = [r for r in rows if r[2] not in ("copy 7", "copy 8")][:-1] + [(5, "u", "copy x")]
    other.remove((5, "u", "same"))
    assert audited(spark, rows, other, fanout=4) == [("changed", 5), ("lost", 5), ("lost", 5), ("lost", None)]


def suspects(spark, rows, other, fanout):
    """The leaves that differ, and how many records of the first replica they hold."""
    one, two = (warc.records(pages(spark, x)) for x in (rows, other))
    levels = warc.levels_of([one, two], fanout)
    books = [warc.ledger(x, levels, fanout) for x in (one, two)]
    trees = [warc.tree(b, levels, fanout) for b in books]
    assert [t[-1].count() for t in trees] == [1, 1]
    wrong = warc.differing_leaves(*trees)
    return wrong.count(), books[0].join(wrong, books[0]["leaf"] == wrong["node"], "left_semi").count()


def test_warc_audit_joins_records_of_differing_leaves_only(spark):
    rows = [(k, "u", f"page {k}") for k in range(1000)]
    other = [(k, u, "rot" if k == 500 else h) for k, u, h in rows if k != 17]
    leaves, records = suspects(spark, rows, other, 4)
    assert 2 <= leaves <= 3 and records <= 3 * 4


def test_warc_audit_of_clumped_and_far_ids(spark):
    far = [(0, "u", "a"), (2**60, "u", "b"), (-(2**63), "u", "c"), (2**63 - 1, "u", "d")]
    assert audited(spark, far, far) == []
    assert audited(spark, far, [(k, u, h + "!" if k == 2**60 else h) for k, u, h in far[:3]]) == [("changed", 2**60), ("lost", 2**63 - 1)]
    rows = [(k, "u", f"page {k}") for k in range(5000)] + [(10**15, "u", "far")]
    other = [(k, u, h + "rot" if k % 250 == 77 else h) for k, u, h in rows]
    leaves, records = suspects(spark, rows, other, 16)
    assert leaves == 20 and records <= 20 * 16
    assert audited(spark, rows, other) == [("changed", k) for k in range(77, 5000, 250)]


def test_warc_leaves_are_the_same_without_a_neighbour(spark):
    """A lost record, whether it begins a leaf or not, changes its own leaf and the one before it at most."""
    rows = [(k * 7, "u", str(k)) for k in range(120)]
    for gone in range(0, 120, 17):
        leaves, _ = suspects(spark, rows, rows[:gone] + rows[gone + 1 :], 4)
        assert leaves in (1, 2)


def brute(vectors, every, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in good:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in good if j != i and len(u) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 8))]) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(60)] + [(50 + 5000, None), (51, [None] * 8), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (5200, []), (5250, [1.0, 2.0]), (None, vectors[0][1]), (5300, [0.0] * 8)]
    vectors = [v for v in vectors if v[0] != 51] + [(5301, [None] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, shard int, score int")
    got = {tuple(r) for r in topk.top_k(df, shard_rows=64, block_rows=8).collect()}
    assert got == brute(vectors, 50, 5)
    few = {tuple(r) for r in topk.top_k(df, shard_rows=16, block_rows=4, most_centres=9, sample_rows=100).collect()}
    assert few == got
    assert topk.top_k(df.limit(0)).count() == 0
    large = spark.createDataFrame([(i, [1e6 * (i + 1), -1e6]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(large).collect()} == brute([(i, [1e6 * (i + 1), -1e6]) for i in range(4)], 50, 5)


def test_topk_of_a_repeated_query_among_equal_vectors(spark):
    from ptclake.llm.topk import top_k

    rows = [(0, [1.0, 0.0])] * 4 + [(k, [1.0, 0.0]) for k in range(1, 8)] + [(k, [0.5, 0.0]) for k in range(10, 30)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(k, k) for k in range(1, 6)]


def test_topk_scores_few_pairs_of_clustered_vectors():
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 200, (40, 16))
    x = np.rint(np.concatenate([m + rng.normal(0, 8, (200, 16)) for m in middle])).astype(np.int64)
    ids, q = np.arange(len(x)), np.arange(0, len(x), 50)
    lowest = np.full(len(q), -(2**63))
    row, vec, score, scored = topk.search(topk.BallTree(x), ids, np.arange(len(x) + 1), x, x[q], q, lowest, 5)
    want = x[q] @ x.T
    want[np.arange(len(q)), q] = -(2**62)
    assert (np.sort(score.reshape(-1, 5), axis=1) == np.sort(want, axis=1)[:, -5:]).all()
    assert scored < 0.25 * len(q) * len(x)
    bound = np.sort(want, axis=1)[:, -5]
    assert topk.search(topk.BallTree(x), ids, np.arange(len(x) + 1), x, x[q], q, bound, 5)[3] <= scored


def test_topk_keeps_few_ids_of_a_vector(spark):
    rows = spark.range(3000).selectExpr("id AS vec_id", "array(IF(id % 3 = 0, id, 1L)) AS v")
    got = {tuple(r["v"]): [tuple(x) for x in r["ids"]] for r in topk.distinct_points(rows.union(rows), 5).collect()}
    assert got[1,] == [(k, 2) for k in (1, 2, 4, 5, 7, 8)] and got[30,] == [(30, 2)]
