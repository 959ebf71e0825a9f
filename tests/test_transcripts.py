"""Transcript operators against a walk over single bases, at every position of transcripts of our own."""

import pytest
from pyspark.sql import functions as F

from ptclake.operators import intervals as I
from ptclake.operators import transcripts as T

#: strand, and exons, coding and stop blocks in transcript order
MODELS = {
    21: ("+", [(1001, 1060), (1201, 1300), (1501, 1580)], [(1031, 1060), (1201, 1300), (1501, 1540)], []),
    22: ("-", [(4401, 4480), (4101, 4220), (3801, 3890)], [(4401, 4450), (4101, 4220), (3851, 3890)], []),
    23: ("+", [(7001, 7450)], [(7101, 7400)], []),
    24: ("-", [(9501, 9600), (9201, 9330), (8901, 9040)], [(9201, 9300), (8951, 9040)], []),  # the first exon isn't coding
    25: ("+", [(201, 260), (401, 520), (701, 760)], [(231, 260), (401, 520)], [(701, 703)]),  # the stop alone makes the last exon coding
    26: ("-", [(2901, 3000), (2601, 2780), (2301, 2390)], [(2901, 2960), (2691, 2780)], [(2688, 2690)]),  # the last exon is behind the stop
    27: ("+", [(101, 150), (301, 349), (501, 640)], [(121, 150), (301, 349), (501, 600)], []),  # a last but one exon of 49
    28: ("-", [(801, 850), (601, 650), (301, 440)], [(801, 830), (601, 650), (351, 440)], []),  # and of 50
    29: ("+", [(5001, 5030), (5101, 5140)], [], []),  # nothing coding
}


def walk(strand, blocks):
    """The bases of blocks, in order."""
    return [x for a, b in blocks for x in (range(a, b + 1) if strand == "+" else range(b, a - 1, -1))]


def place(blocks, pos):
    return next((k for k, (a, b) in enumerate(blocks) if a <= pos <= b), None)


def wanted(tx, pos):
    """What locate_ptc has to say of a position, by walking; None outside of all exons."""
    strand, exons, cds, stop = MODELS[tx]
    k = place(exons, pos)
    if k is None:
        return None
    own = walk(strand, [exons[k]])
    marks = set(walk("+", cds + stop))
    coding = [e for e in exons if marks & set(walk("+", [e]))]
    rank, c, path = place(coding, pos), place(cds, pos), walk(strand, cds)
    out = {"exon_rank": k + 1, "exon_count": len(exons), "exon_offset": own.index(pos) + 1, "to_exon_end": len(own) - own.index(pos) - 1, "exon_length": len(own)}
    out |= {"coding_rank": None, "coding_count": None, "exons_after": None} if rank is None else {"coding_rank": rank + 1, "coding_count": len(coding), "exons_after": len(coding) - rank - 1}
    if c is None:
        return out | {"cds_pos": None, "relative": None}
    block = walk(strand, [cds[c]])
    left = len(block) - block.index(pos) - 1
    near = rank + 2 == len(coding) and left <= 50 and len(block) >= 50
    return out | {"cds_pos": path.index(pos) + 1, "relative": (path.index(pos) + 1) / (len(path) + len(walk("+", stop))), "last_ejc": "last.exon" if rank + 1 == len(coding) else "penultimate.last50bp" if near else "upstream"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(tx, "G", "chr1", strand, kind, a, b) for tx, (strand, *parts) in MODELS.items() for kind, blocks in zip(("exon", "CDS", "stop_codon"), parts, strict=True) for a, b in blocks]
    return T.transcript_model(spark.createDataFrame(rows, "tx long, gene string, chrom string, strand string, feature string, start long, end long")).cache()


@pytest.fixture(scope="module")
def every(spark):
    """A variant at each position from before the first exon to behind the last."""
    rows = [(tx * 10_000 + pos, tx, pos) for tx, (_, exons, *_) in MODELS.items() for pos in range(min(a for a, _ in exons) - 2, max(b for _, b in exons) + 3)]
    return spark.createDataFrame(rows, "id long, tx long, pos long").cache()


def test_order(model):
    for r in model.collect():
        _, exons, cds, stop = MODELS[r["tx"]]
        assert [[tuple(b) for b in r[k]] for k in ("exons", "cds", "stop_codon")] == [exons, cds, stop]


def test_places_of_all_positions(model, every):
    found = T.locate_ptc(every, model).collect()
    assert len(found) == every.count()
    kinds = set()
    for r in found:
        want = wanted(r["tx"], r["pos"])
        if want is None:
            assert r["exon_rank"] is None and r["cds_pos"] is None and r["coding_rank"] is None
            continue
        for k, v in want.items():
            assert r[k] == (pytest.approx(v) if isinstance(v, float) else v), (r["tx"], r["pos"], k)
        kinds.add(want.get("last_ejc"))
    assert kinds == {None, "last.exon", "penultimate.last50bp", "upstream"}


def test_lengths(model):
    got = {r["tx"]: r for r in T.exon_counts(model).collect()}
    for tx, (strand, exons, cds, _) in MODELS.items():
        coding = sum(any(set(walk("+", [e])) & set(walk("+", [c])) for c in cds) for e in exons)
        n = len(walk(strand, cds))
        assert (got[tx]["coding_exons"], got[tx]["noncoding_exons"], got[tx]["noncoding_bp"]) == (coding, len(exons) - coding, len(walk(strand, exons)) - n)
        assert got[tx]["cds_exon_ends"] == [len(walk(strand, cds[: k + 1])) for k in range(len(cds))]


def test_regions_of_all_positions(model, every):
    blocks = T.region_blocks(every, model, flank=7)
    got = {}
    for r in blocks.orderBy("rank").collect():
        got.setdefault((r["id"], r["region"]), []).append((r["start"], r["end"]))
    seen = 0
    for v in every.collect():
        strand, exons, cds, stop = MODELS[v["tx"]]
        k = place(exons, v["pos"])
        path, own = walk(strand, exons), None if k is None else walk(strand, [exons[k]])
        want = {}
        if k is not None:
            end, pos, marks = own[-1], v["pos"], [path.index(x) for x in walk("+", cds + stop)]
            want = {"ptc_100bp": set(range(pos - 7, pos + 8)), "ejc_100bp": set(range(end - 7, end + 8)), "ptc_to_ejc": set(own[own.index(pos) :]) if pos != end else set(), "new3utr": set(path[path.index(pos) + 1 :]), "tx_whole": set(path)}
            want |= {"old3utr": set(path[max(marks) + 1 :]), "utr5": set(path[: path.index(walk(strand, cds)[0])])} if cds else {}
        have = {name: walk(strand, bs) for (i, name), bs in got.items() if i == v["id"]} if v["pos"] % 9 == 0 else None
        if have is not None:
            seen += 1
            assert {n: set(x) for n, x in have.items()} == {n: x for n, x in want.items() if x}
            assert all(x == sorted(x, reverse=strand == "-") for x in have.values())
    assert seen > 300


def test_first_bases(model, every):
    blocks = T.region_blocks(every.filter("pos % 25 = 0"), model).filter("region = 'new3utr'")
    got = {}
    for r in I.take_first_bases(blocks, ["id", "region"], 60).orderBy("rank").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    for v in every.filter("pos % 25 = 0").collect():
        strand, exons, *_ = MODELS[v["tx"]]
        path = walk(strand, exons)
        rest = path[path.index(v["pos"]) + 1 :] if v["pos"] in path else []
        assert walk(strand, got.get(v["id"], [])) == rest[:60]


def test_coding_intervals(spark, model):
    rows = [(tx * 1000 + a, tx, a, a + n) for tx, (strand, _, cds, _) in MODELS.items() for a in range(1, len(walk(strand, cds)), 17) for n in (0, 40)]
    got = {}
    for r in T.cds_interval_to_genomic(spark.createDataFrame([(i * 100 + b - a, tx, a, b) for i, tx, a, b in rows], "id long, tx long, from_ long, to_ long"), model).orderBy("rank").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    for i, tx, a, b in rows:
        strand, _, cds, _ = MODELS[tx]
        assert walk(strand, got[i * 100 + b - a]) == walk(strand, cds)[a - 1 : b]


def test_splicing(spark, model):
    text = "".join("ACGT"[(7 * i * i + i) % 4] for i in range(10_000))
    genome = spark.createDataFrame([("chr1", k, text[k * 64 : k * 64 + 64]) for k in range(157)], "chrom string, chunk_no long, seq string")
    b = model.select("tx", "chrom", "strand", F.posexplode("exons").alias("i", "b")).select("tx", "chrom", "strand", (F.col("i") + 1).alias("rank"), "b.start", "b.end")
    got = {r["tx"]: r["seq"] for r in T.splice_sequence(b, genome, 64).collect()}
    for tx, (strand, exons, *_) in MODELS.items():
        bases = "".join(text[x - 1] for x in walk(strand, exons))
        assert got[tx] == (bases if strand == "+" else bases.translate(str.maketrans("ACGT", "TGCA")))


def test_binned_overlap_has_no_repeats(spark):
    left = spark.createDataFrame([("c", i, 10 * i, 10 * i + 95) for i in range(60)], "chrom string, i long, start long, end long")
    right = spark.createDataFrame([("c", j, 17 * j, 17 * j + j) for j in range(60)], "chrom string, j long, start long, end long")
    got = sorted((r["i"], r["r_j"]) for r in I.overlap_join(left, right, ["chrom"], width=32).collect())
    assert got == sorted((i, j) for i in range(60) for j in range(60) if 10 * i <= 17 * j + j and 17 * j <= 10 * i + 95)
