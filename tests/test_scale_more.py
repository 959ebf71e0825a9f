"""Wide correlations, resampling, wide genotypes, nested grids and keys that are null, against brute force."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ptclake.operators import bootstrap, correlation, ranks
from ptclake.operators import evaluation as E
from ptclake.operators import intervals as I
from ptclake.operators import models as L
from ptclake.sources import readers as R


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (700, 7))
    x[:, 1] = x[:, 0] + 1e9 + rng.normal(0, 1e-3, 700)
    x[:, 2] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5, 4] = np.inf
    x[:, 5] = np.nan
    names = [f"c.{k}" for k in range(7)]
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    want = pd.DataFrame(x, columns=names).replace(np.inf, np.nan)
    for parts in (1, 5):
        got = {(r["a"], r["b"]): r for r in correlation.correlations(df.repartition(parts), names).collect()}
        assert len(got) == 21
        for (a, b), r in got.items():
            both = want[[a, b]].dropna()
            assert r["n"] == len(both)
            if "c.2" in (a, b) or "c.5" in (a, b):
                assert r["correlation"] is None
            else:
                assert r["correlation"] == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-6)
    assert correlation.correlations(df.limit(0), names).count() == 0
    strong = correlation.strong_pairs(correlation.correlations(df, names))
    assert set(strong) == {("c.0", "c.1")} and correlation.correlation_prune(names, strong, {"c.1"}) == ["c.0"]


def test_correlations_of_800_columns(spark):
    n, width = 20_000, 800
    df = spark.range(0, n, 1, 4).select(*[((F.xxhash64("id", F.lit(k // 2)) % 1000) + (F.col("id") % 7 if k % 2 else 0)).cast("double").alias(f"c{k}") for k in range(width)])
    began = time.time()
    pairs = correlation.correlations(df, df.columns)
    assert pairs._jdf.queryExecution().toString().count("MapInArrow") >= 2
    strong = correlation.strong_pairs(pairs, 0.9)
    assert set(strong) == {(f"c{k}", f"c{k + 1}") for k in range(0, width, 2)}
    assert time.time() - began < 120


def test_bootstrap_replicates_are_aucs_of_weighted_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, float("nan"), *[k / 30 - 0.3 for k in range(40)]]), rng.choice([0, 1, 1, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "score double, label int")
    kept = [(s, y) for s, y in rows if s is not None and s == s and y is not None]
    keys = sorted(set(kept))
    seeds = {(r["score"], r["label"]): r["s"] for r in spark.createDataFrame(keys, "score double, label int").withColumn("s", F.xxhash64("score", "label")).collect()}
    w = dict(zip(keys, bootstrap.draws([kept.count(k) for k in keys], [seeds[k] for k in keys], 40), strict=True))
    want = []
    for r in range(40):
        pos, neg = ([(s, w[s, y][r]) for s, y in keys if y == c] for c in (1, 0))
        pairs = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
        want.append(pairs / (sum(a for _, a in pos) * sum(b for _, b in neg)))
    for parts in (1, 4):
        got = [r["roc_auc"] for r in bootstrap.auc_replicates(df.repartition(parts), 40).orderBy("replicate").collect()]
        assert got == pytest.approx(want, abs=1e-12)
    alone = bootstrap.bootstrap_ci(df.filter("label = 1"), 20).first()
    assert alone["replicates"] == 0 and alone["median"] is None


def test_bootstrap_of_a_million_scores(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("id / 1000000 AS score", "cast(xxhash64(id) % 1000 / 1000 < id / 1000000 AS int) AS label")
    began = time.time()
    got = bootstrap.bootstrap_ci(df, 1000).first()
    assert got["replicates"] == 1000 and 0 < got["high"] - got["low"] < 0.01
    assert time.time() - began < 150


def test_wide_genotypes_equal_the_columns(spark, tmp_path):
    rng = random.Random(8)
    samples = [f"s {k}" for k in range(40)]
    lines = ["\t".join(["chrom", "pos", *samples])] + ["\t".join([f"chr{k % 3}", str(k), *[rng.choice(["0/0", "0|0", "0/1", "1|1", "./.", ""]) for _ in samples]]) for k in range(60)]
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "g.tsv")
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    want = sorted(map(str, R.genotypes_long(wide).selectExpr("sample", "chrom", "cast(pos as long) pos", "gt").collect()))
    assert sorted(map(str, R.read_genotypes(spark, path).collect())) == want
    sites = spark.createDataFrame([("chr1", 1), ("chr1", 4), ("chr2", 3)], "chrom string, pos long")
    few = {tuple(r) for r in R.read_genotypes(spark, path, sites=sites, drop=(*R.REFERENCE_CALLS, "")).collect()}
    assert few == {tuple(r) for r in R.genotypes_long(wide).selectExpr("sample", "chrom", "cast(pos as long) pos", "gt").filter("pos IN (1, 4) AND gt IN ('0/1', '1|1')").collect()} and few
    vcf = ["##x", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b"]), "1\t5\t.\tA\tT\t.\tPASS\t.\tGT:DP\t0/1:9\t0/0:3", "1\t6\t.\tA\tT\t.\tPASS\t.\tGT\t./.\t1/1"]
    (tmp_path / "g.vcf").write_text("\n".join(vcf) + "\n")
    assert {tuple(r) for r in R.read_genotypes(spark, str(tmp_path / "g.vcf"), drop=R.REFERENCE_CALLS, fixed=9).collect()} == {("a", "1", 5, "0/1"), ("b", "1", 6, "1/1")}
    (tmp_path / "none.tsv").write_text("")
    assert R.read_genotypes(spark, str(tmp_path / "none.tsv")).count() == 0


def test_genotypes_of_20000_samples(spark, tmp_path):
    samples, sites = 20_000, 1_000
    with (tmp_path / "w.tsv").open("w") as f:
        f.write("chrom\tpos\t" + "\t".join(f"s{k}" for k in range(samples)) + "\n")
        blank = ["0/0"] * samples
        for p in range(sites):
            row = blank.copy()
            row[p % samples] = row[(p * 7 + 1) % samples] = "0/1"
            f.write(f"chr1\t{p}\t" + "\t".join(row) + "\n")
    wanted = spark.range(0, sites, 3).selectExpr("'chr1' AS chrom", "id AS pos")
    began = time.time()
    got = R.read_genotypes(spark, str(tmp_path / "w.tsv"), sites=wanted, drop=R.REFERENCE_CALLS)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("p"), F.min("sample").alias("s")).first()
    assert (r["n"], r["p"]) == (668, 334) and r["s"].startswith("s")
    assert time.time() - began < 150


def intervals(rng, n, longest=9):
    return [(k, rng.choice(["1", "2", None]), s, s + 10 ** rng.randrange(longest) * rng.randrange(1, 9) - rng.randrange(2)) for k, s in ((k, rng.randrange(3 * 10**8)) for k in range(n))]


def test_overlaps_of_any_length(spark):
    rng = random.Random(12)
    a, b = intervals(rng, 250), intervals(rng, 300)
    b += [(900, "1", 5, 2), (901, "2", 131_071, 131_072), (902, "1", 0, 4 * 10**9), (903, "1", 2**27 - 1, 2**27)]
    schema = "i long, chrom string, start long, end long"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame([(*x[:1], *x[1:]) for x in b], schema.replace("i long", "j long"))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[3] >= x[2] and y[3] >= y[2])
    assert sorted((r["i"], r["r_j"]) for r in I.overlap_join(left, right, ["chrom"]).collect()) == want and len(want) > 1000
    short = right.filter("end - start < 1000")
    assert sorted((r["i"], r["r_j"]) for r in I.overlap_join(left, short, ["chrom"]).collect()) == [p for p in want if next(y[3] - y[2] for y in b if y[0] == p[1]) < 1000]
    rows = I.with_bins(left).count() + I.with_partner_bins(left, right, ["chrom"]).count()
    assert I.with_bins(left).count() <= 2 * len(a) and rows <= 2 * I.GRIDS * len(a)
    assert I.with_partner_bins(left, right.filter("end - start < 1000"), ["chrom"]).count() == 0


def test_overlap_semi_keeps_repeated_rows(spark):
    f = spark.createDataFrame([("1", 5, 9, "x"), ("1", 5, 9, "x"), ("1", 5, 9, "y"), ("1", 50, 60, "z"), (None, 5, 9, "n")], "chrom string, start long, end long, name string")
    v = spark.createDataFrame([("1", 1, 6), ("1", 7, 7), (None, 1, 9)], "chrom string, start long, end long")
    assert sorted(r["name"] for r in I.overlap_semi(f, v, ["chrom"]).collect()) == ["x", "x", "y"]


def test_null_keys_ids_labels_and_nan_scores(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (None, 1, 0.7), (3, None, float("nan")), (4, 1, None), (5, 0, float("nan"))], "id long, label int, score double")
    folds = L.stratified_folds(df, "id", "label", 2).collect()
    assert len(folds) == 5 and all(r["fold"] in (0, 1) for r in folds)
    assert E.roc_pr(E.score_table(df)).first()["roc_auc"] == 1.0
    binned = spark.createDataFrame([(b, y, s) for b in ("a", None) for y in (0, 1) for s in [0.1 * k + 0.05 * y for k in range(12)]], "bin string, label int, score double")
    auc = {r["bin"]: r["roc_auc"] for r in E.within_bin_auc(binned, "bin").collect()}
    assert set(auc) == {"a", None} and auc["a"] == auc[None] > 0.5
    q = {r["bin"]: r["q"] for r in ranks.quantiles(binned, "score", [0.5], ["bin"]).collect()}
    assert q["a"] == q[None]
    far = spark.createDataFrame([(x, int(x > 3)) for x in (-1e300, -5.0, 0.0, 2.0, 4.0, 1e300, float("inf"))], "score double, label int")
    assert E.roc_pr(E.score_table(far)).first()["roc_auc"] == 1.0


def test_exact_rank_sum_is_that_of_all_choices():
    import itertools

    for m, n in ((2, 3), (4, 4), (5, 3), (1, 6)):
        all_u = [sum(c) - m * (m + 1) / 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        assert [int(x) for x in E.rank_sum_counts(m, n)] == [all_u.count(u) for u in range(m * n + 1)]
        for u in range(m * n + 1):
            want = min(1, 2 * min(sum(x <= u for x in all_u), sum(x >= u for x in all_u)) / len(all_u))
            assert E.exact_rank_sum_p(u, m, n) == pytest.approx(want)
    assert sum(E.rank_sum_counts(49, 49)) == pytest.approx(25477612258980856902730428600)


def test_medians_of_left_out_folds(spark):
    from ptclake.operators.features import fold_medians

    rng = random.Random(3)
    rows = [(k % 3 if k % 11 else None, rng.choice([None, float("nan"), *[float(rng.randrange(50)) for _ in range(9)]]), rng.random() if k % 3 == 1 else None) for k in range(700)]
    df = spark.createDataFrame(rows, "fold int, `a.b` double, c double")
    got = {(r["feature"], r["fold"]): r["median"] for r in fold_medians(df, ["a.b", "c"], "fold", 3).collect()}
    for f in range(3):
        for name, at in (("a.b", 1), ("c", 2)):
            some = [r[at] for r in rows if r[0] is not None and r[0] != f and r[at] is not None and r[at] == r[at]]
            assert got[name, f] == (np.median(some) if some else None)


def test_bucketed_annotations_join_without_a_shuffle(spark):
    from helpers import SF
    from ptclake.plans.feature_queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = QUERIES["bucketed_annotations"](spark, SF)
        assert df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_audit_needs_one_scan(spark, tmp_path):
    from ptclake.operators.features import write_aligned

    df = spark.createDataFrame([(1, "5", None, "q"), (2, "x", 1.0, "q"), (3, None, None, "q")], "id long, n string, v double, more string")
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    audit = write_aligned(df.mapInArrow(each, df.schema), {"n": "double", "v": "double", "new": "string"}, str(tmp_path / "a"), {"v": 7.0, "new": "MISSING"}, keep=["id"])
    assert {tuple(r) for r in audit.collect()} == {("n", "present", 1, 1, 0, 2), ("v", "present", 2, 0, 2, 0), ("new", "missing", 3, 0, 3, 0), ("more", "extra", None, None, None, None)}
    assert seen.value == 3
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {(1, 5.0, 7.0, "MISSING"), (2, None, 1.0, "MISSING"), (3, None, 7.0, "MISSING")}


def test_a_genome_is_read_where_it_is_wanted(spark, tmp_path):
    from ptclake.sources.writers import write_genome

    rng = random.Random(1)
    seqs = {c: "".join(rng.choices("ACGT", k=9_950)) for c in ("c1", "c2", "c3")}
    (tmp_path / "g.fa").write_text("".join(f">{c}\n" + "\n".join(s[k : k + 70] for k in range(0, len(s), 70)) + "\n" for c, s in seqs.items()))
    write_genome(R.read_fasta(spark, str(tmp_path / "g.fa"), 100), str(tmp_path / "genome"), span=4)
    ranges = spark.createDataFrame([("c1", 95, 205), ("c1", 101, 101), ("c3", 9_901, 9_950), ("c2", 9, 5), ("c9", 1, 5)], "chrom string, start long, end long")
    ranges.write.parquet(str(tmp_path / "ranges"))
    broken = 0
    for file in (tmp_path / "genome").glob("*/*.parquet"):
        if file.parent.name not in {"part=c1-0", "part=c3-24"}:
            file.write_text("no Parquet at all")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            broken += 1
    got = R.read_genome(spark, str(tmp_path / "genome"), spark.read.parquet(str(tmp_path / "ranges")), chunk=100, span=4).collect()
    assert broken > 70 and {(r["chrom"], r["chunk_no"]): r["seq"] for r in got} == {(c, k): seqs[c][100 * k : 100 * k + 100] for c, k in (("c1", 0), ("c1", 1), ("c1", 2), ("c3", 99))}


def test_a_vcf_header_has_no_quotes(spark, tmp_path):
    from ptclake.sources.writers import write_vcf

    write_vcf(spark.createDataFrame([("chr1", 5, "A", "T")], "chrom string, pos long, ref string, alt string").coalesce(1), str(tmp_path / "v"))
    assert "".join(p.read_text() for p in (tmp_path / "v").glob("part-*")) == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t5\t.\tA\tT\t.\tPASS\t.\n"


def test_q_values_of_many_tests(spark):
    """Running minima go by ranges of p, in ascending frames, so their work isn't the square of the number of tests."""
    rng = random.Random(8)
    p = [rng.choice([rng.random(), round(rng.random(), 2), 0.0, 1.0]) for _ in range(4000)] + [None]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p_value double")
    got = E.bh_adjust(df)
    assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    order = sorted(k for k in range(4000))
    order.sort(key=lambda k: p[k])
    want, least = {4000: None}, 1.0
    for i in range(3999, -1, -1):
        least = min(least, p[order[i]] * 4000 / (i + 1))
        want[order[i]] = least
    rows = got.collect()
    assert len(rows) == 4001 and all(r["q_value"] is None if want[r["id"]] is None else r["q_value"] == pytest.approx(want[r["id"]]) for r in rows)


def test_overlaps_are_counted_without_pairs(spark):
    """Two million pairs from six thousand rows: none is made."""
    rng = random.Random(9)
    iv = [(rng.choice(["a", "b", None]), s, s + rng.choice([-3, 0, 5, 40_000, 900_000])) for s in (rng.randrange(100_000) for _ in range(300))]
    win = [(k % 200, rng.choice(["a", "b", "c", None]), s, s + rng.choice([-1, 0, 700, 300_000])) for k, s in enumerate(rng.randrange(100_000) for _ in range(260))]
    want = {k: sum(c is not None and c == d and a <= b and s <= e and a <= e and s <= b for i, c, a, b in win if i == k for d, s, e in iv) for k in range(202)}
    iv_df, win_df = spark.createDataFrame(iv, "c string, start long, end long"), spark.createDataFrame(win, "id long, c string, start int, end int")
    got = I.count_overlaps(win_df, iv_df, "id", ["c"], spark.range(202))
    assert {r["id"]: (r["n"], r["any"]) for r in got.collect()} == {k: (n, "yes" if n else "no") for k, n in want.items()}
    many = lambda n: spark.range(n).selectExpr("id", "'a' AS c", "id % 7 AS start", "id % 7 + 50 AS end")
    crowded = I.count_overlaps(many(3000), many(3000), "id", ["c"], many(3000))
    assert {r["n"] for r in crowded.collect()} == {3000}
    plan = crowded._jdf.queryExecution().optimizedPlan().toString()
    assert "r_start" not in plan


def test_parts_grow_with_the_table(spark, monkeypatch):
    from helpers import SF

    from ptclake.plans import shapes

    n = shapes.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(ranks, "PART_ROWS", 500)
    for frame in (shapes.exons(spark, SF), shapes.lines(spark, SF), shapes.gene_model(spark, SF)):
        assert frame.rdd.getNumPartitions() == -(-n // 500)


def test_lines_are_read_once_by_a_model_query(spark, monkeypatch):
    """The gene model makes exons and coding parts in one pass; written lines of files are compressed."""
    from pathlib import Path

    from helpers import SF

    from ptclake.plans import shapes, source_queries

    plan = shapes.gene_model(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("parquet") <= 1
    path = source_queries._text(spark.range(3), "lines", "id")
    assert all(f.name.endswith(".gz") for f in Path(path.removeprefix("file:")).glob("part-*"))


def test_regions_work_nothing_out_for_each_block(spark):
    from helpers import SF

    from ptclake.plans.feature_queries import QUERIES

    assert "array_max" not in QUERIES["motif_regions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_ordered_statistics_shuffle_rows_once_a_column_however_common(spark, monkeypatch, tmp_path):
    """Lines go through one shuffle by order and one for each column, at either size, also where all categories of a column go by parts; results are the same."""
    from helpers import SF

    from ptclake.operators import encoding
    from ptclake.plans.queries import QUERIES
    from ptclake.plans.shapes import table

    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    for copies in (1, 6):
        li = table(spark, SF, "lineitem").crossJoin(spark.range(copies).withColumnRenamed("id", "k"))
        # orders shifted; 40 parts and three flags, so that rows of counts are few beside the lines
        li.withColumn("l_orderkey", F.expr("l_orderkey + k * 10000000")).withColumn("l_partkey", F.expr("l_partkey % 40")).drop("k").write.parquet(f"{tmp_path}/{copies}/lineitem.parquet")
        n, got = li.count(), {}
        for many in (encoding.MANY, n // 6):
            monkeypatch.setattr(encoding, "MANY", many)
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            before = shuffled()
            got[many] = sorted(map(tuple, QUERIES["ordered_category_statistics"](spark, f"{tmp_path}/{copies}").collect()))
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            assert 3 * n <= shuffled() - before < 3.1 * n
            monkeypatch.undo()
        assert len(got) == 2 and len({tuple(x) for x in got.values()}) == 1 and len(got[n // 6]) == n


def test_parts_stay_as_few_as_are_written_without_a_sort(spark, monkeypatch):
    """More than 200 parts make each writing task sort all its rows in memory, which spilled at 216,000,000 lines; rows a part stay bounded."""
    monkeypatch.setattr(ranks, "PART_ROWS", 10)
    for rows, parts in ((90, 9), (1990, 199), (4320, 200), (8000, 200), (20_000, 500)):
        assert ranks.dealt(spark.range(10), rows, "id").rdd.getNumPartitions() == parts
