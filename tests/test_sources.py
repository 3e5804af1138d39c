"""Scans and sinks on small files, and a whole run on a made-up community."""

import gzip
import random

import numpy as np
import pytest

from skein.functions import sequence
from skein.plans import pipeline
from skein.sources import readers, writers

K = 21


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def community(tmp_path_factory):
    """Two genes, each a chain of common segments with two-way bubbles; two strains that differ in every bubble."""
    root, r, rng = tmp_path_factory.mktemp("graphs"), random.Random(1), np.random.default_rng(2)
    gamma = np.array([[8, 1, 5, 2, 9, 3.0], [1, 7, 2, 9, 3, 6.0]])
    truth = {}
    for g, gene in enumerate(["COG0001", "COG0002"]):
        seqs, links, strain = [], [], [[], []]
        last = ["".join(r.choices("ACGT", k=200))]
        seqs.append(last[0])
        ids = [1]
        for s in strain:
            s.append(1)
        for _ in range(3):
            two = [last[0][-K:] + "".join(r.choices("ACGT", k=150)) for _ in range(2)]
            join = "".join(r.choices("ACGT", k=K))
            two = [t + join for t in two]
            at = len(seqs) + 1
            seqs += two
            links += [(i, at + j) for i in ids for j in range(2)]
            for j, s in enumerate(strain):
                s.append(at + j)
            last = [join + "".join(r.choices("ACGT", k=180))]
            seqs.append(last[0])
            ids = [len(seqs)]
            links += [(at, ids[0]), (at + 1, ids[0])]
            for s in strain:
                s.append(ids[0])
        with open(root / f"{gene}.gfa", "w") as f:
            f.writelines(f"S\t{i + 1}\t{s}\tKC:i:{len(s)}\n" for i, s in enumerate(seqs))
            f.writelines(f"L\t{a}\t+\t{b}\t+\t{K}M\n" for a, b in links)
        with open(root / f"{gene}.tsv", "w") as f:
            for i, s in enumerate(seqs):
                copies = np.array([float(i + 1 in own) for own in strain])
                reads = rng.poisson((copies @ gamma) * (len(s) - 2 * K + 100) / 100 * 3)
                f.write(f"{i + 1}\t" + "\t".join(f"{x * 100 / ((len(s) - 2 * K + 100) * (100 / (100 - K + 1))):.4f}" for x in reads) + "\t\n")
        (root / f"{gene}.stops").write_text(f"{len(seqs)}\t+\t-1\n")
        truth[gene] = strain
    (root / "lengths.tsv").write_text("COG0001\t100\nCOG0002\t120.5\n")
    return root, truth


def test_gfa_round_trip(spark, community, tmp_path):
    root, _ = community
    unitigs, links = readers.gfa(spark, f"{root}/*.gfa")
    assert unitigs.count() == 20 and links.count() == 24 and {r.overlap for r in links.collect()} == {K}
    one = unitigs.where("gene = 'COG0001'")
    writers.gfa(one, links.where("gene = 'COG0001'"), f"{tmp_path}/COG0001")
    again, more = readers.gfa(spark, f"{tmp_path}/COG0001")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again.select("unitig", "seq", "kc", "len")) == key(one.select("unitig", "seq", "kc", "len"))
    assert more.count() == 12


def test_coverage_stops_and_lists(spark, community, tmp_path):
    root, _ = community
    cov = readers.coverage(spark, f"{root}/*.tsv").where("gene <> ''")
    assert cov.groupBy("gene").count().count() == 2 and cov.select("sample").distinct().count() == 6
    writers.coverage(cov.where("gene = 'COG0001'"), f"{tmp_path}/COG0001")
    again = readers.coverage(spark, f"{tmp_path}/COG0001", ",")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cov.where("gene = 'COG0001'").collect()))
    assert [tuple(r) for r in readers.stops(spark, f"{root}/COG0001.stops").collect()] == [("COG0001", 0, "10", True)]
    assert readers.gene_lengths(spark, f"{root}/lengths.tsv").count() == 2
    (tmp_path / "names").write_text("COG0001\n\nCOG0002")
    assert [r.gene for r in readers.names(spark, f"{tmp_path}/names").collect()] == ["COG0001", "COG0002"]
    (tmp_path / "x.stops").write_text("1\t+\t0\n")
    with pytest.raises(Exception, match="no gene"):
        readers.stops(spark, f"{tmp_path}/x.stops").collect()


def test_other_formats(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">7 LN:i:5 KC:i:9 km:f:1.8 L:+:8:- L:-:9:+\nACGTA\n>8 LN:i:4 KC:i:2\nAC\nGT\n")
    unitigs, links = readers.bcalm(spark, f"{tmp_path}/u.fa")
    assert [(r.unitig, r.seq, r.kc) for r in unitigs.orderBy("unitig").collect()] == [("7", "ACGTA", 9), ("8", "ACGT", 2)]
    assert sorted((r.src, r.src_fwd, r.dst, r.dst_fwd) for r in links.collect()) == [("7", False, "9", True), ("7", True, "8", False)]
    (tmp_path / "p.txt").write_text(">COG0001_0\n1+,2-,3+\n")
    assert [(r.gene, r.strain, r.pos, r.unitig, r.forward) for r in readers.haplotype_paths(spark, f"{tmp_path}/p.txt").collect()] == [("COG0001", "0", 0, "1", True), ("COG0001", "0", 1, "2", False), ("COG0001", "0", 2, "3", True)]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@a\nACGTACGT\n+\nIIIIIIII\n@b\nTTTT\n+\nIIII\n")
    assert [r.seq for r in readers.fastq(spark, f"{tmp_path}/r.fastq.gz").collect()] == ["ACGTACGT", "TTTT"]
    (tmp_path / "c.paths").write_text("NODE_1\n1+,2-;\n3+\nNODE_2\n4-\n")
    assert [(r.contig, r.pos, r.unitig) for r in readers.contig_paths(spark, f"{tmp_path}/c.paths").orderBy("contig", "pos").collect()] == [("NODE_1", 0, "1"), ("NODE_1", 1, "2"), ("NODE_1", 2, "3"), ("NODE_2", 0, "4")]
    (tmp_path / "a.tsv").write_text("u1\tr1\tr2\nu2\tr3\n")
    assert sorted(map(tuple, readers.reference_assignments(spark, f"{tmp_path}/a.tsv").collect())) == [("u1", "r1"), ("u1", "r2"), ("u2", "r3")]
    (tmp_path / "o.csv").write_text("u1,3,None,True\n")
    assert tuple(readers.unitig_order(spark, f"{tmp_path}/o.csv").first()) == ("u1", 3, None, True)
    (tmp_path / "b.csv").write_text("id,len,bin\nu1,5,2\nu2,7,3\n")
    assert sorted(map(tuple, readers.bins(spark, f"{tmp_path}/b.csv").collect())) == [("u1", 2), ("u2", 3)]


def test_sequences(spark):
    from pyspark.sql import functions as F

    s = spark.createDataFrame([("ACGTTN", True), ("acg", False)], "seq string, f boolean")
    assert [r[0] for r in s.select(sequence.reverse_complement(F.col("seq"))).collect()] == ["NAACGT", "gca"]
    assert [r[0] for r in s.select(sequence.reverse_complement(sequence.reverse_complement(F.col("seq")))).collect()] == ["ACGTTN", "acg"]
    reads = spark.createDataFrame([("r", "ACGT" * 8), ("s", "ACGT")], "read string, seq string")
    got = {r.kmer: r.n for r in sequence.kmer_composition(reads, 4).collect()}
    want: dict = {}
    for i in range(29):
        x = ("ACGT" * 8)[i : i + 4]
        want[min(x, revcomp(x))] = want.get(min(x, revcomp(x)), 0) + 1
    assert got == want


def test_whole_run_finds_both_strains(spark, community, tmp_path):
    root, truth = community
    cfg = pipeline.Config(str(root), K, str(tmp_path / "out_"), lengths=f"{root}/lengths.tsv", strains=3, restarts=2, iterations=80, filter_genes=False, elbow=False, min_cov=0.1)
    model, out = pipeline.run(spark, cfg)
    found = [{gene: [int(n[:-1]) for n in p] for gene, p in own.items()} for own in model.paths]
    for k in range(2):
        assert {g: truth[g][k] for g in truth} in found
    assert spark.read.csv(str(tmp_path / "out_Pred.csv"), header=True).count() == 20 * model.x.shape[1]
    names = {r.header for r in readers.fasta(spark, str(tmp_path / f"out_Haplo_{model.g}.fa")).collect()}
    assert names == {f"{g}_{k}" for g in truth for k in range(model.g)}
