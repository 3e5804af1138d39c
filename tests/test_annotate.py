from skein.operators import annotate, folds, graph, outliers


def test_colors_and_joined_genes(spark):
    paths = spark.createDataFrame([(s, g, i, u, True) for s, g, i, u in [("0", "COG1", 0, "1"), ("0", "COG1", 1, "2"), ("0", "COG2", 0, "7"), ("1", "COG1", 0, "1")]], "strain string, gene string, pos int, unitig string, forward boolean")
    colors = spark.createDataFrame([("0", "FF0000"), ("1", "0000FF")], "strain string, color string")
    got = {r.unitig: (r.color, r.strains) for r in annotate.segment_colors(paths, colors).collect()}
    assert got == {"1": ("7F007F", "0,1"), "2": ("FF0000", "0"), "7": ("FF0000", "0")}
    seg = spark.createDataFrame([("1",), ("9",)], "unitig string")
    assert {r.unitig: r.color for r in annotate.colored(seg, annotate.segment_colors(paths, colors)).collect()} == {"1": "7F007F", "9": annotate.GREY}
    segments, links = annotate.joined_genes(paths, 5)
    assert [(r.unitig, r.seq) for r in segments.collect()] == [("join_COG1_COG2_0", "NNNNN")]
    assert sorted((r.src, r.dst, r.overlap) for r in links.collect()) == [("COG1_2", "join_COG1_COG2_0", 0), ("join_COG1_COG2_0", "COG2_7", 0)]
    assert len(set(annotate.palette(7))) == 7


def test_bins_and_components(spark):
    paths = spark.createDataFrame([("c1", 0, "a"), ("c1", 1, "b"), ("c1", 2, "x"), ("c2", 0, "z")], "contig string, pos int, unitig string")
    bins = spark.createDataFrame([("a", 4), ("b", 2)], "unitig string, bin int")
    assert {r.contig: r.bin for r in annotate.contig_bins(paths, bins).collect()} == {"c1": 4, "c2": -1}
    links = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src int, dst int")
    got = {r.unitig: (r.component, r.rank) for r in annotate.segment_components(links).collect()}
    assert got == {"1": ("1", 1), "2": ("1", 1), "3": ("1", 1), "8": ("8", 2), "9": ("8", 2)}


def test_rooted_graph_drops_other_components(spark):
    e = spark.createDataFrame([("g", "1+", "2+"), ("g", "2+", "3+"), ("g", "3-", "2-"), ("g", "2-", "1-")], "gene string, u string, v string")
    node = lambda n: spark.createDataFrame([("g", n)], "gene string, node string")
    got = {(r.u, r.v) for r in graph.rooted(e, node("1+"), node("3+")).collect()}
    assert got == {("source+", "1+"), ("1+", "2+"), ("2+", "3+"), ("3+", "sink+")}


def test_removed_genes_close_over_maps_and_folds_cover(spark):
    maps = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "gene string, to string")
    assert {r.gene for r in outliers.closure_of_removed(spark.createDataFrame([("a",)], "gene string"), maps).collect()} == {"a", "b", "c"}
    cells = spark.createDataFrame([(v, s) for v in range(20) for s in range(10)], "v int, s int")
    dealt = folds.stratified_folds(cells, 5, "v", ["s"])
    assert folds.uncovered(dealt, "v", "s").where("kind = 'v'").count() == 0
    assert {r.fold for r in folds.uncovered(dealt, "v", "s").collect()} <= set(range(5))
