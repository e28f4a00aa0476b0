"""Text formats written and read again, and operators that only these tests and their queries reach."""

from loamtree import queries
from loamtree.sources import text


def test_new_queries_are_registered():
    assert {"masked_sites", "bootstrap_sites", "tree_topologies"} <= set(queries.QUERIES)


def test_sites_file(spark, tmp_path):
    rows = [("c", 3, "AC"), ("c", 9, "GG"), ("c", 10, "ACG"), ("d", 1, "AA"), ("c", 12, "AX"), ("c", 9, "GT")]
    text.write_sites(spark.createDataFrame(rows, "chrom string, pos long, col string"), ["n1", "n2"], "c", 0, 20, f"{tmp_path}/s")
    sites, names = text.read_sites(spark, f"{tmp_path}/s")
    assert sorted(r[1:] for r in map(tuple, sites.collect())) == sorted(r for r in rows if r[0] == "c")
    assert sorted((r.place, r.name) for r in names.collect()) == [(0, "n1"), (1, "n2")]
    assert sorted((r.pos, r.reason) for r in text.site_violations(sites, names).collect()) == [(9, "repeated position"), (9, "repeated position"), (10, "width"), (12, "symbol")]


def test_smc_file(spark, tmp_path):
    trees = [("c", 0, 5, "(0,1)2;"), ("c", 5, 9, "(1,0)2;")]
    edits = [("c", 5, 0, 1.5, 1, 2.5)]
    text.write_smc(
        spark.createDataFrame(trees, "chrom string, start long, stop long, newick string"),
        spark.createDataFrame(edits, "chrom string, pos long, recomb_node int, recomb_time double, coal_node int, coal_time double"), ["n1", "n2"], "c", f"{tmp_path}/t",
    )
    found = [sorted(map(tuple, x.drop("sample").collect())) for x in text.read_smc(spark, f"{tmp_path}/t")]
    assert found == [trees, edits, [(0, "n1"), (1, "n2")]]


def test_fasta_file(spark, tmp_path):
    rows = [("a", "ACGT"), ("b c", "AGGA")]
    text.write_fasta(spark.createDataFrame(rows, "name string, seq string"), f"{tmp_path}/f")
    found = text.read_fasta(spark, f"{tmp_path}/f")
    assert sorted((r.name, r.seq) for r in found.collect()) == rows
    places = found.selectExpr("IF(name = 'a', 0, 1) AS place", "seq")
    assert sorted(map(tuple, text.fasta_to_sites(places, "c").collect())) == [("c", 1, "CG"), ("c", 3, "TA")]


def test_arg_file(spark, tmp_path):
    (tmp_path / "x.arg").write_text("start=0\tend=9\nname\tevent\tage\tpos\tparents\tchildren\n3\tcoal\t2.5\t0\t\t1,2\n1\tgene\t0\t0\t3\t\n")
    found = sorted((r.name, r.event, r.age, r.pos, list(r.parents), list(r.children)) for r in text.read_arg(spark, f"{tmp_path}/x.arg").collect())
    assert found == [("1", "gene", 0.0, 0.0, ["3"], []), ("3", "coal", 2.5, 0.0, [], ["1", "2"])]


def test_no_simulator():
    assert "simulated_trees" not in queries.QUERIES


def test_leaves_are_renamed(spark):
    from loamtree.sources.newick import parse_newick

    trees = spark.createDataFrame([(1, "(0:1,(1:0.5,2:0.5)4:0.5)3;")], "start long, newick string").withColumn("tree", parse_newick("newick"))
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, name string")
    assert sorted(text.renamed_leaves(trees, names).first().names) == ["3", "4", "a", "b", "c"]


def test_layout_of_a_region(spark, tmp_path):
    rows = spark.createDataFrame([("c", 0, 10, {"x": 1.5, "y": -2.0}), ("c", 10, 20, {"y": 0.0}), ("d", 0, 10, {"x": 3.0})], "chrom string, start long, stop long, ys map<string,double>")
    text.write_layout(rows, f"{tmp_path}/layout")
    assert sorted((r.chrom, r.start, r.stop, r.ys) for r in text.read_layout(spark, f"{tmp_path}/layout").collect()) == sorted((r.chrom, r.start, r.stop, r.ys) for r in rows.collect())
    assert [(r.start, r.ys) for r in text.read_layout(spark, f"{tmp_path}/layout", ("c", 10, 11)).collect()] == [(10, {"y": 0.0})]


def test_short_lists(spark, tmp_path):
    (tmp_path / "times").write_text("0\n10.5\n\n 200 \n")
    assert text.read_lines(spark, f"{tmp_path}/times") == ["0", "10.5", "200"]


def test_long_files_go_in_ranges(spark, tmp_path):
    """Many parts, each with its header, are read back as one set; without lines there is nothing."""
    rows = [("c", p, "ACGT"[p % 4] * 2) for p in range(0, 4000, 2)]
    frame = spark.createDataFrame(rows, "chrom string, pos long, col string")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        text.write_sites(frame, ["n1", "n2"], "c", 0, 5000, f"{tmp_path}/s")
        text.write_sites(frame.limit(0), ["n1", "n2"], "c", 0, 5000, f"{tmp_path}/none")
    finally:
        spark.conf.set(conf, before)
    assert len(list((tmp_path / "s").glob("part-*"))) > 3
    sites, names = text.read_sites(spark, f"{tmp_path}/s")
    assert sorted(r[1:] for r in map(tuple, sites.collect())) == rows
    assert text.site_violations(sites, names).count() == 0 and {r.name for r in names.collect()} == {"n1", "n2"}
    assert text.read_sites(spark, f"{tmp_path}/none")[0].count() == 0 and text.read_sites(spark, f"{tmp_path}/none")[1].count() == 0
    assert text.variable_sites(spark.createDataFrame([("AA",), ("AC",), ("NN",), ("NA",)], "col string")).count() == 2
