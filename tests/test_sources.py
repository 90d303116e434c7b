import json

import pytest
from pyspark.sql import functions as F

from arborix.functions import coordinates as C, sequence as Q, status
from arborix.kernels import columns as K, configurations as X
from arborix.sources import annotation, newick, project, sequences, tabular


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tsv(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('a\tb\tc\n1\t\t"x\nNA\ty y\t{"k": 1}\n')
    got = [tuple(r) for r in tabular.read_tsv(spark, str(p), required=["a"]).collect()]
    assert got == [("1", "", '"x'), ("NA", "y y", '{"k": 1}')]
    with pytest.raises(ValueError):
        tabular.read_tsv(spark, str(p), required=["z"])
    p.write_text("a\ta\n1\t2\n")
    with pytest.raises(ValueError):
        tabular.read_tsv(spark, str(p))
    p.write_text("a\tb\n1\t2\t3\n")
    with pytest.raises(Exception):
        tabular.read_tsv(spark, str(p)).collect()
    assert tabular.read_tsv(spark, str(tmp_path / "none.tsv"), optional=["q"]).count() == 0
    df = spark.createDataFrame([(1, [1, 2], None)], "n int, l array<int>, t string")
    out = str(tmp_path / "out")
    tabular.publish(df, out, lambda d, where: tabular.write_tsv(d, where, ["n", "l", "t", "missing"]))
    assert [tuple(r) for r in tabular.read_tsv(spark, out).collect()] == [("1", "[1,2]", "NA", "NA")]


def test_fasta(spark, tmp_path):
    p = tmp_path / "s.fa"
    p.write_text(">r1 first > one\nacg\nTTn\n>r2\r\nGG\r\n>r1 again\nAAAACCCC\n")
    got = {r.record_id: (r.description, r.sequence, r.length) for r in sequences.read_fasta(spark, str(p)).collect()}
    assert got == {"r1": ("r1 again", "AAAACCCC", 8), "r2": ("r2", "GG", 2)}
    cuts = spark.createDataFrame([("r1", 4, 6, "+"), ("r1", 4, 6, "-"), ("r1", 4, 60, "+"), ("zz", 1, 1, "+")], "r string, s int, e int, d string")
    assert [x.sequence for x in sequences.read_intervals(sequences.read_fasta(spark, str(p)), cuts, "r", "s", "e", "d").orderBy("r", "e", "d").collect()] == ["ACC", "GGT", None, None]


def test_gff(spark, tmp_path):
    p = tmp_path / "a.gff3"
    p.write_text('##gff\nc1\ts\tgene\t5\t90\t.\t+\t.\tID=g1;Name=a;Name=b\nc1\ts\tmRNA\t5\t90\t.\t+\t.\tID=t1;Parent=g1,g2\nc1\ts\texon\tx\t9\t.\t-\t.\tgene_id "g1"; transcript_id "t 1";\nshort\tline\n')
    g, t, e = annotation.read_gff(spark, str(p)).collect()
    assert (g.id, g.parent, g.attrs["Name"]) == ("g1", None, "b") and (t.id, t.parents, t.parent) == ("t1", ["g1", "g2"], "g1")
    assert e.start is None and e.parent == "t 1"
    assert one(spark, annotation.token_variants(F.lit("gene-ABC")).alias("x")).x == ["gene-ABC", "ABC"]


def test_newick(spark, tmp_path):
    rows = newick.parse("((A:0.1,'B b':0.2)x:0.3[note],C)r;")
    assert rows == [("node_1", None, "r", 0.0), ("node_2", "node_1", "x", 0.3), ("node_3", "node_2", "A", 0.1), ("node_4", "node_2", "B b", 0.2), ("node_5", "node_1", "C", None)]
    for bad in ("(A,B", "A)B;", "(A:-1,B);", "(A:x,B);", "A,B;", "(A);(B);"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    deep = newick.parse("(" * 5000 + "A" + ")" * 5000 + ";")
    assert len(deep) == 5001
    (tmp_path / "t.nwk").write_text("(A,B);\n\n(C,(D,E));\n")
    assert newick.read_newick(spark, str(tmp_path / "t.nwk")).groupBy("tree").count().count() == 2


def test_project_inputs(spark, tmp_path):
    (tmp_path / "og.tsv").write_text("Orthogroup\tS1\tS2\nOG1\ta, b\tc\nOG2\td\te\n")
    got = project.read_orthogroups(spark, str(tmp_path / "og.tsv"))
    assert sorted(tuple(r) for r in got.collect()) == [("OG1", "S1", "a"), ("OG1", "S1", "b"), ("OG1", "S2", "c"), ("OG2", "S1", "d"), ("OG2", "S2", "e")]
    assert {r.orthogroup: r.excluded for r in project.single_locus_groups(got).collect()} == {"OG1": "several_members_in_a_species", "OG2": None}
    (tmp_path / "og.txt").write_text("OG1: a b\nOG2: c\n")
    assert project.read_orthogroups(spark, str(tmp_path / "og.txt")).count() == 3
    (tmp_path / "m.tsv").write_text("species\tfamily_id\tgene_id\tgenome_fasta\tannotation_file\tgene_copy_id\nS\tF\tg\tx.fa\t/abs/y.gff\tNA\n")
    m = project.read_manifest(spark, str(tmp_path / "m.tsv")).first()
    assert (m.genome_fasta, m.annotation_file, m.gene_copy_id, m.case_id) == (f"{tmp_path}/x.fa", "/abs/y.gff", "S_g", "F")
    files = spark.createDataFrame([("d/A.fa.gz",), ("d/A.gff3",), ("B.fasta",), ("C.gtf",), ("D.txt",)], "path string")
    assert {r.species: r.problem for r in project.pair_species_files(files).collect()} == {"A": None, "B": "no_annotation", "C": "no_sequence"}
    good = {"family": "f", "unit": "u", "length": 9, "spans": [[0, 4]], "junctions": [[1, 3]], "tracts": [{"id": "m", "start": 0, "end": 9}]}
    lines = [json.dumps(good), '{"a": 1, "a": 2}', "no", json.dumps(good | {"spans": [[4, 99]]}), "{}"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = project.read_catalogues(spark, str(tmp_path / "c.jsonl"))
    assert [r.problem for r in rows.collect()][:4] == [None, "repeated key", "no JSON object", "span outside the unit"]
    project.catalogue_lines(rows.where("problem is null")).write.text(str(tmp_path / "c2"))
    assert project.read_catalogues(spark, str(tmp_path / "c2")).first().asDict() == rows.first().asDict()
    (tmp_path / "r.json").write_text(json.dumps({"provenance": "x", "rates": dict.fromkeys(X.KINDS, 0.1)}))
    assert project.read_rates(str(tmp_path / "r.json"))["split"] == 0.1
    (tmp_path / "r.json").write_text(json.dumps({"provenance": "x", "rates": {"split": 1}}))
    with pytest.raises(ValueError):
        project.read_rates(str(tmp_path / "r.json"))


def test_column_functions(spark):
    b = one(spark, C.blocks_from_text(F.lit("1-3:5-7;x;10-10:20-20")).alias("b"))["b"]
    assert [tuple(x) for x in b] == [(1, 3, 5, 7), (10, 10, 20, 20)]
    assert one(spark, C.blocks_to_text(C.blocks_from_text(F.lit("1-3:5-7;10-10:20-20"))).alias("t")).t == "1-3:5-7;10-10:20-20"
    g = one(spark, C.genomic_block(F.lit("a:b:3-9:-")).alias("g"), C.genomic_block(F.lit("a:3-9")).alias("h"))
    assert tuple(g.g) == ("a:b", 3, 9, "-") and g.h is None
    s = one(spark, Q.ungapped_identity(F.lit("ACGUN"), F.lit("ACCTA")).alias("i"), Q.occurrences(F.lit("AAAA"), F.lit("AA")).alias("n"), Q.translate_codons(F.lit("ATGTAANNNA")).alias("p"), Q.reverse_complement(F.lit("acgtn")).alias("r"))
    assert (s.i, s.n, s.p, s.r) == (0.75, 3, "M*X", "NACGT")
    c = one(spark, Q.cigar_lengths(F.lit("3MI2D4=SH")).alias("c"), Q.transpose_cigar(F.lit("3MI2D")).alias("t"))
    assert tuple(c.c) == (9, 9, 7, 3) and c.t == "3MD2I"
    v = one(spark, status.state(F.lit(" ? ")).alias("s"), status.confidence(F.lit("High")).alias("h"), status.confidence(F.lit("x")).alias("x"), status.number(F.lit("nan"), 2.0).alias("n"), status.key_of(F.lit("a"), F.lit(None), F.lit("")).alias("k"))
    assert (v.s, v.h, v.x, v.n, v.k) == ("unknown", 0.95, 0.5, 2.0, '["a",null,""]')


def test_aligned_columns():
    assert K.column_map("A-C--G").tolist() == [0, 2, 5] and K.runs("A--C-") == [(1, 3), (4, 5)]
    assert K.supported_runs("ACN-GT", "ACGTG-") == [(0, 2), (4, 5)]
    assert K.paired_support("ACGT", "ACCN", 0, 4) == (3, 2 / 3)
    flank = "ACGTACGTACGT"
    rows = {"a": flank + "---" + flank, "b": flank + "GGG" + flank, "c": "T" * 27}
    assert K.gap_qualified(rows, "a", 12, 15) and not K.gap_qualified({"a": rows["a"], "c": rows["c"]}, "a", 12, 15) and not K.gap_qualified(rows, "b", 12, 15)
    assert K.best_hit("ANG", "TTACGAAG") == (3, 2 / 3) and K.best_hit("AAAA", "A") is None


def test_paths_between_states():
    c = X.Catalogue(100, ((0, 100), (0, 40), (60, 100)), ((40, 60),), (), ((0, 100), (0, 40), (60, 100)))
    space = X.enumerate_space(c)
    d = X.edit_distances(space)

    def every(s, t):
        if s == t:
            yield []
        for i, j, k, o, _ in space.edits:
            if i == s and d[s, t] == 1 + d[j, t]:
                yield from ([space.identity(i, j, k, o), *p] for p in every(j, t))

    for s in range(len(space.states)):
        for t in range(len(space.states)):
            ways = list(every(s, t))
            want = {k: (min(w.count(k) for w in ways), max(w.count(k) for w in ways)) for k in {k for w in ways for k in w}}
            assert X.event_bounds(space, d, s, t) == want
            assert [k for k, _ in X.witness(space, d, s, t)] in [[e.split()[0] for e in w] for w in ways]


def test_run_records(tmp_path):
    from arborix.sources.runs import Run, write_json

    p = tmp_path / "run.json"
    with Run(p, command="x") as run:
        assert json.loads(p.read_text())["status"] == "running"
        run.artifact("t", "/t", 3)
    assert json.loads(p.read_text()) | {"started": 0, "ended": 0} == {"status": "completed", "command": "x", "artifacts": {"t": {"path": "/t", "rows": 3}}, "started": 0, "ended": 0}
    with pytest.raises(KeyError):
        with Run(p):
            raise KeyError("lost")
    assert json.loads(p.read_text())["status"] == "failed"
    write_json(p, {"b": float("nan"), "a": [float("inf"), 1.5]})
    assert p.read_text() == '{\n "a": [\n  null,\n  1.5\n ],\n "b": null\n}\n' and len(list(tmp_path.iterdir())) == 1
