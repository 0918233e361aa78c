import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandframe.functions import accession as ACC
from strandframe.functions import interval as I
from strandframe.functions import orf as O
from strandframe.functions import sequence as S
from strandframe.operators import intervals as IV
from strandframe.operators import relational as R
from strandframe.operators import stats as ST


def values(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_sequence_goldens(spark):
    lit = F.lit
    assert values(spark, S.reverse_complement(lit("AaCGTNry-")), S.reverse_complement(lit("AX")), S.reverse_complement(lit("Uu."))) == ("-ryNACGtT", "NT", "NAA".replace("AA", "aA"))
    assert values(spark, S.normalize_dna(lit("acguN-x?")), S.normalize_dna(lit("ryswkmbdhvu"))) == ("ACGTN-X?", "RYSWKMBDHVT")
    assert values(spark, S.translate(lit("GATCGCGAATGAN")), S.translate(lit("ATGTGATAA"), 4), S.translate(lit("AC")), S.translate(lit("ATG"), 99)) == ("DRE*", "MW*", "", "X")
    assert values(spark, S.translate_codon(lit("atg")), S.translate_codon(lit("AT")), S.is_start_codon(lit("GTG"), 4), S.is_start_codon(lit("TTA"), 11)) == ("M", "X", True, False)
    assert values(spark, S.quality_profile(lit(12)), S.quality_profile(lit(4))) == ("IIIIHGFEDCBA", "DCBA")
    assert values(spark, *S.remove_dashes(lit("A-C--GT"), lit("1234567"))) == ("ACGT", "1367")
    assert values(spark, S.fasta_text(lit("r"), lit(""), lit("ACGT"), 3), S.fasta_text(lit("empty"), lit(""), lit(""), 4)) == (">r\nACG\nT\n", ">empty\n\n")
    assert values(spark, *S.parse_header(lit("  r1\tspaced   desc  ")), *S.parse_header(lit("r1 unicode desc"))) == ("r1", "spaced desc", "r1", "unicode desc")
    assert values(spark, S.record_text(lit("r"), lit("d"), lit("AC"), lit("IH")), S.record_text(lit("r"), lit("d"), lit("AC"), lit(None).cast("string"))) == ("@r d\nAC\n+\nIH\n", ">r d\nAC\n")
    assert values(spark, S.with_suffix(lit("a/1"), "/1"), S.with_suffix(lit("a"), "/1"), S.read_number(lit("ERR1_2")), S.read_number(lit("12"))) == ("a/1", "a/1", "_2", "")
    assert values(spark, S.human_bytes(lit(10)), S.human_bytes(lit(1536)), S.human_bytes(lit(3 << 30))) == ("10 B", "1.5 KiB", "3.0 GiB")
    assert values(spark, *S.from_alignment(lit(16), lit("ATGC"), lit("ABCD"))) == ("GCAT", "DCBA")


WRONG = [
    lambda: S.subseq(F.lit("ACGT"), 2, 5),
    lambda: S.checked_quality(F.lit("AC"), F.lit("I")),
    lambda: ACC.strand_number(F.lit("?")),
    lambda: ACC.expand_range(F.lit("A1"), F.lit("B2")),
    lambda: ACC.expand_range(F.lit("A1.1"), F.lit("A2.2")),
    lambda: I.interval(F.lit(3), F.lit(2))["start"],
]


@pytest.mark.parametrize("column", WRONG)
def test_wrong_input_is_an_error(spark, column):
    with pytest.raises(PySparkException):
        values(spark, column())


def test_accessions(spark):
    lit = F.lit
    wanted = {"WP_000001.1": "protein", "AAA98665.1": "protein", "U49845.1": "nuccore", "nc_000913.3": "nuccore", "ABCD00000000": "nuccore", "ABCD01": "nuccore", "ABCDEF123456789": "nuccore", "what": "sequences", "GCF_1": "sequences"}
    assert values(spark, *(ACC.database(lit(a)) for a in wanted)) == tuple(wanted.values())
    rows = spark.createDataFrame([("U49845.1",), ("WP_1",)], "a string")
    assert rows.agg(ACC.database_of_all(F.col("a"))).first()[0] == "sequences" and rows.limit(1).agg(ACC.database_of_all(F.col("a"))).first()[0] == "nuccore"
    assert values(spark, ACC.expand_range(lit("AB008.1"), lit("AB011.1")), ACC.expand_range(lit("X9"), lit("X9"))) == (["AB008.1", "AB009.1", "AB010.1", "AB011.1"], ["X9"])
    assert values(spark, *ACC.range_from_locus(lit("ABCD0000"), lit(12345))) == ("ABCD0001", "ABCD12345")


def plain_orfs(seq, starts, least):
    out = []
    for frame in range(3):
        for i in range(frame, len(seq) - 2, 3):
            if seq[i : i + 3] in starts:
                stop = next((j for j in range(i + 3, len(seq) - 2, 3) if seq[j : j + 3] in S.STOPS), None)
                if stop is not None and stop + 3 - i >= least:
                    out.append((i, stop + 3, frame))
    return out


def test_orfs_match_a_plain_scan(spark):
    r = random.Random(1)
    seqs = ["".join(r.choices("ACGTN", [3, 2, 3, 4, 0.3], k=r.randint(0, 90))) for _ in range(80)]
    for s in seqs:
        assert O.strand_orfs(s, {"ATG", "TTG"}, 9) == plain_orfs(s, {"ATG", "TTG"}, 9)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, seq string")
    for row in df.select("k", O.find_orfs(F.col("seq"), O.OrfOptions(6)).alias("o")).collect():
        s = seqs[row["k"]]
        turned = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want = [(a, e, f, "+") for a, e, f in plain_orfs(s, {"ATG"}, 6)] + [(len(s) - e, len(s) - a, f, "-") for a, e, f in plain_orfs(turned, {"ATG"}, 6)]
        assert [(o["start"], o["end"], o["frame"], o["strand"]) for o in row["o"]] == want
    assert O.OrfOptions(start_codons=("uug", "UUG")).starts() == {"ATG", "UUG", "TTG"}


def test_genes(spark):
    gene = lambda s: values(spark, O.make_gene(F.lit(s)))[0]
    assert tuple(gene("TTACAA")) == ("TTGTAA", "-", 0)
    assert tuple(gene("ATGTAA")) == ("ATGTAA", "+", 0) and tuple(gene("cAUGGGGTAGc")) == ("ATGGGGTAG", "+", 1)
    assert gene("ATG") is None and gene("ATGTAATAA") is None and gene("") is None


def test_gaps_and_merging(spark):
    assert [tuple(x) for x in values(spark, IV.gap_runs(F.lit("AA--NN.TT"), 2))[0]] == [(2, 7)]
    assert [tuple(x) for x in values(spark, IV.gap_runs(F.lit("NA.n"), 0))[0]] == [(0, 1), (2, 4)] and values(spark, IV.gap_runs(F.lit("")))[0] == []
    rows = spark.createDataFrame([(10, 12), (2, 4), (3, 8), (8, 9), (20, 21)], "start int, end int")
    merged = IV.merge(rows)
    assert sorted(map(tuple, merged.collect())) == [(2, 9), (10, 12), (20, 21)] and IV.total_length(merged).first()[0] == 10


def test_overlap_join_matches_nested_loops(spark):
    r = random.Random(3)
    a = [(r.randint(0, 2), s, s + r.randint(0, 60)) for s in (r.randint(0, 200) for _ in range(120))]
    b = [(r.randint(0, 2), s, s + r.randint(0, 60)) for s in (r.randint(0, 200) for _ in range(120))]
    got = IV.overlap_join(spark.createDataFrame(a, "key int, start int, end int"), spark.createDataFrame(b, "key int, b_start int, b_end int"), ["key"], 16)
    want = [(k, s, e, p, q) for k, s, e in a for k2, p, q in b if k == k2 and s < e and p < q and s < q and p < e]
    assert sorted(tuple(x) for x in got.select("key", "start", "end", "b_start", "b_end").collect()) == sorted(want)


RECORD = "dataset string, ordinal long, name string, description string, seq string, qual string"


def test_statistics_goldens(spark):
    seqs = {"a": "NNAAAAAA", "b": "AAAAAA", "c": "AAAA", "d": "NN", "e": "A"}
    df = spark.createDataFrame([("f", k, n, "", s, None) for k, (n, s) in enumerate(seqs.items())], RECORD)
    row = ST.assembly_stats(df, 1).first()
    human = "stats for f\nsum = 21, n = 5, ave = 4.20, largest = 8\nN50 = 6, n = 2\nN60 = 6, n = 2\nN70 = 4, n = 3\nN80 = 4, n = 3\nN90 = 2, n = 4\nN100 = 1, n = 5\nN_count = 4\nGaps = 2\n"
    assert ST.render([row]) == human
    assert ST.render([row], "tab") == "filename\ttotal_length\tnumber\tmean_length\tlongest\tshortest\tN_count\tGaps\tN50\tN50n\tN70\tN70n\tN90\tN90n\nf\t21\t5\t4.20\t8\t1\t4\t2\t6\t2\t4\t3\t2\t4\n"
    assert "f\tn10\t8\nf\tn10n\t1\n" in ST.render([row], "greppy") and ST.render([], "tab") == ""
    longer = ST.assembly_stats(df, 5).first()
    assert (longer["total_length"], longer["number"], longer["shortest"], longer["longest"]) == (14, 2, 6, 8)
    empty = ST.assembly_stats(df, 100).first()
    assert empty["filename"] == "f" and empty["total_length"] == empty["n50"] == empty["n50n"] == 0
    blank = ST.assembly_stats(spark.createDataFrame([("g", 0, "x", "", "", None)], RECORD), 0).first()
    assert (blank["number"], blank["n10"], blank["n10n"]) == (1, 0, 1)


def test_equal_lengths_count_within(spark):
    df = spark.createDataFrame([("f", k, str(k), "", "A" * 10, None) for k in range(10)], RECORD)
    row = ST.assembly_stats(df).first()
    assert [row[f"n{k}0n"] for k in range(1, 10)] == list(range(1, 10)) and row["n90"] == 10


def test_interleaving(spark):
    one = spark.createDataFrame([("f", 0, "r1", "", "AC", "II"), ("f", 1, "r2/1", "", "AC", "II")], RECORD)
    got = R.interleave(one, one.withColumn("name", F.replace("name", F.lit("/1"), F.lit("/2"))), "/1", "/2").orderBy("ordinal")
    assert [r["name"] for r in got.collect()] == ["r1/1", "r1/2", "r2/1", "r2/2"]
    with pytest.raises(PySparkException, match="without a partner"):
        R.interleave(one, one.limit(1)).collect()
    with pytest.raises(PySparkException, match="duplicate sequence name"):
        R.unique_names(one.withColumn("name", F.lit("x"))).collect()
    with pytest.raises(ValueError):
        R.pair_format(True, False)
    upper = R.transform_records(one, lambda r: None if r["ordinal"] else r | {"seq": "T"})
    assert [(r["name"], r["seq"]) for r in upper.collect()] == [("r1", "T")] and R.transform_records(one, None) is one


def test_a_lone_record_is_an_error_whatever_is_read(spark):
    one = spark.createDataFrame([(0, "a", "", "AC", None), (1, "b", "", "GT", None)], "ordinal long, name string, description string, seq string, qual string")
    for pair in ((one, one.limit(1)), (one.limit(1), one)):
        rows = R.interleave(*pair)
        for act in (rows.count, rows.select("seq").collect, rows.select("mate").collect):
            with pytest.raises(Exception, match="without a partner"):
                act()


def test_translations_equal_translate(spark):
    seqs = ["GATCGCGAATGAN", "", "ac", None, "atgUGAuga", "ATÉGTG", "--ATGNNN"]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").select("seq", S.translations("seq", (1, 4, 11, 99)).alias("t"), *(S.translate("seq", c).alias(f"e{c}") for c in (1, 4, 11, 99))).collect()
    for r in rows:
        for c in (1, 4, 11):
            assert r["t"][f"code_{c}"] == r[f"e{c}"], r
        assert r["t"]["code_99"] == (None if r["seq"] is None else "X")


def test_gap_runs_of_odd_columns(spark):
    rows = spark.createDataFrame([("--A",), (None,), ("",), ("É--n",), ("-",), ("-A-",)], "seq string").select(IV.gap_runs(F.col("seq")).alias("g")).collect()
    assert [None if r["g"] is None else [tuple(x) for x in r["g"]] for r in rows] == [[(0, 2)], None, [], [(1, 4)], [(0, 1)], [(0, 1), (2, 3)]]


def test_runs_of_one_layout_are_merged(spark):
    t = spark.createDataFrame([(1, "A")], "ordinal long, seq string")
    assert [r["run_index"] for r in R.merge_runs([t, t], [("PAIRED", ".fastq.gz")] * 2).collect()] == [0, 1]
    with pytest.raises(ValueError, match="layout"):
        R.merge_runs([t, t], [("PAIRED", ".fastq.gz"), ("SINGLE", ".fastq.gz")])
    with pytest.raises(ValueError):
        R.merge_runs([])


def test_unpaired_files_are_an_error(spark):
    own = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run string, position int, filename string")
    assert R.pair_files(own, own).count() == 2
    with pytest.raises(Exception, match="without a partner"):
        R.pair_files(own, own.limit(1)).count()
