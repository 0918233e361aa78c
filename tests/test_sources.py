import bz2
import gzip
import hashlib
import io
import json
import lzma
import os
import struct
import subprocess
import sys
import urllib.parse
import zipfile
import zlib
from dataclasses import replace

import pytest
import zstandard

from strandframe import cli
from strandframe.sources import codecs, datasource, formats, reads, remote, sniff
from strandframe.streaming import landing

GENBANK = "LOCUS       REC1 8 bp\nDEFINITION  first line\n            second line\nACCESSION   X\nORIGIN\n        1 acgt nn\n//\n"
EMBL = "ID   REC1; SV 1;\nDE   first line\nDE   second line\nSQ   Sequence 6 BP;\n     acgt nn        6\n//\n"
CLUSTAL = "CLUSTAL W (1.83)\n\nseq1 ACGT--\nseq2 AC-TGG\n     ** *\n\nseq1 AA 8\nseq2 TT 8\n"
TEXTS = {
    "fasta": (">a desc\nACGT\n>b\nT\nT\n", [("a", "desc", "ACGT", None), ("b", "", "TT", None)]),
    "fastq": ("@r1 desc\nACGT\n+\nABCD\n@r2\nNNNN\n+\n!!!!\n", [("r1", "desc", "ACGT", "ABCD"), ("r2", "", "NNNN", "!!!!")]),
    "sam": ("@HD\tVN:1.6\nread1\t16\tref\t1\t60\t4M\t*\t0\t0\tATGC\tABCD\n", [("read1", "", "GCAT", "DCBA")]),
    "phylip": ("2 8\nseq1 ACGT\nAA--\nseq2 TT\nAA\nCCGG\n", [("seq1", "", "ACGTAA--", None), ("seq2", "", "TTAACCGG", None)]),
    "clustal": (CLUSTAL, [("seq1", "", "ACGT--AA", None), ("seq2", "", "AC-TGGTT", None)]),
    "genbank": (GENBANK, [("REC1", "first line second line", "acgtnn", None)]),
    "embl": (EMBL, [("REC1", "first line second line", "acgtnn", None)]),
    "gff3": ("##gff-version 3\nchr1\t.\tgene\t1\t4\t.\t+\t.\tID=x\n##FASTA\n>chr1 desc\nACGT\n>chr2\nNNNN\n", [("chr1", "desc", "ACGT", None), ("chr2", "", "NNNN", None)]),
}
PACK = {"none": bytes, "gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize("pack", PACK)
def test_formats(kind, pack):
    text, want = TEXTS[kind]
    assert sniff.sniff(text.encode()) == kind
    assert list(formats.records(io.BytesIO(PACK[pack](text.encode())))) == want


def test_sniffing():
    assert sniff.sniff(b"\n  >r1\nACGT\n") == "fasta" and sniff.sniff(b"read1\t16\t*\t0\t0\t*\t*\t0\t0\tACGT\t!!!!\n") == "sam"
    for bad in (b" \n\t\r", b"not a known format\n", b"@r\nAC\n"):
        with pytest.raises(ValueError):
            sniff.sniff(bad)


@pytest.mark.parametrize("text", ["@r1\nACGT\n+\nABC\n", "@r1\nACGT\nx\nABCD\n@", "2 4\na AC\n", "##gff-version 3\n", "##gff-version 3\n##FASTA\n", "CLUSTAL\n\nseq1\n", "LOCUS a\nLOCUS b\n"])
def test_damaged_input(text):
    with pytest.raises(ValueError):
        list(formats.records(io.BytesIO(text.encode())))


def test_cut_off_fastq():
    text = b"@r1\nAC\n+\nII\n@r2\nAC\n+\n"
    assert len(list(formats.records(io.BytesIO(text)))) == 1
    with pytest.raises(ValueError, match="cut off"):
        list(formats.records(io.BytesIO(text), strict=True))


def bgzf(data: bytes) -> bytes:
    out = b""
    for part in (data[: len(data) // 2], data[len(data) // 2 :], b""):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam_record(name, flag, seq, qual):
    codes = [formats.BAM_BASES.index(c) for c in seq.encode()]
    packed = bytes((a << 4) | b for a, b in zip(codes[::2], codes[1::2] + [0] * (len(codes) % 2)))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + bytes(qual or [255] * len(seq))
    return struct.pack("<i", len(body)) + body


def test_bam():
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"ref\0" + struct.pack("<i", 99)
    data += bam_record("r1", 16, "ACGT", [30, 31, 32, 33]) + bam_record("r2", 0, "TTAAC", None)
    assert list(formats.records(io.BytesIO(bgzf(data)))) == [("r1", "", "ACGT", "BA@?"), ("r2", "", "TTAAC", None)]


def test_data_source(spark, tmp_path):
    for kind in ("fasta", "fastq", "genbank"):
        (tmp_path / f"x.{kind}").write_bytes(gzip.compress(TEXTS[kind][0].encode()))
    got = datasource.read(spark, str(tmp_path)).orderBy("dataset", "ordinal").collect()
    assert [(r["name"], r["description"], r["seq"], r["qual"]) for r in got] == [r for k in ("fasta", "fastq", "genbank") for r in TEXTS[k][1]]
    again = datasource.read_binary(spark, f"file://{tmp_path}/x.fastq").orderBy("ordinal").collect()
    assert [r["qual"] for r in again] == ["ABCD", "!!!!"]
    fastq = datasource.read(spark, str(tmp_path / "x.fastq"))
    for codec in PACK:
        fastq.write.format("seqs").mode("overwrite").option("sequenceFormat", "fastq").option("compression", codec).save(str(tmp_path / f"out-{codec}"))
        assert sorted(r["name"] for r in datasource.read(spark, str(tmp_path / f"out-{codec}")).collect()) == ["r1", "r2"]
    assert datasource.write_file(fastq, str(tmp_path / "one.fa.gz"), wrap=3) == 2
    assert gzip.decompress((tmp_path / "one.fa.gz").read_bytes()) == b">r1 desc\nACG\nT\n>r2\nNNN\nN\n"


def test_split_fasta(spark, tmp_path):
    text = "".join(f">s{k} d\n{'ACGT' * (k % 7)}\nTT\n" for k in range(60))
    (tmp_path / "big.fa").write_text(text)
    for size in (7, 50, 333, 10_000):
        got = datasource.read(spark, str(tmp_path / "big.fa"), split="true", splitBytes=str(size)).orderBy("ordinal").collect()
        assert [(r["name"], r["seq"]) for r in got] == [(f"s{k}", "ACGT" * (k % 7) + "TT") for k in range(60)]


def test_command_line(spark, tmp_path, capsysbinary, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    a, b, out = (str(tmp_path / n) for n in ("a.fa", "b.fa", "out.fa"))
    (tmp_path / "a.fa").write_text(">r1\nAC-GT\n>r2\nNN\n")
    (tmp_path / "b.fa").write_text(">r1\nGG\n>r2\nTT\n")
    cli.main(["to-fasta", a, "-o", out, "--remove-dashes"])
    assert (tmp_path / "out.fa").read_text() == ">r1\nACGT\n>r2\nNN\n"
    cli.main(["interleave", a, b, "-o", out, "--suffix1", "/1", "--suffix2", "/2"])
    assert [x for x in (tmp_path / "out.fa").read_text().split("\n") if x.startswith(">")] == [">r1/1", ">r1/2", ">r2/1", ">r2/2"]
    cli.main(["stats", "-u", a, b])
    assert capsysbinary.readouterr().out.decode().splitlines()[0].startswith(f"{a}\t7\t2\t3.50\t5\t2\t2\t1")
    cli.main(["make-random-contigs", "3", "5", "--prefix", "c", "-o", out])
    assert [len(x) for x in (tmp_path / "out.fa").read_text().split("\n")] == [3, 5, 3, 5, 3, 5, 0]
    cli.main(["make-random-contigs", "4", "50", "-o", a, "--name-by-letters"])
    cli.main(["to-perfect-reads", a, "-1", b, "-2", out, "--mean-insert", "20", "--insert-std", "1", "--read-length", "10", "--coverage", "2"])
    assert (tmp_path / "b.fa").read_text().count("\n") == (tmp_path / "out.fa").read_text().count("\n") == 4 * 4 * 5


def test_command_line_errors_and_empty_inputs(spark, tmp_path, capsysbinary):
    fasta, empty = tmp_path / "a.fa", tmp_path / "none.fa"
    fasta.write_text(">a\nACGTNN\n")
    empty.write_text(">only-a-name\n")
    with pytest.raises(SystemExit, match="sample"):
        cli.main(["to-fasta", "-i", str(fasta), "--sample", "x"])
    with pytest.raises(SystemExit, match="both"):
        cli.main(["to-perfect-reads", str(fasta), "-1", str(tmp_path / "f")])
    capsysbinary.readouterr()
    cli.main(["stats", "-t", str(fasta), str(empty)])
    lines = capsysbinary.readouterr().out.decode().splitlines()
    assert len(lines) == 3 and lines[2].split("\t")[1:5] == ["0", "0", "0.00", "0"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">x\nACGTN\n>y\nAC\n")
    rows = landing.read_stream(spark, f"file://{folder}")
    q = landing.running_totals(rows).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("totals").first()
    assert (got["total_length"], got["number"], got["n_count"]) == (7, 2, 1)
    landing.write_stats(rows, str(tmp_path / "stats"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stats")).first()["n50"] == 5


def test_downloads(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        if "ipg" in url:
            head = "Id\tSource\tNucleotide Accession\tStart\tStop\tStrand\tProtein\tName\tOrganism\tStrain\tAssembly\n"
            return (head + "1\tRefSeq\tNC_1\t5\t9\t-\tWP_1\tp\to\ts\tGCF_1\n1\tINSDC\tN/A\t\t\t\tWP_1\tp\to\ts\tGCA_1\n").encode()
        if "retmode=xml" in url:
            return b"<GBSet><GBSeq><GBSeq_locus>ABCD01000000</GBSeq_locus><GBSeq_length>3</GBSeq_length></GBSeq></GBSet>"
        if "datasets" in url:
            z = io.BytesIO()
            with zipfile.ZipFile(z, "w") as f:
                f.writestr("d/x.fna", ">c\nAC\n")
                f.writestr("d/x.gff", "##gff-version 3\n\n")
            return z.getvalue()
        return b">x\nA\n"

    out = str(tmp_path / "o")
    remote.download(remote.plan(["U49845.1", "U49846"]), out, get)
    assert "db=nuccore" in asked[-1] and "U49845.1%2CU49846" in asked[-1]
    remote.download(remote.plan(["WP_1"]), out, get, nucleotide="first")
    assert "seq_start=5" in asked[-1] and "strand=2" in asked[-1]
    remote.download(remote.plan(["ABCD01000000"]), out, get)
    assert "ABCD01000000" in asked[-1]
    remote.download(remote.plan(["ABCD00000000"]), out, get)
    assert "ABCD01000001%2CABCD01000002%2CABCD01000003" in asked[-1]
    remote.download(remote.plan(["GCF_1"], "gff3"), out, get)
    assert (tmp_path / "o").read_bytes() == b"##gff-version 3\n##FASTA\n>c\nAC\n"
    for bad in (lambda: remote.plan(["GCF_1", "U49845"]), lambda: remote.plan([" "]), lambda: remote.plan(["GCF_1"], "doc"), lambda: reads.accession_list("a,,b", None), lambda: remote.plan(["X1"], db="genes"), lambda: remote.expand("A1", "A10")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(remote.NotFound):
        remote.genome("X", "embl", lambda u: b"ERROR: none")
    with pytest.warns(UserWarning, match="named like fasta and holds gff3"):
        remote.download(remote.plan(["GCF_1"]), str(tmp_path / "g.fa.gz"), get)
    assert gzip.decompress((tmp_path / "g.fa.gz").read_bytes()).startswith(b"##gff-version 3")
    with pytest.raises(ValueError):
        remote.download(remote.plan(["WP_1"]), out, get, source="genes")


class Runs:
    """A service of runs with two gzip files each, whose second member is the run's name."""

    def __init__(self, names=("_1.fastq.gz", "_2.fastq.gz"), faults=0):
        self.names, self.faults, self.pauses = names, faults, []

    def data(self, name):
        return gzip.compress(b"@x\n" * 5000, mtime=0) + gzip.compress(name.encode(), mtime=0)

    def get(self, url):
        run = urllib.parse.parse_qs(urllib.parse.urlsplit(url).query)["accession"][0]
        files = [run + n for n in self.names]
        row = {"run_accession": run, "fastq_ftp": ";".join(f"h/{f}" for f in files), "fastq_bytes": "9;"}
        return json.dumps([row | {"fastq_md5": ";".join(hashlib.md5(self.data(f)).hexdigest() for f in files)}]).encode()

    def stream(self, url, stall):
        data = self.data(url.rpartition("/")[2])
        if self.faults:
            self.faults -= 1
            data = data[:-9]
        for k in range(0, len(data), 7):
            yield data[k : k + 7]

    def transports(self):
        return {"get": self.get, "stream": self.stream, "sleep": self.pauses.append}


def test_runs_are_downloaded_checked_and_merged(tmp_path):
    service, said = Runs(faults=2), []
    o = reads.Options(str(tmp_path), metadata=True, progress_every=0, log=said.append)
    first = reads.download_run("ERR1", o, **service.transports())
    assert len(service.pauses) == 2 and all(5 <= p <= 20 for p in service.pauses)
    assert sorted(os.listdir(tmp_path)) == ["ERR1_1.fastq.gz", "ERR1_2.fastq.gz", "ERR1_ena_meta.json"]
    assert [f.bytes for f in first.files] == [9, 0] and any("ERR1_1.fastq.gz: " in s for s in said)
    with pytest.raises(FileExistsError):
        reads.download_run("ERR1", o, **service.transports())
    second = reads.download_run("ERR2", replace(o, prefix="p", single_object=True), **service.transports())
    assert [f.filename for f in second.files] == ["p_1.fastq.gz", "p_2.fastq.gz"]
    assert json.loads((tmp_path / "p_ena_meta.json").read_text())["run_accession"] == "ERR2"
    with pytest.raises(ValueError, match="metadata"):
        reads.merge([first, replace(second, metadata=None)], str(tmp_path))
    merged = reads.merge([first, second], str(tmp_path), "all")
    assert sorted(os.listdir(tmp_path)) == ["all_1.fastq.gz", "all_2.fastq.gz", "all_ena_meta.json"]
    for k, f in enumerate(merged, 1):
        assert gzip.decompress(open(f.path, "rb").read()) == b"@x\n" * 5000 + f"ERR1_{k}.fastq.gz".encode() + b"@x\n" * 5000 + f"ERR2_{k}.fastq.gz".encode()
    assert [r["run_accession"] for r in json.loads((tmp_path / "all_ena_meta.json").read_text())] == ["ERR1", "ERR2"]
    kept = reads.download_all(["ERR3", "ERR4"], replace(o, prefix="q", metadata=False), merged=True, keep=True, **Runs((".fastq.gz",)).transports())
    assert [r.files[0].filename for r in kept] == ["q_ERR3.fastq.gz", "q_ERR4.fastq.gz"] and os.path.getsize(tmp_path / "q.fastq.gz") == sum(os.path.getsize(r.files[0].path) for r in kept)


def test_runs_that_fail(tmp_path):
    o = reads.Options(str(tmp_path), attempts=2)
    with pytest.raises(reads.Damaged):
        reads.download_run("ERR1", o, **Runs(faults=9).transports())

    def stalls(url, stall):
        yield b"\x1f"
        raise reads.Stalled(url)

    with pytest.raises(reads.Stalled):
        reads.download_run("ERR1", o, **(Runs().transports() | {"stream": stalls}))
    with pytest.raises(ValueError, match="one name"):
        reads.download_run("ERR1", replace(o, prefix="p"), **Runs(("_1.fastq.gz", "x_1.fastq.gz")).transports())
    with pytest.raises(remote.NotFound, match="not installed"):
        reads.download_run("ERR1", replace(o, methods=("sracha",), program="no-such-program"), **Runs().transports())
    assert os.listdir(tmp_path) == []
    for bad in ({"attempts": 0}, {"delay": (2, 1)}, {"stall": -1}, {"prefix": "a/b"}, {"methods": ("ftp",)}, {"methods": ()}):
        with pytest.raises(ValueError):
            reads.Options(**bad)
    run = reads.Run("a", "ena", (reads.ReadFile("a.fastq.gz"),))
    for others in ([run], [run, replace(run, files=run.files * 2)], [run, replace(run, files=(reads.ReadFile("b.fq.gz"),))]):
        with pytest.raises(ValueError):
            reads.merge(others, str(tmp_path))


def test_runs_by_an_external_program(tmp_path):
    data = gzip.compress(b"@r\n")
    (tmp_path / "data.gz").write_bytes(data)
    program = tmp_path / "tool"
    program.write_text(f'#!/bin/sh\necho "$@" > {tmp_path}/arguments\nfor n in _0 _1 _2; do cp {tmp_path}/data.gz "$8$n.fastq.gz"; done\n')
    program.chmod(0o755)
    o = reads.Options(str(tmp_path / "out"), methods=("ena", "sracha"), attempts=1, program=str(program), threads=3)
    run = reads.download_run("ERR1", o, **Runs((".fastq.gz", "_1.fastq.gz", "_2.fastq.gz"), faults=1).transports())
    assert run.method == "sracha" and sorted(os.listdir(tmp_path / "out")) == ["ERR1.fastq.gz", "ERR1_1.fastq.gz", "ERR1_2.fastq.gz"]
    assert (tmp_path / "arguments").read_text().split() == ["get", "-t", "3", "--connections", "1", "--split", "split-3", "ERR1"]
    assert reads.split_mode([reads.ReadFile("a.fastq.gz")]) == "split-spot" and reads.split_mode([reads.ReadFile("a_1.fq")]) == "split-files"
    assert [reads.suffix(n, 1, 2) for n in ("a.1.FASTQ.GZ", "a.fq", "a_7.tar")] == ["_1.FASTQ.GZ", "_2.fq", "_7.tar"]
    assert [reads.human_bytes(n) for n in (1023, 1024, 3 << 29, 5 << 50)] == ["1023 B", "1.0 KiB", "1.5 GiB", "5120.0 TiB"]


def test_package_runs_as_a_module():
    out = subprocess.run([sys.executable, "-m", "strandframe", "--version"], capture_output=True, text=True, check=True)
    assert out.stdout.strip()
