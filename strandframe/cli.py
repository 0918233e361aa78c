"""Command line: python -m strandframe COMMAND. Reads and writes files through the record table."""

from __future__ import annotations

import argparse
import atexit
import os
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import generators as G
from .operators import relational as R
from .operators import stats as ST
from .sources import datasource, reads, remote


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("strandframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _scratch() -> str:
    """A folder that goes when the command ends."""
    path = tempfile.mkdtemp(prefix="strandframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _input(spark: SparkSession, path: str) -> DataFrame:
    """Records of a path; - is standard input, spooled to a file first."""
    if path == "-":
        path = os.path.join(_scratch(), "stdin")
        with open(path, "wb") as f:
            shutil.copyfileobj(sys.stdin.buffer, f)
    return datasource.read(spark, path)


def _output(records: DataFrame, args, kind: str) -> None:
    path = args.output
    if path == "-":
        path = os.path.join(_scratch(), "out")
    datasource.write_file(records, path, kind, args.wrap, args.compress)
    if args.output == "-":
        with open(path, "rb") as f:
            shutil.copyfileobj(f, sys.stdout.buffer)
        sys.stdout.flush()


def to_fasta(args) -> None:
    path = args.positional if args.positional and args.input == "-" else args.input
    records = _input(_session(), path)
    if args.sample:
        records = records.where(F.col("sample") == args.sample)
        if records.isEmpty():
            raise SystemExit(f"the input has no sample {args.sample!r}: samples need an archive of several")
    _output(R.to_fasta_records(records, args.remove_dashes), args, "fasta")


def interleave(args) -> None:
    spark = _session()
    first, second = _input(spark, args.first), _input(spark, args.second)
    heads = [df.orderBy("ordinal").select("qual").first() for df in (first, second)]
    kind = R.pair_format(*(h["qual"] is not None for h in heads)) if all(heads) else "fasta"
    _output(R.interleave(first, second, args.suffix1, args.suffix2), args, kind)


def stats(args) -> None:
    spark = _session()
    records = R.combine(*(_input(spark, p) for p in args.files or ["-"])) if args.combine_inputs else None
    records = records if records is not None else R.combine(*(_input(spark, p).withColumn("_d", F.lit(p)) for p in args.files or ["-"])).withColumn("dataset", F.col("_d"))
    rows = {r["filename"]: r for r in ST.assembly_stats(records, args.min_length).collect()}
    style = "tab" if args.tab else "tab_no_header" if args.tab_no_header else "greppy" if args.greppy else "human"
    order = ["combined"] if args.combine_inputs else args.files or ["-"]
    sys.stdout.write(ST.render([rows[n] if n in rows else ST.empty_row(n) for n in order], style))


def random_contigs(args) -> None:
    rows = G.random_contigs(_session(), args.contigs, args.length, args.seed, args.first_number, args.name_by_letters, args.prefix)
    _output(rows, args, "fasta")


def perfect_reads(args) -> None:
    if bool(args.forward) != bool(args.reverse):
        raise SystemExit("paired reads require both -1 and -2")
    if args.output != "-" and args.forward:
        raise SystemExit("give either -o, or both -1 and -2")
    refs = _input(_session(), args.input)
    o = G.ReadOptions(args.coverage, args.read_length, args.mean_insert, args.insert_std, args.no_n, args.seed)
    if args.forward and args.reverse:
        for mate, path in zip(G.paired_reads(refs, o), (args.forward, args.reverse), strict=True):
            datasource.write_file(mate, path, "fastq")
        skipped = G.report(refs, G.paired_reads(refs, o)[0], o, True)["skipped_short"]
    else:
        _output(G.single_reads(refs, o), args, "fastq")
        skipped = G.report(refs, G.single_reads(refs, o), o)["skipped_short"]
    for name in skipped:
        print(f"skipped short reference {name}", file=sys.stderr)


def download(args) -> None:
    genome = args.accessions[0].strip().upper().startswith(("GCF_", "GCA_"))
    if genome and (args.api_key or args.email or args.source != "refseq"):
        raise SystemExit("--api-key, --email and --source are for sequence downloads")
    key, email = args.api_key or os.environ.get("NCBI_API_KEY"), args.email or os.environ.get("NCBI_EMAIL")
    plan = remote.plan(args.accessions, args.format, args.db)
    remote.download(plan, args.output, remote.http_get, api_key=key, email=email, nucleotide=args.nucleotide, source=args.source, assembly=args.assembly)


def download_reads(args) -> None:
    try:
        runs = reads.accession_list(args.runs, args.accessions_file)
        options = reads.Options(
            folder=args.output_dir,
            prefix=args.prefix.strip(),
            metadata=args.ena_meta,
            single_object=args.ena_meta_single_object,
            methods=reads.parse_methods(args.method),
            attempts=args.attempts,
            delay=(args.retry_delay_min, args.retry_delay_max),
            stall=args.download_stall_timeout,
            program=args.sracha_bin,
            threads=args.sracha_threads,
            connections=args.sracha_connections,
            log=(lambda text: print(text, file=sys.stderr)) if args.verbose else None,
        )
    except ValueError as e:
        raise SystemExit(str(e)) from e
    reads.download_all(runs, options, args.merge, args.keep_originals)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandframe")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(required=True)

    def add(name, fn, output=True):
        c = sub.add_parser(name)
        c.set_defaults(run=fn)
        if output:
            c.add_argument("-o", "--output", default="-")
            c.add_argument("--wrap", type=int, default=60 if name in ("to-fasta", "make-random-contigs") else 0)
            c.add_argument("--compress", default="auto", choices=["auto", "none", "gzip", "bzip2", "xz", "zstd"])
        return c

    c = add("to-fasta", to_fasta)
    c.add_argument("positional", nargs="?")
    c.add_argument("-i", "--input", default="-")
    c.add_argument("--sample")
    c.add_argument("--remove-dashes", action="store_true")
    c = add("interleave", interleave)
    c.add_argument("first")
    c.add_argument("second")
    c.add_argument("--suffix1", default="")
    c.add_argument("--suffix2", default="")
    c = add("stats", stats, False)
    c.add_argument("files", nargs="*")
    c.add_argument("-l", "--min-length", type=int, default=1)
    style = c.add_mutually_exclusive_group()
    for flag, name in (("-s", "greppy"), ("-t", "tab"), ("-u", "tab-no-header")):
        style.add_argument(flag, f"--{name}", action="store_true")
    c.add_argument("--combine-inputs", action="store_true")
    c = add("make-random-contigs", random_contigs)
    c.add_argument("contigs", type=int)
    c.add_argument("length", type=int)
    c.add_argument("--first-number", type=int, default=1)
    c.add_argument("--name-by-letters", action="store_true")
    c.add_argument("--prefix", default="")
    c.add_argument("--seed", type=int, default=1)
    c = add("to-perfect-reads", perfect_reads)
    c.add_argument("input")
    c.add_argument("-1", "--forward")
    c.add_argument("-2", "--reverse")
    for flag, kind, value in (("--mean-insert", int, 300), ("--insert-std", float, 30.0), ("--coverage", float, 10.0), ("--read-length", int, 100), ("--seed", int, 1)):
        c.add_argument(flag, type=kind, default=value)
    c.add_argument("--no-n", action="store_true")
    c = add("download", download, False)
    c.add_argument("accessions", nargs="+")
    c.add_argument("-o", "--output", default="-")
    c.add_argument("--format", default="auto")
    c.add_argument("--db")
    c.add_argument("--nucleotide", nargs="?", const="first", choices=["first", "all"])
    c.add_argument("--source", default="refseq", choices=["all", "refseq", "insdc"])
    c.add_argument("--assembly", default="")
    c.add_argument("--api-key")
    c.add_argument("--email")
    c = add("download-reads", download_reads, False)
    c.add_argument("runs", nargs="?")
    c.add_argument("--accessions-file")
    c.add_argument("-o", "--output-dir", default=".")
    c.add_argument("--prefix", default="")
    c.add_argument("--ena-meta", action="store_true")
    c.add_argument("--ena-meta-single-object", action="store_true")
    c.add_argument("--method", default="ena", help="one or several of ena, sracha, tried in this order")
    c.add_argument("--attempts", type=int, default=3)
    c.add_argument("--sracha-bin", default=reads.PROGRAM)
    c.add_argument("-t", "--sracha-threads", type=int, default=1)
    c.add_argument("--sracha-connections", type=int, default=1)
    for flag, value in (("--retry-delay-min", 5.0), ("--retry-delay-max", 20.0), ("--download-stall-timeout", 300.0)):
        c.add_argument(flag, type=float, default=value, metavar="SECONDS")
    c.add_argument("--merge", action="store_true")
    c.add_argument("--keep-originals", action="store_true")
    c.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)
