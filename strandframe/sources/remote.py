"""Downloads of genomes and sequences, over a transport that tests replace.

A transport is a function from a URL to bytes; it raises NotFound where the server has nothing. Planning (which
database, which batches, which form of the file wins) is plain code on few accessions and runs on the driver.
"""

from __future__ import annotations

import io
import os
import re
import sys
import urllib.error
import urllib.parse
import urllib.request
import warnings
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

from ..functions import accession as A
from . import codecs
from .sniff import sniff

Transport = Callable[[str], bytes]
BATCH = A.BATCH
# Public service addresses, and file name endings of each form of a genome.
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
DATASETS = "https://api.ncbi.nlm.nih.gov/datasets/v2/genome/accession"
EMBL = "https://www.ebi.ac.uk/ena/browser/api/embl"
ENDINGS = {"gff3": (".gff3", ".gff"), "genbank": (".gbff", ".gbk", ".gb", ".genbank"), "embl": (".embl",), "fasta": (".fna", ".fasta", ".fa")}
DATABASES = {"": "", "auto": "", "protein": "protein", "nuccore": "nuccore", "nucleotide": "nuccore", "sequences": "sequences"}
NUCLEOTIDE = {"": "", "none": "", "false": "", "first": "first", "true": "first", "all": "all"}
SOURCES = {"": "refseq", "refseq": "refseq", "insdc": "insdc", "all": "all"}
ALIASES = {"gb": "genbank", "gbk": "genbank", "gbff": "genbank"}


class NotFound(Exception):
    """The server has nothing at an address."""


def http_get(url: str) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=60) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise NotFound(url) from e
        raise


def _choice(value: str | None, allowed: dict[str, str], what: str) -> str:
    key = (value or "").strip().lower()
    if key not in allowed:
        raise ValueError(f"unsupported {what} {value!r}")
    return allowed[key]


def genome_format(name: str) -> str:
    low = ALIASES.get(name.strip().lower(), name.strip().lower())
    if low not in ENDINGS and low != "auto":
        raise ValueError(f"unknown genome format {name!r}")
    return low


def clean(accessions: list[str]) -> list[str]:
    out = [a.strip() for a in accessions if a.strip()]
    if not out:
        raise ValueError("no accessions given")
    return out


def database(accession: str) -> str:
    """As the Column function of the same name, for the few accessions of a request."""
    upper = accession.strip().upper()
    core = re.sub(r"(?<=.)\.[0-9]+$", "", upper)
    for prefixes, db in ((A.PROTEIN_PREFIXES, "protein"), (A.NUCLEOTIDE_PREFIXES, "nuccore")):
        if upper.startswith(prefixes):
            return db
    for shape, db in ((A.INSDC_PROTEIN, "protein"), (A.WGS_MASTER, "nuccore"), (A.INSDC_NUCLEOTIDE, "nuccore"), (A.WGS_LIKE, "nuccore")):
        if re.match(shape, core):
            return db
    return "sequences"


@dataclass(frozen=True)
class Plan:
    kind: str  # genome or sequences
    accessions: tuple[str, ...]
    form: str = "fasta"
    db: str = ""

    def batches(self) -> list[tuple[str, ...]]:
        return [self.accessions[k : k + BATCH] for k in range(0, len(self.accessions), BATCH)]


def plan(accessions: list[str], form: str = "auto", db: str | None = None) -> Plan:
    """Genomes are fetched one at a time by assembly accession, sequences in batches of one database."""
    own, form, asked = clean(accessions), genome_format(form), _choice(db, DATABASES, "database")
    genomes = [bool(re.match("GC[FA]_", a.upper())) for a in own]
    if all(genomes) or form not in ("auto", "fasta"):
        if len(own) > 1 or asked:
            raise ValueError("a genome download takes one accession and no database")
        return Plan("genome", tuple(own), form)
    if any(genomes):
        raise ValueError("genome and sequence accessions cannot be mixed")
    dbs = {database(a) for a in own}
    return Plan("sequences", tuple(own), "fasta", asked or (dbs.pop() if len(dbs) == 1 else "sequences"))


def _efetch(get: Transport, key: str | None = None, email: str | None = None, **query) -> bytes:
    query |= {k: v for k, v in (("api_key", key), ("email", email)) if v}
    return get(f"{EUTILS}?{urllib.parse.urlencode(query)}")


def components(xml: bytes) -> list[tuple[str, str]]:
    """(first, last) component ranges of a WGS, TSA or TLS master record: those it lists, else by locus and length."""
    seq = ElementTree.fromstring(xml).find(".//GBSeq")
    if seq is None:
        raise ValueError("the master record has no sequence entry")
    found = []
    for item in seq.iter("GBAltSeqItem"):
        first = item.findtext("GBAltSeqItem_first-accn", "").strip()
        if first:
            found.append((first, item.findtext("GBAltSeqItem_last-accn", "").strip() or first))
    if found:
        return found
    locus, n = seq.findtext("GBSeq_locus", "").strip(), int(seq.findtext("GBSeq_length", "0") or 0)
    prefix = locus.rstrip("0")
    if not locus or n <= 0 or prefix == locus:
        raise ValueError(f"cannot infer the component range of locus {locus!r}")
    width = len(locus) - len(prefix)
    return [(f"{prefix}{1:0{width}d}", f"{prefix}{n:0{width}d}")]


def expand(first: str, last: str) -> list[str]:
    """Accessions of a range that differ in digits of one width only."""
    split = lambda a: re.fullmatch(r"(.+?)(\.[0-9]+)?", a).groups("")
    (a, version), (b, other) = split(first), split(last)
    prefix = os.path.commonprefix([a, b]) if a != b else re.sub("[0-9]+$", "", a)
    low, high = a[len(prefix) :], b[len(prefix) :]
    if version != other or len(low) != len(high) or not (low.isdigit() and high.isdigit()):
        raise ValueError(f"cannot expand component accession range {first}-{last}")
    return [f"{prefix}{n:0{len(low)}d}{version}" for n in range(int(low), int(high) + 1)]


def report_rows(tsv: bytes) -> list[dict]:
    """Rows of an identical-protein report that name a nucleotide region."""
    names = ("_", "source", "nucleotide_accession", "start", "stop", "strand", "protein_accession", "protein_name", "organism", "strain", "assembly")
    rows = [dict(zip(names, f, strict=False)) for line in tsv.decode().splitlines()[1:] if len(f := line.split("\t")) >= 11]
    return [r for r in rows if r["nucleotide_accession"] and r["nucleotide_accession"].upper() != "N/A" and r["start"] and r["stop"] and r["strand"] in ("+", "-")]


def coding_regions(rows: list[dict], source: str = "all", assembly: str = "", every: bool = False) -> list[dict]:
    kept = [r for r in rows if source in ("all", r["source"].lower()) and (not assembly or r["assembly"].lower() == assembly.lower())]
    return kept if every else kept[:1]


def download(p: Plan, output: str, get: Transport, api_key=None, email=None, nucleotide: str | None = None, source: str = "refseq", assembly: str = "") -> str:
    """Fetch what a plan names into a file, compressed by its suffix, which appears only once it is whole; - is standard output."""
    nucleotide, source = _choice(nucleotide, NUCLEOTIDE, "nucleotide mode"), _choice(source, SOURCES, "source")
    if p.kind == "genome":
        if nucleotide or assembly:
            raise ValueError("nucleotide mode and assembly are for sequence downloads")
        data = genome(p.accessions[0], p.form, get, api_key, email)
    else:
        parts, own = [], []
        for a in p.accessions:
            if re.match(A.WGS_MASTER, re.sub(r"(?<=.)\.[0-9]+$", "", a.upper())):
                xml = _efetch(get, api_key, email, db="nuccore", id=a, rettype="gb", retmode="xml")
                own += [x for r in components(xml) for x in expand(*r)]
            else:
                own.append(a)
        if nucleotide:
            for a in own:
                rows = report_rows(_efetch(get, api_key, email, db="protein", id=a, rettype="ipg", retmode="text"))
                for r in coding_regions(rows, source, assembly, nucleotide == "all"):
                    parts.append(_efetch(get, api_key, email, db="nuccore", id=r["nucleotide_accession"], rettype="fasta", retmode="text", seq_start=r["start"], seq_stop=r["stop"], strand="1" if r["strand"] == "+" else "2"))
        else:
            parts = [_efetch(get, api_key, email, db=p.db, id=",".join(own[k : k + BATCH]), rettype="fasta", retmode="text") for k in range(0, len(own), BATCH)]
        data = b"".join(x if x.endswith(b"\n") else x + b"\n" for x in parts if x.strip())
    if not data.strip():
        raise NotFound(", ".join(p.accessions))
    if output == "-":
        sys.stdout.buffer.write(data)
        return output
    if p.kind == "genome":
        warn_of_extension(output, sniff(data))
    _put(output, data)
    return output


def warn_of_extension(path: str, form: str) -> None:
    """A warning if a file's name, apart from its compression, promises another form than it holds."""
    stem, last = os.path.splitext(path)
    end = os.path.splitext(stem)[1] if last.lower() in codecs.SUFFIXES else last
    named = next((f for f, ends in ENDINGS.items() if end.lower() in ends), form)
    if named != form:
        warnings.warn(f"{path} is named like {named} and holds {form}", stacklevel=3)


def _put(path: str, data: bytes) -> None:
    with open(f"{path}.partial", "wb") as raw:
        out = codecs.writer(raw, codecs.from_path(path))
        out.write(data)
        if out is not raw:
            out.close()
    os.replace(f"{path}.partial", path)


def with_sequences(gff3: bytes, fasta: bytes) -> bytes:
    """One GFF3 file with its sequences behind ##FASTA."""
    return gff3.rstrip(b"\r\n") + b"\n##FASTA\n" + fasta.strip(b"\r\n") + b"\n"


def unzip(data: bytes) -> dict[str, bytes]:
    """Files of a genome archive by form; one of each at most, and a sequence among them."""
    found: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            form = next((f for f, ends in ENDINGS.items() if name.lower().endswith(ends)), None)
            if form:
                if form in found:
                    raise ValueError(f"the archive has several {form} files")
                found[form] = z.read(name)
    if not found.keys() - {"gff3"}:
        raise ValueError("the archive has no sequence file")
    return found


def best_output(files: dict[str, bytes], form: str) -> bytes:
    """What is asked for; for annotation the richest form that is there."""
    if form == "fasta":
        return files["fasta"]
    for kind in dict.fromkeys([form, "gff3", "genbank", "embl", "fasta"]):
        if kind in files:
            return with_sequences(files["gff3"], files["fasta"]) if kind == "gff3" and "fasta" in files else files[kind]
    raise NotFound(form)


def genome(acc: str, form: str, get: Transport, api_key=None, email=None) -> bytes:
    if form == "embl":
        data = get(f"{EMBL}/{urllib.parse.quote(acc)}")
        if data.lstrip().startswith(b"ERROR:") or not data.lstrip().startswith(b"ID"):
            raise NotFound(acc)
        return data
    if re.match("GC[FA]_", acc.upper()):
        kinds = {"auto": "GENOME_FASTA,GENOME_GFF,GENOME_GBFF", "fasta": "GENOME_FASTA", "gff3": "GENOME_FASTA,GENOME_GFF", "genbank": "GENOME_FASTA,GENOME_GBFF"}[form]
        return best_output(unzip(get(f"{DATASETS}/{urllib.parse.quote(acc)}/download?include_annotation_type={kinds}")), form)
    files = {"fasta": _efetch(get, api_key, email, db="nuccore", id=acc, rettype="fasta", retmode="text")}
    if form == "genbank":
        return _efetch(get, api_key, email, db="nuccore", id=acc, rettype="gbwithparts", retmode="text")
    if form in ("auto", "gff3"):
        try:
            files["gff3"] = _efetch(get, api_key, email, db="nuccore", id=acc, rettype="gff3", retmode="text")
        except NotFound:
            warnings.warn(f"no annotation for {acc}", stacklevel=2)
    return best_output(files, form)
