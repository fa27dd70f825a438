"""Command line: annotate sequences, or build a class database."""

from __future__ import annotations

import argparse
from itertools import groupby

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import ani, boundaries, lookups, mask
from .plans.annotate import annotate, periods
from .plans.build_db import build_db
from .plans.params import Params
from .sources import bed, indexed, kmerdb
from .sources.scratch import cut


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tandemlake")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="find, refine and name repeat arrays")
    a.add_argument("-f", "--fasta", nargs="+", required=True)
    a.add_argument("-s", "--seq_id", nargs="+")
    a.add_argument("-d", "--directory", default=".")
    a.add_argument("-o", "--output-format", choices=bed.FORMATS, default="bed")
    a.add_argument("-m", "--mask", nargs="*", type=mask.as_length, help="class names or monomer lengths; without any, or with ALL, all")
    a.add_argument("--soft", action="store_true")
    a.add_argument("-c", "--classify", metavar="DIR")
    a.add_argument("-t", "--threshold", type=float, default=25.0)
    a.add_argument("-k", "--kmer", type=int, default=21)
    a.add_argument("-i", "--identity", type=float, default=86.0)
    a.add_argument("-w", "--window", type=int, default=2000)
    a.add_argument("--band", type=float, default=2.0, help="Mb")
    a.add_argument("--identifier", help="name of unclassified arrays")
    a.add_argument("-p", "--plot", action="store_true", help="write each band's score matrix as a picture")
    a.add_argument("--compat", action="store_true", help="the original tool's accidental rules (see Params)")
    b = sub.add_parser("build_db", help="k-mer sets of named regions")
    b.add_argument("-f", "--fasta", nargs="+", required=True)
    b.add_argument("-b", "--bed", nargs="+", required=True)
    b.add_argument("-c", "--config")
    b.add_argument("-d", "--directory")
    b.add_argument("-k", "--kmer", type=int, default=21)
    for command in (a, b):
        talk = command.add_mutually_exclusive_group()
        talk.add_argument("-v", "--verbose", action="store_true", help="report what was found on the way")
        talk.add_argument("-q", "--quiet", action="store_true", help="report nothing")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    say = (lambda *_: None) if args.quiet else print
    more = print if args.verbose else (lambda *_: None)
    seqs = indexed.read_index(spark, args.fasta)
    if args.verbose:
        more(seqs.records().count(), "sequences")  # of the index's rows
    if args.command == "build_db":
        tables = [bed.normalised(bed.read_bed(spark, p)) for p in args.bed]
        regions = tables[0]
        for t in tables[1:]:
            regions = regions.unionByName(t)
        if absent := [r.chrom for r in lookups.missing_chroms(regions, seqs.records()).limit(20).collect()]:
            say("no sequence for", ", ".join(absent))
        classes = kmerdb.read_class_map(spark, args.config) if args.config else None
        folder, db = args.directory or f"k_{args.kmer}", build_db(regions, seqs, args.kmer, classes)
        sizes = kmerdb.write_dbs(db, args.kmer, folder)
        if args.verbose:
            for r in sizes.groupBy("class").agg(F.count("*").alias("subtypes"), F.sum("n").alias("kmers")).orderBy("class").toLocalIterator():  # a row a class
                more(f"{r['class']}: {r.subtypes} subtypes, {r.kmers} k-mers")
        say("wrote", folder)
        return
    if args.seq_id:
        seqs = seqs.selected(args.seq_id)
        if missing := sorted(set(args.seq_id) - {r.seq_id for r in seqs.records().select("seq_id").distinct().collect()}):  # of those asked for
            say("no sequence", ", ".join(missing))
    p = Params(k=args.kmer, window=args.window, band=round(args.band * 1_000_000), identity=args.identity, threshold=args.threshold, compat=args.compat)
    db = kmerdb.bucketed(kmerdb.read_dbs(spark, args.classify, permissive=True)) if args.classify else None
    found = annotate(seqs, p, db)
    if args.identifier:
        found = found.withColumn("name", F.coalesce("name", F.lit(args.identifier)))
    found, counted = cut(found), Observation()
    table = bed.annotation(bed.placed(found, args.compat)).observe(counted, F.count(F.lit(1)).alias("arrays"))
    bed.write_table(table, f"{args.directory}/annotation", args.output_format)
    say(counted.get["arrays"], "arrays in", f"{args.directory}/annotation")
    if args.plot:
        ani.write_images(ani.images(ani.indexed_cells(seqs, p, p.identity), p.windows, p.identity), f"{args.directory}/plots")
    if args.verbose:
        parts = found.select("seq_id", "start", "end")
        counts = boundaries.span_counts(parts, seqs, p.k)
        for span, rows in groupby(boundaries.scaled_counts(counts).orderBy("seq_id", "chunk").toLocalIterator(), lambda r: r.seq_id):
            more(f"{span.seq_id}:{span.start}-{span.end}")
            more(boundaries.bars({r.chunk: r.bar for r in rows}))
    if args.mask is not None:
        lengths = any(isinstance(m, int) for m in args.mask)
        chosen = mask.chosen(found, tuple(args.mask), periods(found, seqs, args.kmer) if lengths else None)
        mask.write_masked(seqs, chosen, f"{args.directory}/masked", args.soft)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tandemlake").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
