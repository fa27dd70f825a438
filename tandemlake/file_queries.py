"""Queries that write files of the test tables, read them back and return the rows; record and interval choices; refinement.

They add themselves to the registry of queries.py.
"""

from __future__ import annotations

import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kmers as K
from .operators import boundaries, classify, mask, windows
from .plans.annotate import histograms, periods, shifted
from .queries import _ANN, CLASSES, NARROW, SQL, P, _annotated, _kmers_sql, _subtypes, _table, _with, bed, dbset, dna, query, sets
from .sources import bed as B
from .sources import fasta, indexed, kmerdb, pieces
from .sources.scratch import scratch


def _seqs(spark, sf) -> DataFrame:
    return dna(spark, sf).select("file", F.col("seq_id").cast("string").alias("seq_id"), "seq", F.length("seq").cast("bigint").alias("seq_len"))


# --- sequences -------------------------------------------------------------------------------------------------


def _read_again(spark, sf) -> DataFrame:
    """All sequences as FASTA files of a few records each, read back."""
    path = scratch(spark, "fasta")
    _seqs(spark, sf).select(F.concat(F.lit(">"), "seq_id", F.lit(" length>"), "seq_len", F.lit("\n"), "seq").alias("value")).write.text(path)
    return fasta.read_fasta(spark, path)


@query
def fasta_records(spark, sf):
    return _read_again(spark, sf).select("seq_id", "seq", "seq_len")


@query
def fasta_names(spark, sf):
    got = _read_again(spark, sf)
    return fasta.names(got.unionByName(got))


SQL["fasta_records"] = _with("dna", "SELECT seq_id::VARCHAR AS seq_id, seq, length(seq) AS seq_len FROM dna")
SQL["fasta_names"] = _with("dna", "SELECT DISTINCT seq_id::VARCHAR AS seq_id FROM dna")


@query
def masked_fasta_files(spark, sf):
    """The benchmark's letters, partly masked, in a folder of FASTA each, read back."""
    seqs = dbset(spark, sf).select(F.col("item_id").cast("string").alias("seq_id"), "seq")
    marks = dbset(spark, sf).select(F.col("item_id").cast("string").alias("seq_id"), (F.col("item_id") % 30).alias("start"), (F.col("item_id") % 30 + 25).alias("end"))
    path = scratch(spark, "masked")
    fasta.write_fasta(mask.masked(seqs, marks), path)
    return fasta.read_fasta(spark, f"{path}/*/").select("seq_id", "seq")


SQL["masked_fasta_files"] = _with("dbset", "SELECT item_id::VARCHAR AS seq_id, substr(seq, 1, item_id % 30) || repeat('N', length(substr(seq, item_id % 30 + 1, 25))) || substr(seq, item_id % 30 + 26) AS seq FROM dbset")


def _indexed(spark, sf) -> indexed.Indexed:
    """All sequences as FASTA files with lines of 61 bases, by index. Segments are small, so that records lie across their borders."""
    path = scratch(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{61})(?=.)", "$1\n")
    _seqs(spark, sf).select(F.concat(F.lit(">"), "seq_id", F.lit(" x\n"), lines).alias("value")).write.text(path)
    return indexed.read_index(spark, path, 4096, 1 << 20)


@query
def indexed_records(spark, sf):
    return _indexed(spark, sf).records().select("seq_id", "seq_len")


@query
def indexed_regions(spark, sf):
    """A stretch of 300 bases of each record and one of its end, by their bytes."""
    seqs = _indexed(spark, sf)
    n = seqs.records()
    at = F.col("seq_id").cast("bigint") % 400
    regions = n.select("seq_id", at.alias("start"), (at + 300).alias("end")).unionByName(n.select("seq_id", F.greatest(F.lit(0), F.col("seq_len") - 50).alias("start"), F.col("seq_len").alias("end")))
    parts = K.slices(regions, seqs, 1, ["seq_id", "start", "end"]).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos0", F.col("seq").cast("string").alias("seq")))).alias("p"))
    return parts.select("seq_id.*", F.expr("array_join(transform(p, x -> x.seq), '')").alias("seq"))


@query
def indexed_selection(spark, sf):
    """Records asked for by name and by range, read by their bytes."""
    got = _indexed(spark, sf).selected(["3", "5:10-200", "8:0-40", "none", "none:1-9", "3"]).pieces()
    return got.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos0", F.col("seq").cast("string").alias("seq")))).alias("p")).select("seq_id", F.expr("array_join(transform(p, x -> x.seq), '')").alias("seq"))


@query
def fasta_pieces(spark, sf):
    """All pieces from the data source, over a stored index, put together again."""
    path = scratch(spark, "index")
    _indexed(spark, sf).save(path)
    return pieces.read_pieces(spark, path).groupBy("seq_id", "seq_len").agg(F.sort_array(F.collect_list(F.struct("pos0", F.col("seq").cast("string").alias("seq")))).alias("p")).select("seq_id", "seq_len", F.expr("array_join(transform(p, x -> x.seq), '')").alias("seq"))


@query
def masked_by_pieces(spark, sf):
    """The stretches of the named arrays masked piece by piece, in files of their own, read back by index."""
    path = scratch(spark, "masked")
    seqs = _indexed(spark, sf)
    marks = mask.chosen(_arrays(spark, sf).withColumn("seq_id", F.col("seq_id").cast("string")), ("ALL",))
    mask.write_masked(seqs, marks, path)
    got = indexed.read_index(spark, path, 4096, 1 << 20).pieces()
    return got.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos0", F.col("seq").cast("string").alias("seq")))).alias("p")).select("seq_id", F.expr("array_join(transform(p, x -> x.seq), '')").alias("seq"))


_DNA_TEXT = "SELECT seq_id::VARCHAR AS seq_id, seq_id % 400 AS lo, seq, length(seq) AS n FROM dna"
SQL["fasta_pieces"] = _with("dna", "SELECT seq_id::VARCHAR AS seq_id, length(seq) AS seq_len, seq FROM dna WHERE seq <> ''")
SQL["indexed_records"] = _with("dna", "SELECT seq_id::VARCHAR AS seq_id, length(seq) AS seq_len FROM dna")
SQL["indexed_regions"] = _with("dna", f"""SELECT DISTINCT seq_id, start, "end", substr(seq, start + 1, "end" - start) AS seq FROM (
    SELECT seq_id, seq, lo AS start, lo + 300 AS "end" FROM ({_DNA_TEXT}) UNION ALL SELECT seq_id, seq, greatest(0, n - 50), n FROM ({_DNA_TEXT})) WHERE start < length(seq)""")
SQL["indexed_selection"] = _with("dna", "SELECT '3' AS seq_id, seq FROM dna WHERE seq_id = 3 UNION ALL SELECT '5:10-200', substr(seq, 11, 190) FROM dna WHERE seq_id = 5 UNION ALL SELECT '8:0-40', substr(seq, 1, 40) FROM dna WHERE seq_id = 8")
SQL["masked_by_pieces"] = _with("dna", "SELECT seq_id::VARCHAR AS seq_id, substr(seq, 1, seq_id % 400) || repeat('N', length(substr(seq, seq_id % 400 + 1, 300))) || substr(seq, seq_id % 400 + 301) AS seq FROM dna WHERE seq <> ''")


@query
def record_kmers(spark, sf):
    return K.record_kmers(_seqs(spark, sf), "7", P.k).select("pos", "kmer")


SQL["record_kmers"] = f"WITH dna AS (SELECT * FROM ({_with('dna', 'SELECT * FROM dna')}) WHERE seq_id = 7) SELECT pos, kmer FROM ({_kmers_sql(P.k)})"


@query
def selected_records(spark, sf):
    """Records asked for by name and by range; those that aren't there give no row."""
    return fasta.selected(_seqs(spark, sf), ["3", "5:10-200", "8:0-40", "none", "none:1-9", "3"]).drop("seq_len")


SQL["selected_records"] = _with(
    "dna",
    """SELECT file, '3' AS seq_id, seq FROM dna WHERE seq_id = 3 UNION ALL SELECT file, '5:10-200', substr(seq, 11, 190) FROM dna WHERE seq_id = 5
       UNION ALL SELECT file, '8:0-40', substr(seq, 1, 40) FROM dna WHERE seq_id = 8""",
)


@query
def window_places(spark, sf):
    """Each window's number of k-mers, with its place in the sequence."""
    return windows.placed(sets(spark, sf, NARROW)[0].groupBy("seq_id", "band", "win").agg(F.count("*").alias("n")), NARROW).select("seq_id", "start", "end", "n")


SQL["window_places"] = _with("plain", f'SELECT seq_id, band * {NARROW.band} + win * {NARROW.window} AS start, band * {NARROW.band} + (win + 1) * {NARROW.window} AS "end", count(*) AS n FROM plain GROUP BY seq_id, band, win', NARROW)


@query
def kmer_slice(spark, sf):
    """Of each sequence the k-mers after the first, up to the hundredth, counted and summed up."""
    return K.taken(K.kmers(dna(spark, sf), P.k), 1, 100).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("kmer").alias("total"))


SQL["kmer_slice"] = _with("km", "SELECT seq_id, count(*) AS n, sum(kmer)::BIGINT AS total FROM km WHERE pos >= 1 AND pos < 100 GROUP BY seq_id")

# --- intervals -------------------------------------------------------------------------------------------------


def _bed_file(spark, sf, columns: list[str]) -> DataFrame:
    """The events' intervals as BED text with the lines that a reader has to leave out, read back."""
    path = scratch(spark, "bed")
    lines = bed(spark, sf).select(F.concat_ws("\t", *columns).alias("value"))
    other = spark.createDataFrame([("track name=t",), ("browser position x",), ("# a comment",), ("",)], "value string")
    lines.unionByName(other).write.text(path)
    return B.normalised(B.read_bed(spark, path))


@query
def bed_file(spark, sf):
    return _bed_file(spark, sf, ["chrom", "start", "end", "name"])


@query
def bed_file_without_names(spark, sf):
    return _bed_file(spark, sf, ["chrom", "start", "end"])


@query
def bed_union(spark, sf):
    """Two tables one under the other, repeats included."""
    return B.normalised(bed(spark, sf)).unionByName(B.normalised(bed(spark, sf).drop("name")))


SQL["bed_file"] = _with("bed", 'SELECT chrom, start, "end", name FROM bed')
SQL["bed_file_without_names"] = _with("bed", 'SELECT chrom, start, "end", chrom AS name FROM bed')
SQL["bed_union"] = _with("bed", 'SELECT chrom, start, "end", name FROM bed UNION ALL SELECT chrom, start, "end", chrom FROM bed')


@query
def placed_intervals(spark, sf):
    """Annotations of records that are named by a range, and of others."""
    lo = F.when(F.col("start") % 2 == 0, F.concat_ws("", F.lit(":"), F.lit(500), F.lit("-"), F.lit(90_000))).otherwise("")
    return B.annotation(B.placed(bed(spark, sf).withColumn("seq_id", F.concat("chrom", lo))), rgb="255,0,0")


SQL["placed_intervals"] = _with("bed", "SELECT chrom || CASE WHEN start % 2 = 0 THEN ':500-90000' ELSE '' END AS \"#chrom\", start + d AS start, \"end\" + d AS \"end\", name, 0 AS score, '.' AS strand, start + d AS \"thickStart\", \"end\" + d AS \"thickEnd\", '255,0,0' AS \"itemRgb\" FROM (SELECT *, CASE WHEN start % 2 = 0 THEN 500 ELSE 0 END AS d FROM bed)")


def _written(fmt: str):
    def run(spark, sf):
        path = scratch(spark, f"annotation-{fmt}")
        table = _annotated(spark, sf)
        B.write_table(table, path, fmt)
        if fmt == "json":
            return spark.read.schema(table.schema).json(path)
        return spark.read.schema(table.schema).csv(path, sep="," if fmt == "csv" else "\t", header=True)

    run.__name__, run.__doc__ = f"annotation_{fmt}", f"The annotation written as {fmt} and read back."
    return run


for _fmt in ("bed", "csv", "tsv", "json"):
    query(_written(_fmt))
    SQL[f"annotation_{_fmt}"] = _with("bed", _ANN)


def _arrays(spark, sf) -> DataFrame:
    """A stretch of 300 bases of each sequence, by its document's source."""
    return dna(spark, sf).select("seq_id", (F.col("seq_id") % 400).cast("bigint").alias("start"), (F.col("seq_id") % 400 + 300).cast("bigint").alias("end"), F.concat(F.lit("D"), F.col("seq_id") % 50).alias("name"))


def _plain(spark, sf) -> DataFrame:
    return dna(spark, sf).select("seq_id", "seq")


_MASK = "SELECT seq_id, CASE WHEN {} THEN substr(seq, 1, seq_id % 400) || repeat('N', length(substr(seq, seq_id % 400 + 1, 300))) || substr(seq, seq_id % 400 + 301) ELSE seq END AS seq FROM dna"
PERIODS = (6, 40, 60, 100)


@query
def intervals_of_a_name(spark, sf):
    return mask.chosen(_arrays(spark, sf), ("d3", "D7"))


@query
def mask_names(spark, sf):
    return mask.masked(_plain(spark, sf), mask.chosen(_arrays(spark, sf), ("d3", "D7")))


@query
def mask_options(spark, sf):
    """What a mask's option asks for: a length if it is a number, else a name."""
    given = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.concat("source", F.col("doc_id").cast("string")))
    return _table(spark, sf, "documents").select("doc_id", mask.asked(given).alias("o")).select("doc_id", "o.*")


SQL["mask_options"] = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars::BIGINT WHEN 1 THEN -doc_id END AS length, CASE doc_id % 3 WHEN 2 THEN source || doc_id END AS name FROM documents"


@query
def positive_guard(spark, sf):
    """Intervals whose coordinates compat moves: one less unless the name has a range, never below 0."""
    rows = bed(spark, sf).select(F.when(F.col("start") % 2 == 0, F.concat("chrom", F.lit(":5-9"))).otherwise(F.col("chrom")).alias("seq_id"), (F.col("start") % 3).alias("start"), "end")
    return shifted(rows)


SQL["positive_guard"] = _with("bed", "SELECT seq_id, greatest(0, start - d) AS start, greatest(0, \"end\" - d) AS \"end\" FROM (SELECT chrom || CASE WHEN start % 2 = 0 THEN ':5-9' ELSE '' END AS seq_id, start % 3 AS start, \"end\", start % 2 AS d FROM bed)")


@query
def database_sizes(spark, sf):
    """Classes of a database whose k-mers have another size than is asked for."""
    db = dbset(spark, sf).select("class", (F.col("item_id") % 3 + 11).cast("int").alias("k"))
    return classify.other_sizes(db, P.k)


SQL["database_sizes"] = _with("dbset", f"SELECT DISTINCT class, (item_id % 3 + 11)::INT AS k FROM dbset WHERE item_id % 3 + 11 <> {P.k}")


@query
def region_extract_compat(spark, sf):
    """Bases of regions as compat reads them: base 0 never."""
    lo = (F.col("seq_id") % 4).cast("bigint")
    return dna(spark, sf).select("seq_id", fasta.region(F.col("seq"), lo, lo + 100, compat=True).alias("part"))


SQL["region_extract_compat"] = _with("dna", "SELECT seq_id, substr(seq, greatest(1, seq_id % 4) + 1, seq_id % 4 + 100 - greatest(1, seq_id % 4)) AS part FROM dna")


@query
def placed_intervals_compat(spark, sf):
    """Annotations of records that are named by a range, which compat ends a base earlier."""
    lo = F.when(F.col("start") % 2 == 0, F.concat_ws("", F.lit(":"), F.lit(500), F.lit("-"), F.lit(90_000))).otherwise("")
    return B.placed(bed(spark, sf).select(F.concat("chrom", lo).alias("seq_id"), "start", "end"), compat=True)


SQL["placed_intervals_compat"] = _with("bed", "SELECT chrom || CASE WHEN start % 2 = 0 THEN ':500-90000' ELSE '' END AS seq_id, start + CASE WHEN start % 2 = 0 THEN 500 ELSE 0 END AS start, \"end\" + CASE WHEN start % 2 = 0 THEN 499 ELSE 0 END AS \"end\" FROM bed")


@query
def mask_all(spark, sf):
    return mask.masked(_plain(spark, sf), mask.chosen(_arrays(spark, sf)))


@query
def array_histograms(spark, sf):
    return histograms(_arrays(spark, sf), _plain(spark, sf), P.k)


@query
def mask_periods(spark, sf):
    """Arrays whose commonest distance is one of a few, masked."""
    found = periods(_arrays(spark, sf), _plain(spark, sf), P.k)
    return mask.masked(_plain(spark, sf), mask.chosen(_arrays(spark, sf), PERIODS, found))


_TOP = (
    f"WITH dna AS ({_with('dna', 'SELECT * FROM dna')}), parts AS (SELECT seq_id, substr(seq, seq_id % 400 + 1, 300) AS seq FROM dna), pk AS ({_kmers_sql(P.k, 'parts')}),"
    " h AS (SELECT seq_id, distance, count(*) AS cnt, min(pos) AS first_pos FROM (SELECT seq_id, pos, pos - lag(pos) OVER (PARTITION BY seq_id, kmer ORDER BY pos) AS distance FROM pk) WHERE distance IS NOT NULL GROUP BY ALL),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY cnt DESC, first_pos) AS rank FROM h) "
)
SQL["intervals_of_a_name"] = _with("dna", "SELECT seq_id, seq_id % 400 AS start, seq_id % 400 + 300 AS \"end\", 'D' || (seq_id % 50) AS name FROM dna WHERE seq_id % 50 IN (3, 7)")
SQL["mask_names"] = _with("dna", _MASK.format("seq_id % 50 IN (3, 7)"))
SQL["mask_all"] = _with("dna", _MASK.format("true"))
SQL["array_histograms"] = _TOP + 'SELECT seq_id, seq_id % 400 AS start, seq_id % 400 + 300 AS "end", rank::INT AS rank, distance, cnt FROM ranked WHERE rank <= 10'
SQL["mask_periods"] = _TOP + _MASK.format(f"seq_id IN (SELECT seq_id FROM ranked WHERE rank = 1 AND distance IN {PERIODS})")

# --- databases -------------------------------------------------------------------------------------------------


@query
def kmer_db_folder(spark, sf):
    """A folder of databases written by tasks, with a broken file in it, read back but for that file."""
    path = scratch(spark, "db")
    parts = _subtypes(spark, sf).select(F.concat(F.lit("c/"), "subtype").alias("class"), F.concat("subtype", F.lit("-"), F.pmod("kmer", F.lit(3))).alias("subtype"), "kmer")
    kmerdb.write_dbs(parts, P.k, path)
    fs, folder = pfs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{folder}/broken.db") as f:
        f.write(b"no database")
    return kmerdb.read_dbs(spark, path, permissive=True).groupBy("class", "subtype", "k").agg(F.count("*").alias("n"), F.sum("kmer").alias("total"))


@query
def class_map_file(spark, sf):
    """The documents' languages as classes of their sources, written as a class map and read back."""
    path = scratch(spark, "classes")
    of = _table(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.collect_set(F.upper("source")).alias("v"))
    of.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(path)
    return kmerdb.read_class_map(spark, path, ("en", "de"))


SQL["kmer_db_folder"] = _with("dbk", f"SELECT 'c/' || class AS class, class || '-' || (kmer % 3 + 3) % 3 AS subtype, {P.k} AS k, count(*) AS n, sum(kmer)::BIGINT AS total FROM dbk GROUP BY ALL")
SQL["class_map_file"] = "SELECT DISTINCT lang AS class, lower(source) AS subtype FROM documents"

# --- refinement ------------------------------------------------------------------------------------------------


def _given_spans(spark, sf) -> DataFrame:
    """A span of each sequence of 2,000 bases and more: all but 600 bases on either side."""
    return dna(spark, sf).where(F.length("seq") >= 2000).select("seq_id", F.lit(600).cast("bigint").alias("start"), (F.length("seq") - 600).cast("bigint").alias("end"))


@query
def refined_spans(spark, sf):
    return boundaries.refined(_given_spans(spark, sf), _plain(spark, sf), P.window, P.k)


# spans(seq_id, start, end) with their refined ends, from the k-mers of dna in km, as DuckDB's CTEs.
REFINED = f"""
    sized AS (SELECT *, w // 2 + w % 2 AS h FROM (SELECT seq_id, start, "end", CASE WHEN "end" - start >= {4 * P.window} THEN {P.window} ELSE greatest(1, ("end" - start) // 4) END AS w FROM spans)),
    zoned AS (SELECT seq_id, start, "end", z.* FROM (SELECT *, unnest([{{'zone': 'core', 'a': start + w + h, 'z': "end" - w - h}}, {{'zone': 'left', 'a': start - w - h, 'z': start + w + h}},
        {{'zone': 'left2', 'a': start + w, 'z': start + w + 5 * h}}, {{'zone': 'right', 'a': "end" - w - h, 'z': "end" + w + h}}, {{'zone': 'right2', 'a': "end" - w - 5 * h, 'z': "end" - w}}]) AS z FROM sized)),
    zk AS (SELECT z.seq_id, start, "end", zone, pos, kmer FROM zoned z JOIN km ON km.seq_id = z.seq_id AND pos >= a AND pos <= z - {P.k}),
    corek AS (SELECT DISTINCT seq_id, start, "end", kmer FROM zk WHERE zone = 'core' AND kmer <> 0),
    numbered AS (SELECT *, pos - first AS spot, ceil(nv / ceil(nv / 100))::BIGINT AS len, ceil(nv / 100)::BIGINT AS n
        FROM (SELECT zk.*, min(pos) OVER g AS first, count(*) OVER g AS nv, c.kmer IS NOT NULL AS held FROM zk LEFT JOIN corek c USING (seq_id, start, "end", kmer) WHERE zone <> 'core' WINDOW g AS (PARTITION BY seq_id, start, "end", zone))),
    hit AS (SELECT seq_id, start, "end", zone, n, len, nv, first, CASE WHEN zone LIKE 'left%' THEN n - 1 - spot // len ELSE spot // len END AS s FROM numbered WHERE held
        GROUP BY seq_id, start, "end", zone, n, len, nv, first, spot // len HAVING count(DISTINCT kmer) > ceil(n / 4)),
    lasting AS (SELECT *, sum(gap) OVER (PARTITION BY seq_id, start, "end", zone ORDER BY s) AS gaps
        FROM (SELECT *, (s - lag(s, 1, -1) OVER (PARTITION BY seq_id, start, "end", zone ORDER BY s) > {boundaries.MISSES})::INT AS gap FROM hit)),
    chosen AS (SELECT seq_id, start, "end", zone, CASE WHEN zone LIKE 'left%' THEN any_value(n) - 1 - max(s) ELSE max(s) END AS chunk FROM lasting WHERE gaps = 0 GROUP BY seq_id, start, "end", zone),
    found AS (SELECT seq_id, start, "end", zone, CASE WHEN zone LIKE 'left%' THEN min(pos) ELSE max(pos) END AS pos FROM numbered JOIN chosen USING (seq_id, start, "end", zone)
        WHERE held AND spot >= greatest(0, (chunk - 1) * len) AND spot < least(nv, (chunk + 2) * len) GROUP BY seq_id, start, "end", zone),
    ended AS (SELECT seq_id, start, "end", coalesce(max(pos) FILTER (zone = 'left'), max(pos) FILTER (zone = 'left2')) AS a, coalesce(max(pos) FILTER (zone = 'right'), max(pos) FILTER (zone = 'right2')) + {P.k} AS z FROM found GROUP BY seq_id, start, "end"),
    refined AS (SELECT seq_id, coalesce(a, start) AS start, coalesce(z, "end") AS "end", start AS raw_start, "end" AS raw_end, a IS NOT NULL AS refined FROM spans LEFT JOIN (SELECT * FROM ended WHERE a < z) e USING (seq_id, start, "end"))"""

SQL["refined_spans"] = _with("km", "").rstrip() + ', spans AS (SELECT seq_id, 600::BIGINT AS start, length(seq) - 600 AS "end" FROM dna WHERE length(seq) >= 2000),' + REFINED + " SELECT * FROM refined"

# --- the whole annotation --------------------------------------------------------------------------------------


def _folded(source: str, keys: str, item: str, step: str) -> str:
    """keys, start, end: each group's sorted items, gone through in order with the list of those kept as acc."""
    return f"""SELECT {keys}, x.s AS start, x.e AS "end" FROM (SELECT {keys}, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: {step})) AS x
        FROM (SELECT {keys}, list_sort(list({item})) AS l FROM {source} GROUP BY {keys}))"""


def _unless(clash: str) -> str:
    return f"CASE WHEN len(list_filter(acc, lambda y: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END"


_EDGE = f"(acc[-1].e % {P.band} <= {3 * P.window} OR acc[-1].e % {P.band} >= {P.band - 3 * P.window})"
_JOINED = f"CASE WHEN NOT acc[-1].j AND {_EDGE} AND abs(acc[-1].e - x[1].s) <= {4 * P.window} THEN list_concat(acc[:-2], [{{'s': acc[-1].s, 'e': greatest(acc[-1].e, x[1].e), 'j': true}}]) ELSE list_concat(acc, x) END"
RAW = f"""
    found_spans AS (SELECT seq_id, band, band * {P.band} + a * {P.window} AS start, band * {P.band} + (z + 1) * {P.window} AS "end", min(i) AS first_row FROM rows_ GROUP BY seq_id, band, a, z HAVING count(*) >= 3),
    clear AS ({_folded("found_spans", "seq_id, band", "{'s': start, 'f': first_row, 'e': \"end\"}", _unless(f'abs(y.s - x[1].s) <= {P.window} OR abs(y.e - x[1].e) <= {P.window} OR (y.s < x[1].s AND y.e > x[1].e)'))}),
    once AS ({_folded("clear", "seq_id", "{'b': band, 's': start, 'e': \"end\"}", _unless('y.s = x[1].s OR y.e = x[1].e'))}),
    whole AS ({_folded("once", "seq_id", "{'s': start, 'e': \"end\", 'j': false}", _JOINED)}),
    spans AS (SELECT seq_id, start, least("end", n) AS "end" FROM whole JOIN (SELECT seq_id, length(seq) AS n FROM dna) USING (seq_id) WHERE start < least("end", n)),"""

SQL["annotate_arrays"] = (
    _with("rows_ dbk", "").rstrip()
    + ","
    + RAW
    + REFINED
    + f""",
    inside AS (SELECT DISTINCT r.seq_id, start, "end", kmer FROM refined r JOIN km ON km.seq_id = r.seq_id AND pos >= start AND pos <= "end" - {P.k} WHERE kmer <> 0),
    sizes AS (SELECT seq_id, start, "end", count(*) AS n FROM inside GROUP BY ALL),
    best AS (SELECT * FROM (SELECT seq_id, start, "end", class, count(*) AS o, row_number() OVER (PARTITION BY seq_id, start, "end" ORDER BY count(*) DESC, class) AS rank FROM inside JOIN dbk USING (kmer) GROUP BY seq_id, start, "end", class) WHERE rank = 1)
    SELECT seq_id::VARCHAR AS seq_id, start, "end", refined, CASE WHEN o * 100.0::DOUBLE / n > {P.threshold} THEN class ELSE 'Unknown' END AS name
    FROM refined LEFT JOIN sizes USING (seq_id, start, "end") LEFT JOIN best USING (seq_id, start, "end")"""
)
