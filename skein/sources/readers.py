"""Scans of segment graphs, coverage and side tables. All read through Spark, so any store that Spark opens will do; files that are
missing are an error of the scan, empty ones give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENE = r"COG[0-9]+"


def gene_of(path: Column) -> Column:
    """The gene that a file name holds; an error if it holds none."""
    found = F.regexp_extract(path, GENE, 0)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no gene in the file name "), path)).cast("string")).otherwise(found)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return bool(found)


def _lines(spark: SparkSession, path: str, named: bool = True) -> DataFrame:
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select((gene_of(file) if named else F.lit("")).alias("gene"), F.split("value", "\t").alias("f"), "value")


def gfa(spark: SparkSession, path: str, drop_self_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(unitigs, links) of GFA 1 files, one for each gene: unitigs (gene, unitig, seq, len, kc); links (gene, src, src_fwd, dst, dst_fwd, overlap),
    each as written."""
    lines = _lines(spark, path)
    s = lines.where(F.get("f", F.lit(0)) == "S")
    kc = F.regexp_extract("value", r"KC:i:(\d+)", 1)
    unitigs = s.select("gene", F.get("f", F.lit(1)).alias("unitig"), F.get("f", F.lit(2)).alias("seq"), F.when(kc != "", kc.cast("long")).alias("kc"))
    unitigs = unitigs.withColumn("len", F.char_length("seq"))
    ls = lines.where(F.get("f", F.lit(0)) == "L")
    links = ls.select(
        "gene", F.get("f", F.lit(1)).alias("src"), (F.get("f", F.lit(2)) == "+").alias("src_fwd"), F.get("f", F.lit(3)).alias("dst"), (F.get("f", F.lit(4)) == "+").alias("dst_fwd"),
        F.regexp_extract(F.get("f", F.lit(5)), r"(\d+)M", 1).cast("int").alias("overlap"),
    )
    return unitigs, links.where("src <> dst") if drop_self_links else links


def bcalm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unitigs, links) of unitig FASTA: >id LN:i:n KC:i:n km:f:x L:+:target:- ..."""
    records = fasta(spark, path)
    part = records.select(F.split("header", " ").alias("h"), "seq")
    unitigs = part.select(F.lit("").alias("gene"), F.col("h")[0].alias("unitig"), "seq", F.regexp_extract(F.concat_ws(" ", "h"), r"KC:i:(\d+)", 1).alias("kc"), F.char_length("seq").alias("len"))
    unitigs = unitigs.withColumn("kc", F.when(F.col("kc") != "", F.col("kc").cast("long")))
    ls = part.select(F.col("h")[0].alias("src"), F.explode(F.filter("h", lambda x: x.startswith("L:"))).alias("l")).withColumn("l", F.split("l", ":"))
    return unitigs, ls.select(F.lit("").alias("gene"), "src", (F.col("l")[1] == "+").alias("src_fwd"), F.col("l")[2].alias("dst"), (F.col("l")[3] == "+").alias("dst_fwd"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq): whole header lines without '>', sequence lines joined."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    return rows.select(F.trim(lines[0]).alias("header"), F.concat_ws("", F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x))).alias("seq"))


def haplotype_paths(spark: SparkSession, path: str) -> DataFrame:
    """(gene, strain, pos, unitig, forward) of path files: >GENE_strain, then a comma list of oriented ids."""
    rows = fasta(spark, path).select(F.split("header", "_").alias("h"), F.posexplode(F.split("seq", ",")).alias("pos", "node")).where("node <> ''")
    return rows.select(F.col("h")[0].alias("gene"), F.col("h")[1].alias("strain"), "pos", F.regexp_replace("node", "[+-]$", "").alias("unitig"), (F.right("node", F.lit(1)) == "+").alias("forward"))


#: Splits whose sizes are broadcast, about 100 bytes each.
MOST_SPLITS = 500_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines numbered from 0 within their file. Files are read in splits; a split's lines are numbered by their places in it
    and by the sizes of the splits before, one row each."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    splits = splits.withColumn("before", F.sum("size").over(Window.partitionBy("file").orderBy("at")) - F.col("size")).drop("size")
    splits = F.broadcast(splits) if splits.count() <= MOST_SPLITS else splits
    return rows.join(splits, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("n"), F.regexp_replace("line", "\r$", "").alias("line"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read, seq) of four-line records. Plain files are read in splits; a compressed one, which can't be split, by one task."""
    rows = numbered_lines(spark, path).where("n % 4 = 1")
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(F.concat_ws(":", name, ((F.col("n") - 1) / 4).cast("long")).alias("read"), F.col("line").alias("seq"))


def coverage(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(gene, unitig, sample, cov) of headerless rows id, c1, c2 ...; separators at the end of a row don't count."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), GENE, 0).alias("gene"), F.split(F.regexp_replace("value", rf"[{sep}\s]+$", ""), sep).alias("f"))
    rows = rows.where(F.size("f") > 1)
    return rows.select("gene", F.col("f")[0].alias("unitig"), F.posexplode(F.slice("f", 2, 1 << 30)).alias("sample", "c")).select("gene", "unitig", "sample", F.col("c").cast("double").alias("cov"))


def gene_lengths(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema("gene string, aa_len double").csv(path, sep=sep)


def stops(spark: SparkSession, path: str) -> DataFrame:
    """(gene, nth, unitig, forward): stop codons in file order."""
    rows = spark.read.text(path, wholetext=True).select(gene_of(F.col("_metadata.file_path")).alias("gene"), F.posexplode(F.split("value", "\n")).alias("nth", "line")).where(F.trim("line") != "")
    f = F.split("line", "\t")
    return rows.select("gene", "nth", f[0].alias("unitig"), (F.trim(f[1]) != "-").alias("forward"))


def dead_ends(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(gene_of(F.col("_metadata.file_path")).alias("gene"), F.trim("value").alias("unitig")).where("unitig <> ''")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(gene): one name a line."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")


def reference_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("unitig string, hit string, pid double, extra string, divergence double").csv(path, sep="\t").drop("extra")


def reference_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(unitig, hit): every reference of a line."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(f[0].alias("unitig"), F.explode(F.slice(f, 2, 1 << 30)).alias("hit")).where("hit <> ''")


def unitig_order(spark: SparkSession, path: str) -> DataFrame:
    """(unitig, start, end, forward); None is null."""
    return spark.read.schema("unitig string, start int, end int, forward boolean").csv(path, nullValue="None")


def blast(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column tabular hits."""
    schema = "query string, ref string, pid double, length int, mismatch int, gaps int, qstart int, qend int, sstart int, send int, evalue double, bits double"
    return spark.read.schema(schema).csv(path, sep="\t")


def contig_paths(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, unitig) of alternating NODE and comma-list lines; a contig's list may go on after ';'. Each record is a row of the scan."""
    rows = spark.read.option("lineSep", "\nNODE").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", r"^NODE|\r", ""), "\n")
    listed = F.concat_ws(",", F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.regexp_replace(x, r"[;\s]", "")))
    steps = rows.select(F.concat(F.lit("NODE"), F.trim(lines[0])).alias("contig"), F.filter(F.split(listed, ","), lambda x: x != "").alias("p"))
    return steps.select("contig", F.posexplode("p").alias("pos", "node")).select("contig", "pos", F.regexp_replace("node", "[+-]", "").alias("unitig"))


def bins(spark: SparkSession, path: str) -> DataFrame:
    """(id, bin) of CSV files, each with a header: the first and the last column. Headers are told by a last column that is no number."""
    f = F.split("value", ",")
    return spark.read.text(path).select(f[0].alias("id"), F.trim(F.element_at(f, -1)).try_cast("int").alias("bin")).where("bin is not null")


def overlap_of(spark: SparkSession, path: str) -> DataFrame:
    """(gene, k): the k that a GFA header line names in its tag kk, for files that have one."""
    lines = _lines(spark, path).where(F.get("f", F.lit(0)) == "H")
    k = F.regexp_extract("value", r"kk:i:(\d+)", 1)
    return lines.where(k != "").groupBy("gene").agg(F.max(k.cast("int")).alias("k"))


def gene_best_hits(spark: SparkSession, path: str) -> DataFrame:
    schema = "query string, gene string, evalue double, pid double, subject_pid double, coverage double, query_coverage double"
    return spark.read.schema(schema).csv(path, sep="\t")
