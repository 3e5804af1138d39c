"""DNA strings: reverse complements, walks over overlapping segments, k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reverse and swap A-T, C-G; other letters stay as they are, lower case included."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def oriented(seq: Column, forward: Column) -> Column:
    return F.when(forward, seq).otherwise(reverse_complement(seq))


def node_name(unitig: Column, forward: Column) -> Column:
    """A segment and its direction as one name: id+ or id-."""
    return F.concat(unitig.cast("string"), F.when(forward, "+").otherwise("-"))


def unitig_of(name: Column) -> Column:
    return F.substring(name, 1, F.char_length(name) - 1)


def is_forward(name: Column) -> Column:
    return F.right(name, F.lit(1)) == "+"


def reverse_node(name: Column) -> Column:
    return F.concat(unitig_of(name), F.translate(F.right(name, F.lit(1)), "+-", "-+"))


def walk_sequences(paths: DataFrame, unitigs: DataFrame, overlap: int, keys: list[str]) -> DataFrame:
    """keys + seq: the walk's sequence, for paths (keys, pos, unitig, forward) over unitigs (unitig, seq): oriented sequences, all but the
    first without their first `overlap` letters."""
    steps = paths.join(unitigs.select("unitig", "seq"), "unitig")
    first = F.min("pos").over(_by(keys))
    piece = oriented(F.col("seq"), F.col("forward"))
    steps = steps.withColumn("first", first).withColumn("piece", F.when(F.col("pos") == F.col("first"), piece).otherwise(F.substring(piece, overlap + 1, 1 << 30)))
    return steps.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k letters; none if the sequence is shorter."""
    n = F.char_length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_composition(reads: DataFrame, k: int, longer_than: int = 25) -> DataFrame:
    """(kmer, n, n_start): canonical k-mers (the smaller of a k-mer and its reverse complement) of reads (read, seq) longer than
    `longer_than`, with A, C, G and T alone; n_start counts those that begin a read."""
    rows = reads.where(F.char_length("seq") > longer_than).select(F.posexplode(kmers(F.col("seq"), k)).alias("pos", "raw")).where(F.col("raw").rlike("^[ACGT]+$"))
    return rows.select(F.least("raw", reverse_complement(F.col("raw"))).alias("kmer"), "pos").groupBy("kmer").agg(F.count("*").alias("n"), F.sum((F.col("pos") == 0).cast("long")).alias("n_start"))
