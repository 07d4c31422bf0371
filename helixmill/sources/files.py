"""Reads, counts, cutoffs and trusted sets in files."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.staging import checkpointed


#: Splits of input whose line counts are sent to all tasks, some 100 bytes each; with more they are joined.
BROADCAST_SPLITS = 500_000
_READ = ("header", "seq", "mid", "qual")


def read_fastq(spark: SparkSession, *paths: str, lenient: bool = False) -> DataFrame:
    """(file, ordinal, read_id, header, seq, mid, qual) of FASTQ files, plain or gzip.

    Records are four lines; a last one without a line end counts.  Lines are
    numbered file by file where they lie: each split counts its lines, and
    starts where the splits before it end, so a large plain file is read in
    parallel.  A record inside a split is put together there; only records
    that lie across two splits are shuffled.  read_id is ordinal plus 2^40
    times the file's number in the order of names.  Headers lose their @.  A
    record whose lengths differ is an error.

    `lenient` looks for the next @ where a header should be, whatever stands
    before it, drops blanks before the header and white space inside sequences
    and qualities, and leaves out a last record that is not complete.
    """
    if lenient:
        return _checked(_resynchronised(spark, *paths).where("qual IS NOT NULL"))
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    starts = sizes.selectExpr("file", "at", "n", "first", "sum(n) OVER (PARTITION BY file ORDER BY at) - n AS before", "dense_rank() OVER (ORDER BY file) - 1 AS number")
    few = starts.count() <= BROADCAST_SPLITS
    numbered = lines.join(F.broadcast(starts) if few else starts, ["file", "at"]).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    numbered = numbered.withColumn("ordinal", F.expr("line div 4"))
    whole = F.expr("ordinal * 4 >= before AND ordinal * 4 + 4 <= before + n")
    # A join that shuffles mixes the lines: then all records are put together by their numbers.
    shuffled = numbered.where(~whole) if few else numbered
    rows = shuffled.withColumn("part", F.expr("line % 4")).groupBy("file", "number", "ordinal").agg(*(F.max(F.when(F.col("part") == i, F.col("value"))).alias(c) for i, c in enumerate(_READ)))
    if few:
        rows = numbered.where(whole).select("file", "number", "ordinal", "value").mapInArrow(_four_lines, rows.schema).unionByName(rows)
    return _checked(rows.where("NOT (header = '' AND seq IS NULL)"))


def _checked(rows: DataFrame) -> DataFrame:
    bad = "header NOT LIKE '@%' OR qual IS NULL OR length(seq) != length(qual)"
    checked = F.expr(f"IF({bad}, CAST(raise_error(concat('not a FASTQ record: ', file, ' ', CAST(ordinal AS STRING))) AS STRING), substring(header, 2))")
    return rows.select("file", "ordinal", F.expr("shiftleft(CAST(number AS BIGINT), 40) + ordinal").alias("read_id"), checked.alias("header"), "seq", "mid", "qual")


def _step(state: int, line: str) -> tuple[int, int]:
    """(next state, records begun) of a reader that wants a header (state 0) or one of the three lines after it."""
    if state:
        return (state + 1) % 4, 0
    return (1, 1) if "@" in line else (0, 0)


def _splits(batches):
    """(file, at, lines, first row as a batch) of the input splits in Arrow batches, piece by piece."""
    for batch in batches:
        files, at, lines = (batch.column(c) for c in ("file", "at", "value"))
        cuts = np.flatnonzero(np.diff(at.to_numpy())) + 1 if batch.num_rows else []
        names = files.dictionary_encode().indices.to_numpy()
        edges = [0, *sorted({*cuts, *(np.flatnonzero(np.diff(names)) + 1)}), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield files[a].as_py(), at[a].as_py(), lines.slice(a, b - a).to_pylist(), batch.slice(a, 1)


def _resynchronised(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of files that have other lines between them, as (file, number, ordinal, header, seq, mid, qual).

    Where a split begins inside a record depends on all splits before it, so
    each split first says where a reader in each of the four states would end.
    Those small rows are strung together file by file.
    """
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("id"), "value")

    def ends(batches):
        found: dict[tuple, list] = {}
        for file, at, values, _ in _splits(batches):
            runs = found.setdefault((file, at), [(s, 0) for s in range(4)])
            for v in values:
                runs[:] = [(to, n + begun) for (s, n) in runs for to, begun in [_step(s, v)]]
        for (file, at), runs in found.items():
            yield pa.RecordBatch.from_pydict({"file": [file], "at": pa.array([at], pa.int64()), "ends": pa.array([[s for s, _ in runs]], pa.list_(pa.int32())), "begun": pa.array([[n for _, n in runs]], pa.list_(pa.int64()))})

    def walked(table):
        state, n, out = 0, 0, [[], []]
        table = table.sort_by("at")
        for to, begun in zip(table["ends"].to_pylist(), table["begun"].to_pylist()):
            out[0].append(state)
            out[1].append(n)
            state, n = to[state], n + begun[state]
        return pa.table({"file": table["file"], "at": table["at"], "state": pa.array(out[0], pa.int32()), "before": pa.array(out[1], pa.int64())})

    splits = lines.select("file", "at", "value").mapInArrow(ends, "file string, at long, ends array<int>, begun array<bigint>")
    starts = splits.groupBy("file").applyInArrow(walked, "file string, at long, state int, before long")
    starts = checkpointed(starts.selectExpr("*", "CAST(dense_rank() OVER (ORDER BY file) - 1 AS INT) AS number"))
    if starts.count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(starts), ["file", "at"])
    else:  # the join shuffles and mixes the lines
        placed = lines.join(starts, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "id")

    def parts(batches):
        state: dict[tuple, tuple[int, int]] = {}
        for file, at, values, own in _splits(batches):
            first = own.select(["state", "before", "number"]).to_pylist()[0]
            s, n = state.get((file, at), (first["state"], first["before"]))
            out: list[list] = [[], [], []]
            for v in values:
                to, begun = _step(s, v)
                n += begun
                if s or begun:
                    for column, value in zip(out, (n - 1, s, "@" + v.partition("@")[2].lstrip(" ") if begun else v)):
                        column.append(value)
                s = to
            state[file, at] = s, n
            rows = len(out[0])
            yield pa.RecordBatch.from_pydict({"file": pa.array([file] * rows, pa.string()), "number": pa.array([first["number"]] * rows, pa.int32()), "ordinal": pa.array(out[0], pa.int64()), "part": pa.array(out[1], pa.int32()), "value": pa.array(out[2], pa.string())})

    found = placed.drop("id").mapInArrow(parts, "file string, number int, ordinal long, part int, value string")
    rows = found.groupBy("file", "number", "ordinal").agg(*(F.max(F.when(F.col("part") == i, F.col("value"))).alias(c) for i, c in enumerate(_READ)))
    return rows.withColumns({c: F.regexp_replace(c, r"\s", "") for c in ("seq", "qual")})


def _four_lines(batches):
    """Rows of four lines each that follow each other, as one row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        n = table.num_rows // 4 * 4
        held = table.slice(n).combine_chunks().to_batches()
        if n:
            first = pa.array(np.arange(0, n, 4))
            values = table.column("value")
            columns = [table.column(c).take(first) for c in ("file", "number", "ordinal")] + [values.take(pa.array(np.arange(i, n, 4))) for i in range(4)]
            yield from pa.table(columns, names=["file", "number", "ordinal", *_READ]).combine_chunks().to_batches()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, file, mate_file, pe_code) of a list: one name a line, or two for mates.

    The list ends at the first blank line; another number of names is an error.
    pe_code is 0 for single reads, 1 and 2 for first and second mates.
    """
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    out = []
    for line in "\n".join(lines).split("\n"):
        names = line.split()
        if not names:
            break
        if len(names) > 2:
            raise ValueError(f"one or two names a line: {line}")
        out += [(len(out), names[0], None, 0)] if len(names) == 1 else [(len(out), names[0], names[1], 1), (len(out) + 1, names[1], names[0], 2)]
    zipped = {f.endswith(".gz") for _, f, _, _ in out}
    if len(zipped) > 1:
        raise ValueError("either all files are gzip or none")
    return spark.createDataFrame(out, "ordinal int, file string, mate_file string, pe_code int")


def quality_offset(reads: DataFrame, first: int, order: str = "ordinal") -> DataFrame:
    """One row (quality_offset): 33 if a quality byte below 64 occurs in the first reads, else 64."""
    used = reads.where(F.col(order) < first)
    low = F.expr("array_min(transform(filter(split(qual, ''), c -> c != ''), c -> ascii(c)))")
    return used.agg(F.min(low).alias("least")).select(F.when(F.col("least") < 64, 33).otherwise(64).cast("int").alias("quality_offset"))


def read_counts(spark: SparkSession, path: str, k: int, value: str = "n", kind: str = "bigint") -> DataFrame:
    """(kmer, value) of k characters, a tab or blank, and a number; another length is an error."""
    rows = spark.read.text(path).where("value != ''")
    kmer = F.expr(f"IF(value RLIKE '^[A-Za-z]{{{k}}}[ \\t][^ \\t]+$', substring(value, 1, {k}), CAST(raise_error(concat('not a count line: ', value)) AS STRING))")
    return rows.select(kmer.alias("kmer"), F.expr(f"substring(value, {k + 2})").cast(kind).alias(value))


def read_count_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n) of alternating lines `>count` and k-mer."""
    lines = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    return lines.selectExpr("trim(element_at(split(value, '\\\\s+'), 2)) AS kmer", "CAST(element_at(split(value, '\\\\s+'), 1) AS BIGINT) AS n")


def read_at_cutoffs(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(at, cutoff) of a file with k + 1 lines."""
    values = [float(x) for r in spark.read.text(path, wholetext=True).collect() for x in r[0].split()]
    if len(values) != k + 1:
        raise ValueError(f"{k + 1} cutoffs are needed, the file has {len(values)}")
    return spark.createDataFrame(list(enumerate(values)), "at int, cutoff double")


def read_cutoff(spark: SparkSession, path: str) -> float:
    """The number in a cutoff file's first line.  An empty file is an error."""
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"no cutoff in {path}")
    return float(first[0])


def write_counts(counts: DataFrame, path: str, value: str = "n", style: str = "int", min_count: float = 0) -> None:
    """k-mer, tab, count.  style int: more than min_count; q (%f) and fixed (%.3f): min_count or more."""
    if style == "int":
        rows, text = counts.where(F.col(value) > min_count), F.col(value).cast("string")
    else:
        rows, text = counts.where(F.col(value) >= min_count), F.format_string("%f" if style == "q" else "%.3f", F.col(value).cast("double"))
    rows.select(F.concat_ws("\t", "kmer", text)).write.text(path)


def write_fastq(rows: DataFrame, path: str, gzip: bool = False, one_line: bool = False, order: list[str] | None = None) -> None:
    """Records (header, seq, mid, qual) in order; one_line: header, tab, sequence.

    The qualities are cut to the sequence.  With `order` the files, read in
    name order, have the records in that order.
    """
    if order:
        rows = rows.orderBy(*order)
    line = F.concat_ws("\t", "header", "seq") if one_line else F.concat_ws("\n", F.concat(F.lit("@"), "header"), "seq", F.coalesce("mid", F.lit("+")), F.expr("substring(qual, 1, length(seq))"))
    rows.select(line.alias("value")).write.text(path, compression="gzip" if gzip else "none")


def output_name(path: str, kind: str, gzip: bool = False) -> str:
    """<prefix>.<kind><extension>; a name without extension gets none; gzip adds .gz."""
    base = path.removesuffix(".gz")
    folder, slash, name = base.rpartition("/")
    prefix, dot, extension = name.rpartition(".")
    return folder + slash + (f"{prefix}.{kind}.{extension}" if dot else f"{name}.{kind}") + (".gz" if gzip else "")


#: Kinds of output files of single reads and of mates; {} is cor or trim.  Those behind the first one, or two, are of removed reads.
_SINGLE, _PAIRED = ("{}", "err"), ("{}", "{}_single", "err_single", "err")
_KEPT = {"header": "out_header", "seq": "out_seq", "mid": "mid", "qual": "out_qual"}
#: A removed read has its own record; its header ends where the mark would begin.
_REMOVED_HEADER = "concat(header, ' ')"


def write_many(rows: DataFrame, paths: list[str], gzip: bool = False) -> list[str]:
    """Lines (out, at, then, value) to the text folders paths[out], each in the order of at and then: one job for all of them.

    A folder's files, read in name order, are its lines in order.  A path
    without lines becomes an empty folder; one that is there already is an error.
    """
    spark = rows.sparkSession
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    targets = [hadoop.Path(p) for p in paths]
    for p, target in zip(paths, targets):
        if target.getFileSystem(conf).exists(target):
            raise FileExistsError(p)
    order = ["out", "at", "then"]
    stage = f"{targets[0].getParent().toString()}/.helixmill-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("out", "value").write.partitionBy("out").text(stage, compression="gzip" if gzip else "none")
    top = hadoop.Path(stage)
    source = top.getFileSystem(conf)
    for k, target in enumerate(targets):
        own, to = hadoop.Path(f"{stage}/out={k}"), target.getFileSystem(conf)
        to.mkdirs(target.getParent())
        if not source.exists(own):
            to.mkdirs(target)
        elif source.getUri().equals(to.getUri()):
            source.rename(own, target)
        else:
            hadoop.FileUtil.copy(source, own, to, target, True, conf)
    source.delete(top, True)
    return paths


def sides_of(rows: DataFrame, manifest: list[tuple[str, ...]]) -> DataFrame:
    """(file, entry, side, paired) of the files of `rows` (column file) that a manifest names, by paths with or without a scheme.

    There are as many rows as files.  Spark may give names with %20 and the like.
    """
    ends = {}
    for entry, paths in enumerate(manifest):
        for side, path in enumerate(paths):
            bare = "/" + re.sub(r"^\w+:/+", "", path).lstrip("/")
            ends |= {bare: (entry, side, len(paths) > 1), quote(bare): (entry, side, len(paths) > 1)}
    found = []
    for (file,) in rows.select("file").distinct().collect():
        at = [t for end, t in ends.items() if file.endswith(end)]
        found += [(file, *at[0])] if at else []
    return rows.sparkSession.createDataFrame(found, "file string, entry int, side int, paired boolean")


def _record(fields: dict[str, str], one_line: bool) -> str:
    if one_line:
        return f"concat_ws('\t', {fields['header']}, {fields['seq']})"
    return f"concat_ws('\n', concat('@', {fields['header']}), {fields['seq']}, coalesce({fields['mid']}, '+'), substring({fields['qual']}, 1, length({fields['seq']})))"


def routed(rows: DataFrame, manifest: list[tuple[str, ...]], to: list[tuple[str, ...]], keep_errors: bool = False, gzip: bool = False, kind: str = "cor", one_line: bool = False) -> tuple[DataFrame, list[list[str]]]:
    """(lines for write_many(), the paths of each entry of the manifest) of output rows (file, ordinal, status, ...).

    Single reads: removed ones to .err (keep_errors), the others to .<kind>.
    Mates, by ordinal and in step: both kept to .<kind>; the one that is kept
    to .<kind>_single; with keep_errors the removed one of a pair to
    .err_single, and pairs without a kept read to .err.  A read without a mate
    is an error.
    """
    sides, names, base = sides_of(rows, manifest), [], []
    for paths, targets in zip(manifest, to):
        base.append(sum(map(len, names)))
        kinds = (_PAIRED if keep_errors else _PAIRED[:2]) if len(paths) > 1 else (_SINGLE if keep_errors else _SINGLE[:1])
        names.append([output_name(t, name.format(kind), gzip) for t in targets for name in kinds])
    first = f"array({', '.join(map(str, base))})[entry]"
    placed = rows.join(F.broadcast(sides), "file")
    removed = {**_KEPT, "header": _REMOVED_HEADER}
    record = F.expr(f"IF(status = 'removed', {_record(removed, one_line)}, {_record(_KEPT, one_line)})")
    own = placed.select("entry", "side", "paired", "ordinal", (F.col("status") != "removed").alias("ok"), record.alias("value"))
    alone = own.where("NOT paired").withColumn("kind", F.expr("IF(ok, 0, 1)")).where("kind = 0" if not keep_errors else "true").withColumn("out", F.expr(f"{first} + kind"))
    one, two = (own.where(f"paired AND side = {i}").select("entry", "ordinal", F.struct("ok", "value").alias(f"r{i}")) for i in (0, 1))
    both = one.join(two, ["entry", "ordinal"], "full_outer")
    mate = "CAST(raise_error(concat('a read has no mate: ', CAST(ordinal AS STRING))) AS INT)"
    both = both.withColumn("kind", F.expr(f"CASE WHEN r0 IS NULL OR r1 IS NULL THEN {mate} WHEN r0.ok AND r1.ok THEN 0 WHEN r0.ok OR r1.ok THEN 1 ELSE 3 END"))
    each = both.select("entry", "ordinal", "kind", F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"r{i}.ok").alias("ok"), F.col(f"r{i}.value").alias("value")) for i in (0, 1)))).alias("r"))
    each = each.select("entry", "ordinal", "r.side", "r.value", F.expr("IF(kind = 1 AND NOT r.ok, 2, kind)").alias("kind"))
    each = each.where("kind < 2" if not keep_errors else "true").withColumn("out", F.expr(f"{first} + side * {4 if keep_errors else 2} + kind"))
    lines = [df.select(F.col("out").cast("int").alias("out"), F.col("ordinal").alias("at"), F.lit(0).cast("bigint").alias("then"), "value") for df in (alone, each)]
    return lines[0].union(lines[1]), names


def write_routed(rows: DataFrame, path: str, keep_errors: bool = False, gzip: bool = False, kind: str = "cor", one_line: bool = False) -> list[str]:
    """One file's reads, see routed()."""
    lines, names = routed(rows.withColumn("file", F.lit(f"/{path}")), [(path,)], [(path,)], keep_errors, gzip, kind, one_line)
    return write_many(lines, names[0], gzip)


def write_paired(first: DataFrame, second: DataFrame, path1: str, path2: str, keep_errors: bool = False, gzip: bool = False, kind: str = "cor") -> list[str]:
    """Two files' mates, see routed()."""
    both = first.withColumn("file", F.lit(f"/{path1}")).unionByName(second.withColumn("file", F.lit(f"/{path2}")))
    lines, names = routed(both, [(path1, path2)], [(path1, path2)], keep_errors, gzip, kind)
    return write_many(lines, names[0], gzip)


def stats_name(path: str) -> str:
    return output_name(path, "stats").rpartition(".stats")[0] + ".stats.txt"


def stats_lines(stats: DataFrame) -> DataFrame:
    """(file, at, value): each row of run_stats() as labelled lines."""
    labels = ("validated", "corrected", "trimmed", "trimmed_only", "removed")
    lines = F.array(*(F.concat(F.lit(f"{n.capitalize().replace('_', ' ')}: "), F.col(n).cast("string")) for n in labels))
    return stats.select("file", F.posexplode(lines).alias("at", "value"))


def log_lines(log: DataFrame) -> DataFrame:
    """(file, at, then, value): quality, place, new and old base of each change, in the order of reads and places."""
    return log.select("file", F.col("read_id").alias("at"), F.col("pos").cast("bigint").alias("then"), F.concat_ws("\t", *(F.col(c).cast("string") for c in ("q", "pos", "new_nt", "old_nt"))).alias("value"))


def error_model_name(path: str) -> str:
    """error_model.<prefix>.txt beside the reads."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}error_model.{name.rpartition('.')[0] or name}.txt"


_BITS_PER_ROW = 8 * 65_536
#: Empty bytes that are written at once.
_ZEROS = 1 << 20


def write_bitset(trusted: DataFrame, k: int, path: str) -> None:
    """Both strands of the k-mers as a bit array of 4^k bits, the first bit highest.

    Each row of the Parquet output is one chunk (chunk, bits) of 64 KiB; empty
    chunks are left out, so the size follows the k-mers, not 4^k.
    """
    packed = trusted.select(dna.pack("kmer").alias("p")).union(trusted.select(dna.pack(dna.reverse_complement("kmer")))).distinct()
    rows = packed.select(F.expr(f"p div {_BITS_PER_ROW}").alias("chunk"), F.expr(f"CAST(p % {_BITS_PER_ROW} AS INT)").alias("bit"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_BITS_PER_ROW, dtype=np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    rows.groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").write.parquet(path)


def write_raw_bitset(chunks: DataFrame, k: int, path: str) -> None:
    """The chunks of write_bitset() as one raw file of 4^k / 8 bytes, whatever the k.

    The file is a stream, so the chunks go through the driver one after the
    other, 64 KiB each; empty ones are zeros that the driver only counts.
    """
    spark, size = chunks.sparkSession, max(1, 4**k // 8)
    whole = min(size, _BITS_PER_ROW // 8)
    zeros = spark.sparkContext._gateway.new_array(spark._jvm.byte, _ZEROS)  # stays where the stream is
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out, written = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at), 0

    def fill(upto: int) -> None:
        for left in range(upto - written, 0, -_ZEROS):
            out.write(zeros, 0, min(left, _ZEROS))

    for chunk, bits in chunks.orderBy("chunk").toLocalIterator():
        fill(chunk * whole)
        out.write(bytes(bits)[:whole])
        written = (chunk + 1) * whole
    fill(size)
    out.close()


def _raw_chunks(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(chunk, bits) of a raw file, read in pieces of 64 KiB by as many tasks as it has splits."""
    size = max(1, 4**k // 8)
    pieces = spark.sparkContext.binaryRecords(path, min(size, _BITS_PER_ROW // 8)).zipWithIndex()
    return pieces.map(lambda piece: (piece[1], piece[0])).toDF("chunk long, bits binary")


def read_bitset(spark: SparkSession, path: str, k: int, raw: bool = False) -> DataFrame:
    """(kmer) of a bit array: of write_bitset, or (raw) a file of 4^k / 8 bytes."""
    chunks = _raw_chunks(spark, path, k) if raw else spark.read.parquet(path)

    def unpack(batches):
        for pdf in batches:
            for chunk, bits in zip(pdf["chunk"], pdf["bits"]):
                found = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))
                if len(found):
                    yield pd.DataFrame({"p": found + chunk * _BITS_PER_ROW})

    return chunks.mapInPandas(unpack, "p long").where(f"p < {4**k}L").select(dna.unpack("p", k).alias("kmer"))
