"""Correction of reads: relational up to the regions, a search for each read, relational again."""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.staging import checkpoint_dir, checkpointed

from . import error_model, prefilter, regions, scan, search, windows
from .trim import LEAST_LENGTH, quick_trim
from .trusted import untrusted_positions

#: Trusted k-mers that every executor gets as a file at most, 8 bytes each; more are asked by joins.
SHARED_KMERS = 100_000_000
#: k-mers of that file that pass through the driver at a time.
_PIECE = 500_000
#: Bytes of a file with a bit for each k-mer at most (k of 15), and how many such bytes a k-mer takes at most.
MOST_BYTES, _SPARSE = 2**27, 64
#: Bits of a piece of that file, as a power of 2.
_BITS = 23
#: Tasks of a search for each shuffle partition: reads differ by orders of magnitude in what they cost.
TASKS_A_PARTITION = 8
#: Queue entries looked up together where an answer takes a join.
_AHEAD_OF_JOIN = 1024


@dataclass(frozen=True)
class SharedKmers:
    """Packed k-mers in a file that each executor fetches once; its Python workers map the same pages.

    The file has them sorted, or (bits) a bit for each k-mer there is.
    """

    name: str
    n: int
    bits: bool = False

    def load(self) -> np.ndarray:
        if self.bits:
            return np.asarray(np.memmap(SparkFiles.get(self.name), dtype="u1", mode="r"))
        return np.asarray(np.memmap(SparkFiles.get(self.name), dtype="<i8", mode="r", shape=(self.n,))) if self.n else np.zeros(0, dtype=np.int64)

    def opened(self, k: int) -> search.TrustedSet:
        return (search.TrustedBits if self.bits else search.TrustedSet)(self.load(), k)


def _runs_of(packed: DataFrame) -> DataFrame:
    """(piece): the sorted k-mers of the column packed, up to _PIECE of them a row."""

    def pieces(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), _PIECE):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([values[at : at + _PIECE].tobytes()], pa.binary())})

    return packed.orderBy("packed").mapInArrow(pieces, "piece binary")


def _bits_of(packed: DataFrame) -> DataFrame:
    """(at, piece) in order: the bytes of a bit array from byte `at` on; pieces without a k-mer are left out."""

    def piece(table: pa.Table) -> pa.Table:
        kmers = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table["packed"].chunks])
        at = int(kmers[0]) >> _BITS << (_BITS - 3)
        bits = np.zeros(2**_BITS, dtype=np.uint8)
        bits[kmers & (2**_BITS - 1)] = 1
        return pa.table({"at": pa.array([at], pa.int64()), "piece": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    # Kept, as sorting looks at its input twice.
    return checkpointed(packed.groupBy(F.expr(f"packed >> {_BITS}")).applyInArrow(piece, "at bigint, piece binary")).orderBy("at")


def packed_trusted(trusted: DataFrame, k: int, most: int = SHARED_KMERS) -> SharedKmers | DataFrame:
    """The packed canonical k-mers as a file for the executors, else `trusted` as it is.

    Where a bit for each k-mer takes no more than MOST_BYTES, any number of them
    has a file: many as bits, few sorted.  Else there may be `most`.

    Spark makes the pieces; the driver only strings pieces of bounded size together
    to the file in the shared folder, from where executors fetch it.
    """
    n = trusted.count()
    size = 4**k // 8
    dense = size <= MOST_BYTES and n * _SPARSE >= size
    if n > most and not (dense and most >= SHARED_KMERS):
        return trusted
    spark, name = trusted.sparkSession, f"trusted-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    packed = trusted.select((F.col("packed") if "packed" in trusted.columns else dna.pack("kmer")).alias("packed"))
    if dense:
        done = 0

        def fill(upto: int) -> None:
            for at in range(done, upto, 2 ** (_BITS - 3)):
                out.write(bytes(min(2 ** (_BITS - 3), upto - at)))

        for row in _bits_of(packed).toLocalIterator():
            fill(row.at)
            piece = bytes(row.piece)[: size - row.at]
            out.write(piece)
            done = row.at + len(piece)
        fill(size)
    else:
        for row in _runs_of(packed).toLocalIterator():
            out.write(bytes(row.piece))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return SharedKmers(name, n, dense)


def suspects(reads: DataFrame, trusted: DataFrame, k: int, offset: int, trim_threshold: int = 3, untrusted: DataFrame | None = None, shared: SharedKmers | DataFrame | None = None) -> DataFrame:
    """Reads (read_id, seq, qual, ...) with trim_len and comps: their components, regions included.

    comps is null where no untrusted window survives the trimming; reads below
    the least length have trim_len 0.  `untrusted` as for untrusted_positions().
    If `shared` (from packed_trusted()) is a file, the tasks that trim look into it, and nothing is joined.
    """
    if isinstance(shared, SharedKmers):
        return scan.suspects(reads, shared, k, offset, trim_threshold)
    trimmed = quick_trim(reads, trim_threshold, offset).withColumn("trim_len", F.when(F.length("seq") < LEAST_LENGTH, 0).otherwise(F.col("trim_len")))
    # Only windows that survive the trimming are looked at.
    bad = untrusted_positions(trimmed.select("read_id", F.expr("substring(seq, 1, trim_len)").alias("seq")), trusted, k, untrusted)
    comps = regions.with_core(regions.components(bad, k), k)
    comps = comps.join(trimmed.select("read_id", "qual", "trim_len"), "read_id").withColumn("q", dna.checked_phreds("qual", offset)).withColumn("probs", dna.probabilities("q"))
    comps = regions.error_region_chop(regions.error_region(comps, k), k)
    listed = comps.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("component", "starts", "chopped", "region"))).alias("comps"))
    return trimmed.join(listed, "read_id", "left")


_CODES = np.full(256, 4, dtype=np.int64)
_CODES[[ord(c) for c in "ACGT"]] = range(4)


def _parsed(r, offset: int, right: np.ndarray) -> tuple[search.Read, list]:
    n = int(r.trim_len)
    codes = _CODES[np.frombuffer(r.seq[:n].encode("latin-1", "replace"), dtype=np.uint8)]
    quality = np.frombuffer(r.qual[:n].encode("latin-1"), dtype=np.uint8).astype(np.int64) - offset
    comps = [tuple([int(i) for i in c[name]] for name in ("starts", "chopped", "region")) for c in r.comps]
    return search.Read(codes, quality, right[quality]), comps


def _outcome(r, edits: dict[int, int], keep: int, solved: bool) -> tuple:
    seq = list(r.seq[:keep])
    used = [(i, "ACGT"[b]) for i, b in sorted(edits.items()) if i < keep]
    for i, b in used:
        seq[i] = b
    return "".join(seq), solved, [{"place": i, "base": b} for i, b in used]


_FOUND = {"cor": "string", "solved": "boolean", "edits": "array<struct<place:int,base:string>>"}

#: An error model, or one for each file by its name.
Models = np.ndarray | dict[str, np.ndarray]


def _schema(rows: DataFrame, more: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {kind}" for c, kind in more.items())])


def _model(models: Models, r) -> np.ndarray:
    return models[r.file] if isinstance(models, dict) else models


def searched_by_rounds(hard: DataFrame, trusted: DataFrame, k: int, offset: int, models: Models, priors: list[float], learning: bool = False) -> DataFrame:
    """What searched() gives for reads with components, for a trusted set of any size.

    A round searches each read until it comes to windows that are not known to
    it, notes them, and packs up the search as it stands.  A join with the
    trusted set answers, and the next round goes on from there.  Nothing is
    broadcast.  Each round is checkpointed in the shared folder.
    """
    right = np.array(dna.quality_probabilities())
    kept = [c for c in hard.columns if c != "comps"]
    state = hard.withColumns({"kmers": F.expr("CAST(array() AS ARRAY<BIGINT>)"), "oks": F.expr("CAST(array() AS ARRAY<BOOLEAN>)"), "progress": F.lit(None).cast("binary")})
    schema = _schema(state, {**_FOUND, "missing": "array<bigint>"})
    answers = trusted.select(dna.pack("kmer").alias("kmer"), F.lit(True).alias("ok"))
    sent = hard.sparkSession.sparkContext.broadcast(models)
    done = None

    def run(batches):
        for pdf in batches:
            out, progress = [], []
            for r in pdf.itertuples(index=False):
                known = search.AskedSet(np.asarray(r.kmers, dtype=np.int64), np.asarray(r.oks, dtype=bool), k)
                read, comps = _parsed(r, offset, right)
                try:
                    edits, keep, solved, _ = search.correct(read, comps, known, _model(sent.value, r), priors, learning, pickle.loads(r.progress) if r.progress else None, _AHEAD_OF_JOIN)
                    out.append((*_outcome(r, edits, keep, solved), []))
                    progress.append(None)
                except search.Pending as waits:
                    out.append(("", False, [], sorted(known.missing)))
                    progress.append(pickle.dumps(waits.state))
            yield pdf.assign(**dict(zip([*_FOUND, "missing"], map(list, zip(*out)))), progress=progress)

    while True:
        found = checkpointed(state.mapInPandas(run, schema))
        ready = found.where("size(missing) = 0").select(*kept, *_FOUND)
        done = ready if done is None else done.union(ready)
        asked = found.where("size(missing) > 0")
        if asked.isEmpty():
            return done
        told = asked.select("read_id", F.explode("missing").alias("kmer")).join(answers, "kmer", "left").groupBy("read_id").agg(F.collect_list("kmer").alias("new"), F.collect_list(F.coalesce("ok", F.lit(False))).alias("new_oks"))
        state = asked.select(*state.columns).join(told, "read_id").withColumns({"kmers": F.concat("kmers", "new"), "oks": F.concat("oks", "new_oks")}).drop("new", "new_oks")


def searched(rows: DataFrame, trusted: SharedKmers | DataFrame, k: int, offset: int, models: Models, priors: list[float], learning: bool = False) -> DataFrame:
    """rows without comps, but with (cor, solved, edits): the corrected prefix of each read.

    Only reads with components are searched, spread by a hash of their id.
    `trusted` is what packed_trusted() gives: a file of them, or the trusted
    k-mers themselves if they are too many.  With models by file (5.6 KB each) rows have a column `file`.
    """
    # A number of partitions, lest they be joined for their few bytes: the search is long, not large.
    many = TASKS_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hard = rows.where(F.col("comps").isNotNull()).repartition(many, "read_id")
    easy = rows.where(F.col("comps").isNull()).drop("comps").withColumns({"cor": F.expr("substring(seq, 1, trim_len)"), "solved": F.lit(False), "edits": F.expr(f"CAST(array() AS {_FOUND['edits']})")})
    if isinstance(trusted, DataFrame):
        return searched_by_rounds(hard, trusted, k, offset, models, priors, learning).unionByName(easy)
    sent = rows.sparkSession.sparkContext.broadcast(models)
    kept = hard.drop("comps")

    def run(batches):
        known = trusted.opened(k)
        for batch in batches:
            yield _searched(batch, known, offset, sent.value, priors, learning)

    return hard.mapInArrow(run, _schema(kept, _FOUND)).unionByName(easy)


_RIGHT = np.array(dna.quality_probabilities())


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))).astype(np.int64)


def _searched(batch: pa.RecordBatch, known: search.TrustedSet, offset: int, models: Models, priors: list[float], learning: bool) -> pa.RecordBatch:
    """What a search finds for each read of a batch; one whose components are told without it needs none."""
    seq, qual, comps = (batch.column(c) for c in ("seq", "qual", "comps"))
    upto = batch.column("trim_len").to_numpy(zero_copy_only=False).astype(np.int64)
    own, (marks, begin) = windows.parsed(seq), windows.flat(qual)
    if not np.array_equal(begin, own.offset):
        raise ValueError("a read and its qualities differ in length")
    # Bases behind the trim may have any quality; they are not looked at.
    quality = np.clip(marks.astype(np.int64) - offset, 0, dna.MAX_QUALITY - 1)
    names = list(models) if isinstance(models, dict) else [None]
    stacked = np.stack([models[name] for name in names]) if isinstance(models, dict) else models[None]
    which = np.array([names.index(f) for f in batch.column("file").to_pylist()]) if isinstance(models, dict) else np.zeros(batch.num_rows, dtype=np.int64)
    reads = prefilter.Batch(own.codes, quality, _RIGHT[quality], begin, upto, which).prepared(known.k)
    sizes = pc.list_value_length(comps).to_numpy(zero_copy_only=False).astype(np.int64)
    _, starts, chopped, whole = comps.flatten().flatten()
    (starts, starts_at), (chopped, chopped_at), (whole, whole_at) = map(_lists, (starts, chopped, whole))
    read = np.repeat(np.arange(batch.num_rows), sizes)
    same = np.diff(chopped_at) == np.diff(whole_at)
    by_chopped = prefilter.judged(reads, known, stacked, priors, learning, read, starts, starts_at, chopped, chopped_at)
    told = [by_chopped.outcomes(), []]
    # Whole regions are asked about only where the chopped ones have no solution.
    told[1] = [outcome if alike else None for outcome, alike in zip(told[0], same.tolist())]
    rest = np.flatnonzero(~same & (by_chopped.code != search.SOLVED))
    if len(rest):
        lists = [(v[windows.ranges(at[rest], np.diff(at)[rest])], np.append(0, np.cumsum(np.diff(at)[rest]))) for v, at in ((starts, starts_at), (whole, whole_at))]
        for i, outcome in zip(rest.tolist(), prefilter.judged(reads, known, stacked, priors, learning, read[rest], *lists[0], *lists[1]).outcomes()):
            told[1][i] = outcome
    first = np.cumsum(sizes) - sizes
    out, texts = [], seq.to_pylist()
    for i, at in enumerate(first.tolist()):
        one, other = told[0][at], told[1][at]
        if one and other and one[0] == other[0] == search.EXHAUSTED:
            out.append((texts[i][: starts[starts_at[at]]], False, []))
            continue
        n, c = int(upto[i]), range(at, at + int(sizes[i]))
        if len(c) == 1 and one and one[0] == search.SOLVED:
            edits, keep, solved = one[1], n, True
        else:
            codes = own.codes[begin[i] : begin[i] + n].astype(np.int64)
            lists = [tuple(v[o[j] : o[j + 1]].tolist() for v, o in ((starts, starts_at), (chopped, chopped_at), (whole, whole_at))) for j in c]
            one = search.Read(codes, quality[begin[i] : begin[i] + n], reads.right[begin[i] : begin[i] + n])
            edits, keep, solved, _ = search.correct(one, lists, known, stacked[which[i]], priors, learning, told=(told[0][c.start : c.stop], told[1][c.start : c.stop]))
        used = [(p, "ACGT"[b]) for p, b in sorted(edits.items()) if p < keep]
        text = list(texts[i][:keep])
        for p, b in used:
            text[p] = b
        out.append(("".join(text), solved, [{"place": p, "base": b} for p, b in used]))
    kinds = (pa.string(), pa.bool_(), pa.list_(pa.struct([("place", pa.int32()), ("base", pa.string())])))
    kept = [name for name in batch.schema.names if name != "comps"]
    found = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *found], names=[*kept, *_FOUND])


def corrections(found: DataFrame, offset: int, *keep: str) -> DataFrame:
    """(read_id, *keep, place, q, actual, observed): an edit a row, places from 0."""
    rows = found.select("read_id", *keep, "seq", "qual", F.explode("edits").alias("e"))
    return rows.select("read_id", *keep, F.col("e.place").alias("place"), F.expr(f"ascii(substring(qual, e.place + 1, 1)) - {offset}").alias("q"), F.col("e.base").alias("actual"), F.expr("substring(seq, e.place + 1, 1)").alias("observed"))


def first_rows(rows: DataFrame, n: int, by: tuple[str, ...], *order: str) -> DataFrame:
    """The first n rows (of each group) in an order, without a task that sees a whole group.

    Each range of the first column of the order is numbered by itself, from
    where the counts of the ranges before it end.  Rows without a tie only.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(ranges, order[0]).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by, F.lit(0)).orderBy("__range")) - F.col("__n")).drop("__n")
    own = Window.partitionBy(*by, "__range").orderBy(*order)
    numbered = dealt.join(before.where(F.col("__before") < n), [*by, "__range"]).withColumn("__n", F.row_number().over(own) + F.col("__before"))
    return numbered.where(F.col("__n") <= n).drop("__n", "__range", "__before")


#: With each round of learning the reads looked at so far become this many times as many.
_GROWTH = 2


def learn(rows: DataFrame, trusted: SharedKmers | DataFrame, k: int, offset: int, priors: list[float], samples: int = error_model.SAMPLES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, q, actual, observed, n) of a strict first pass, from the first `samples` corrections by read (of each group).

    Only reads that are solved as a whole and stay long enough teach.  Reads
    are searched in rounds, by growing ranges of their ids, and a group that
    has its samples takes no part in the next round.
    """
    hard = rows.where(F.col("comps").isNotNull())
    sizes = hard.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).head()[0] or 0
    share, shares = 2 * samples / max(1, sizes), []
    while share < 1:
        shares.append(share)
        share *= _GROWTH
    # Where a range ends decides how long a round is, not what is learnt: a quantile that is about right will do.
    ends = F.percentile_approx("read_id", F.array(*map(F.lit, shares)), 10_000) if shares else F.expr("CAST(array() AS ARRAY<BIGINT>)")
    bounds = checkpointed(hard.groupBy(*by, F.lit(0).alias("__all")).agg(F.max("read_id").alias("__last"), ends.alias("__ends")))
    used, found = None, None
    for turn in range(len(shares) + 1):
        low = "0" if not turn else f"__ends[{turn - 1}]"
        high = f"__ends[{turn}]" if turn < len(shares) else "__last"
        left = bounds
        if turn:
            had = used.groupBy(*by, F.lit(0).alias("__all")).agg(F.count("*").alias("__had"))
            left = checkpointed(bounds.join(had.where(F.col("__had") >= samples), [*by, "__all"], "left_anti"))
            if left.isEmpty():
                break
        # A row a group: as many as there are files.
        ours = hard.withColumn("__all", F.lit(0)).join(F.broadcast(left), [*by, "__all"]).where(F.expr(f"read_id <= {high}" + (f" AND read_id > {low}" if turn else "")))
        found = searched(ours.select(*rows.columns), trusted, k, offset, error_model.uniform(), priors, learning=True)
        found = found.where(F.col("solved") & (F.length("cor") >= LEAST_LENGTH))
        more = checkpointed(corrections(found, offset, *by).where(F.col("observed").isin(*dna.NUCLEOTIDES)))
        used = more if used is None else used.union(more)
    return error_model.substitution_counts(first_rows(used, samples, by, "read_id", "place"), *by)


def annotated(found: DataFrame, offset: int, header: str = "header") -> DataFrame:
    """found (with a header column) as output rows: status, out_header, out_seq, out_qual.

    Kept reads get their corrected prefix, the qualities of changed bases set
    to 2, and their header the marks ` correct` and ` trim=N`; removed ones
    their original read and the mark ` error`.
    """
    changed, cut = F.size("edits") > 0, F.length("seq") - F.length("cor")
    kept = F.length("cor") >= LEAST_LENGTH
    status = F.when(~kept, "removed").when(changed & (cut > 0), "corrected_trimmed").when(changed, "corrected").when(cut > 0, "trimmed").otherwise("validated")
    mark = F.concat(F.when(changed, " correct").otherwise(""), F.when(cut > 0, F.concat(F.lit(" trim="), cut.cast("string"))).otherwise(""))
    low = F.expr(f"aggregate(edits, substring(qual, 1, length(cor)), (s, e) -> overlay(s PLACING chr({offset + 2}) FROM e.place + 1 FOR 1))")
    return found.select(
        "*", status.alias("status"), F.when(kept, F.concat(header, mark)).otherwise(F.concat(F.col(header), F.lit(" error"))).alias("out_header"),
        F.when(kept, F.col("cor")).otherwise(F.col("seq")).alias("out_seq"), F.when(kept, low).otherwise(F.col("qual")).alias("out_qual"),
    )


def run_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of the statuses: validated, corrected, trimmed, trimmed_only, removed; one row (for each group)."""
    def n(*names: str):
        return F.count(F.when(F.col("status").isin(*names), 1))

    return rows.groupBy(*by).agg(
        n("validated").alias("validated"), n("corrected", "corrected_trimmed").alias("corrected"), n("trimmed", "corrected_trimmed").alias("trimmed"),
        n("trimmed").alias("trimmed_only"), n("removed").alias("removed"),
    )


def correction_log(rows: DataFrame, offset: int, *keep: str) -> DataFrame:
    """(read_id, *keep, q, pos, new_nt, old_nt) of kept reads, pos from 1."""
    return corrections(rows.where("status != 'removed'"), offset, *keep).select("read_id", *keep, "q", (F.col("place") + 1).alias("pos"), F.col("actual").alias("new_nt"), F.col("observed").alias("old_nt"))
