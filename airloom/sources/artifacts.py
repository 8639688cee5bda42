"""Versioned snapshots, run outputs and file manifests."""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.session import materialized, path_exists, scratch_path


def write_snapshot(df: DataFrame, root: str, name: str, version: str) -> str:
    """Versioned Parquet snapshot partitioned by split; an existing version is never overwritten."""
    path = f"{root.rstrip('/')}/{name}/version={version}"
    df.write.mode("errorifexists").partitionBy("split").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, name: str, version: str, split: str | None = None) -> DataFrame:
    """A snapshot or one of its splits (partition pruning)."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}/version={version}")
    return df if split is None else df.filter(F.col("split") == split)


def write_run(outputs: Mapping[str, DataFrame], root: str, run_id: str, csv: Sequence[str] = ()) -> str:
    """Outputs of one run as Parquet, the named ones also as CSV; a run id is written once."""
    path = f"{root.rstrip('/')}/run_id={run_id}"
    for name, df in outputs.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
        if name in csv:
            df.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}.csv")
    return path


_TABLES = "tables array<struct<name:string,path:string,format:string,row_count:bigint,columns:array<string>>>"
_COMMIT = f"run_id string, attempt string, created_at timestamp, metadata string, {_TABLES}"
_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def commit_run(
    outputs: Mapping[str, DataFrame], root: str, run_id: str, metadata: Mapping[str, object], csv: Sequence[str] = ()
) -> str:
    """All tables of one run, visible together or not at all.

    Every attempt writes its tables (forecast, inputs, feature matrix, ...) below a folder of its own; the manifest with
    paths, row counts, columns and the metadata as JSON is written last, and only its completed write makes the run
    exist. A job lost between two tables leaves an attempt that no reader sees, and the run may be written again; a run
    that exists is never overwritten. One job at a time writes a run. Counts come from the written files, so outputs
    are derived once. Tables named in `csv` are kept as CSV too, from the same files. Returns the attempt's folder.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, '.', '_' and '-', led by a letter or digit")
    if not outputs or set(csv) - set(outputs):
        raise ValueError("a run needs outputs, and CSV copies can only be of them")
    spark = next(iter(outputs.values())).sparkSession
    commit = f"{root.rstrip('/')}/commits/run_id={run_id}"
    if path_exists(spark, f"{commit}/_SUCCESS"):
        raise FileExistsError(f"run {run_id} exists")
    attempt = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/attempts/run_id={run_id}/{attempt}"
    tables = []
    for name, df in outputs.items():
        place = f"{path}/{name}.parquet"
        df.write.mode("errorifexists").parquet(place)
        stored = spark.read.schema(df.schema).parquet(place)
        n = stored.count()
        tables.append((name, place, "parquet", n, df.columns))
        if name in csv:
            stored.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}.csv")
            tables.append((name, f"{path}/{name}.csv", "csv", n, df.columns))
    facts = json.dumps(dict(metadata), sort_keys=True, default=str)
    row = spark.createDataFrame([(attempt, facts, tables)], f"attempt string, metadata string, {_TABLES}")
    # Unfinished manifests of a lost job have no success mark and are replaced.
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(commit)
    return path


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed run: id, attempt, time, metadata (JSON) and its tables; none where nothing was committed."""
    commits = f"{root.rstrip('/')}/commits"
    if not path_exists(spark, commits):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(commits).select("run_id", "attempt", "created_at", "metadata", "tables")


def read_run(spark: SparkSession, root: str, run_id: str, name: str, kind: str = "parquet") -> DataFrame:
    """One table of a committed run; an unknown or uncommitted run is an error."""
    commit = f"{root.rstrip('/')}/commits/run_id={run_id}"
    found = None
    if _RUN_ID.fullmatch(run_id) and path_exists(spark, f"{commit}/_SUCCESS"):
        tables = spark.read.schema(_TABLES).json(commit).select(F.inline("tables"))
        found = tables.filter((F.col("name") == name) & (F.col("format") == kind)).first()
    if found is None:
        raise FileNotFoundError(f"no committed {kind} table {name} of run {run_id}")
    return spark.read.option("header", True).format(kind).load(found["path"])


BLOCK_BYTES = 128 << 20  # larger files are hashed in blocks of about this size
_UNPACKED = r"(?i)\.(deflate|gz|gzip|bz2|lz4|lzo|snappy|xz|zst|zstd)$"  # what Spark's readers of lines unpack
_STATES = "path string, length long, lead binary, n long, state binary"
Batches = Iterator[pa.RecordBatch]


@cache
def _crypto() -> ctypes.CDLL | None:
    """The library behind `hashlib`, whose SHA-256 can be left half done and taken up elsewhere; None where it does not offer that."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        probe = _Sha256(None, library)
        probe.feed(b"a")
        probe = _Sha256(probe.state, library)
        probe.feed(b"b" * 99)
        return library if probe.hexdigest() == hashlib.sha256(b"a" + b"b" * 99).hexdigest() else None
    except (ImportError, AttributeError, OSError):
        return None


class _Sha256:
    """SHA-256 that goes on from a state and gives it back: OpenSSL's SHA256_CTX, 28 words without pointers."""

    SIZE = 112

    def __init__(self, state: bytes | None, library: ctypes.CDLL | None = None):
        self._library, self._held = library or _crypto(), ctypes.create_string_buffer(self.SIZE)
        if state is None:
            self._library.SHA256_Init(self._held)
        else:
            self._held.raw = state

    def feed(self, content: bytes) -> None:
        self._library.SHA256_Update(self._held, content, ctypes.c_size_t(len(content)))

    @property
    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, self._held)
        return out.raw.hex()


def _chunks(batches: Batches) -> Batches:
    """Rows (path, start, part, content) from the lines (path, start, line) of blocks, in order, each line with its end: a row a block and batch."""
    key, part = None, 0
    for batch in batches:
        paths, starts, lines = batch.columns
        new = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(starts[1:], starts[:-1]))
        bounds = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            found = (paths[a].as_py(), starts[a].as_py())
            key, part = found, (part + 1 if found == key else 0)
            content = b"\n".join([*lines[a:b].to_pylist(), b""])
            yield pa.RecordBatch.from_pydict({"path": [key[0]], "start": [key[1]], "part": pa.array([part], pa.int32()), "content": [content]})


def _advance(batches: Batches) -> Batches:
    """States (path, length, lead, n, state) after the chunks of a step: rows of a state and a chunk, in order by file."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("lead", pa.binary()), ("n", pa.int64()), ("state", pa.binary())])

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*file, n, digest.state), schema)], schema=schema)

    file, n, digest = None, 0, None
    for batch in batches:
        for path, length, lead, before, state, content in zip(*(c.to_pylist() for c in batch.columns)):
            if file is None or path != file[0]:
                if file is not None:
                    yield row()
                file, n, digest = (path, length, lead), before, _Sha256(state)
                if state is None and lead:
                    digest.feed(lead)
                    n += len(lead)
            content = content[: length - n]  # the last line may have had no end
            digest.feed(content)
            n += len(content)
    if file is not None:
        yield row()


def _finish(batches: Batches) -> Batches:
    for batch in batches:
        paths, lengths, _, done, states = (c.to_pylist() for c in batch.columns)
        for path, length, n in zip(paths, lengths, done):
            if n != length:
                raise ValueError(f"{path}: {n} of {length} bytes were read; the file changed")
        yield pa.RecordBatch.from_pydict({"path": paths, "length": pa.array(lengths, pa.int64()), "sha256": [_Sha256(s).hexdigest() for s in states]})


def _chained(lines: DataFrame, files: DataFrame, steps: int, block: int) -> DataFrame:
    """Rows (path, length, sha256) of the files (path, length), whose lines are given as (path, start of their block, line).

    The blocks are kept in the shared folder in chunks, by step. A step hashes the next `block` bytes of every file, each
    file in one task, which begins with the state that the step before has left.
    """
    spark = lines.sparkSession
    where = scratch_path(spark, "chunks")
    chunks = lines.mapInArrow(_chunks, "path string, start long, part int, content binary").withColumn("step", F.expr(f"cast(start div {block} as int)"))
    chunks.write.partitionBy("step").option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(where)
    chunks = spark.read.schema("path string, start long, part int, content binary, step int").parquet(where)
    # Spark's readers of lines drop a byte order mark; nothing else is shorter than the file.
    met = materialized(chunks.select("path", F.length("content").alias("size")).groupBy("path").agg(F.sum("size").alias("size")), "met")
    lead = F.when(F.col("size") < F.col("length"), F.unhex(F.lit("EFBBBF")))
    states = files.join(met, "path", "left").select("path", "length", lead.alias("lead"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("state"))
    states = materialized(states, "states")
    for step in range(steps):
        now = chunks.filter(F.col("step") == step).join(states, "path").repartition("path").sortWithinPartitions("path", "start", "part")
        after = now.select("path", "length", "lead", "n", "state", "content").mapInArrow(_advance, _STATES)
        after = materialized(after, "advanced")
        states = materialized(states.join(after.select("path"), "path", "left_anti").unionByName(after), "states")
    return states.select("path", "length", "lead", "n", "state").mapInArrow(_finish, "path string, length long, sha256 string")


def artifact_manifest(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per file: path relative to the root, size and SHA-256. Files are hashed where they are read.

    A file of up to `block` bytes is one value. A larger one is cut at its line ends, wherever they are, into blocks that
    tasks read side by side, and its checksum, a chain over all bytes, goes from task to task as a state of 112 bytes. No
    task reads much more than `block` and one of Spark's file partitions, unless a line is longer. Whole in one task stay
    large files with the names of packed ones (Spark would unpack them), and all where OpenSSL does not hand out the state.
    """
    def source(kind: str):
        return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")

    root = path.rstrip("/") + "/"
    relative = F.substring_index("path", root, -1).alias("relative_path")
    files = source("binaryFile").load(path)
    name = F.col("_metadata.file_path")
    cut = (F.col("length") > block) & ~name.rlike(_UNPACKED)
    largest = files.filter(cut).agg(F.max("length")).first()[0] if _crypto() else None
    manifest = (relative, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    if largest is None:
        return files.select(*manifest)
    # Tests that Spark applies before it reads a file.
    out = files.filter(F.col("length") <= block).select(*manifest)
    out = out.unionByName(files.filter(F.col("length") > block).filter(name.rlike(_UNPACKED)).select(*manifest))
    large = files.filter(cut).select(name.alias("file"), F.col("length").alias("size_bytes"), relative)
    lines = source("text").option("lineSep", "\n").load(path).filter((F.col("_metadata.file_size") > block) & ~name.rlike(_UNPACKED))
    lines = lines.select(name.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    found = _chained(lines, large.select(F.col("file").alias("path"), F.col("size_bytes").alias("length")), -(-largest // block), block)
    return out.unionByName(large.join(found, F.col("file") == F.col("path")).select("relative_path", "size_bytes", "sha256"))


def manifest_from(df: DataFrame, name: Column, content: Column) -> DataFrame:
    """The same manifest over a table of (name, content) rows."""
    return df.select(
        name.alias("relative_path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.sha2(content.cast("binary"), 256).alias("sha256"),
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, corrupt, unexpected and good files by one full outer join on the path."""
    e = expected.select("relative_path", F.struct("size_bytes", "sha256").alias("_e"))
    a = actual.select("relative_path", F.struct("size_bytes", "sha256").alias("_a"))
    return e.join(a, "relative_path", "full").select(
        "relative_path",
        F.col("_e.size_bytes").alias("expected_size"),
        F.col("_a.size_bytes").alias("actual_size"),
        F.when(F.col("_a").isNull(), F.lit("MISSING"))
        .when(F.col("_e").isNull(), F.lit("UNEXPECTED"))
        .when(F.col("_e.size_bytes") != F.col("_a.size_bytes"), F.lit("SIZE_MISMATCH"))
        .when(F.col("_e.sha256") != F.col("_a.sha256"), F.lit("CHECKSUM_MISMATCH"))
        .otherwise(F.lit("OK"))
        .alias("status"),
    )


def latest_run(
    manifest: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ("created_at", "run_id"), approved: Sequence[str] = ("APPROVED",)
) -> DataFrame:
    """Newest approved run per artefact type."""
    rest = [c for c in manifest.columns if c not in keys]
    order = F.struct(*order_by)
    best = manifest.filter(F.col("status").isin(list(approved))).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_r")
    )
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
