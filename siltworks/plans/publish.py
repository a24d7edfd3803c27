"""Publication: each canonical content once under its path, verified, never over something else."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written


class Conflict(Exception):
    """Something else lies where a file should go, or a saved run doesn't fit."""


def _sha(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _link(temporary: str, target: str) -> None:
    """Give ``temporary`` the name ``target``, never over a file. Where links can't be made, the name is taken first and filled then."""
    try:
        os.link(temporary, target)
        return
    except FileExistsError:
        raise
    except OSError:
        pass
    handle = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL)
    try:
        with os.fdopen(handle, "wb") as out, open(temporary, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 20)
            out.flush()
            os.fsync(out.fileno())
    except BaseException:
        os.unlink(target)
        raise


def sweep(root: str) -> None:
    """Remove what writers that were killed left under temporary names."""
    for folder, _, names in os.walk(root):
        for name in names:
            if name.startswith(".part-"):
                os.unlink(os.path.join(folder, name))


def put(root: str, relative: str, payload: bytes, digest: str) -> str:
    """"written", "present" or "conflict"; safe to repeat, and for several writers at once."""
    target = os.path.join(root, *relative.split("/"))
    if os.path.lexists(target):
        return "present" if os.path.isfile(target) and not os.path.islink(target) and _sha(target) == digest else "conflict"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(payload)
            f.flush()
            os.fsync(f.fileno())
        if _sha(temporary) != digest:
            return "conflict"
        try:
            _link(temporary, target)
        except FileExistsError:  # another writer was first
            return "present" if _sha(target) == digest else "conflict"
        return "written"
    finally:
        os.unlink(temporary)


def publish(plan: DataFrame, blobs: DataFrame, root: str) -> DataFrame:
    """(canonical_path, digest, result) of every canonical row; ``root`` is a folder that all executors share."""
    wanted = plan.where("occurrence_id = canonical_occurrence_id").select("canonical_path", F.col("digest").alias("__d"))
    once = blobs.dropDuplicates(["digest"])
    joined = wanted.join(once, F.col("__d") == F.col("digest")).select("canonical_path", "digest", "payload")

    def run(batches):
        for batch in batches:
            path, digest = batch.column("canonical_path"), batch.column("digest")
            done = [put(root, path[i].as_py(), batch.column("payload")[i].as_py(), digest[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([path, digest, pa.array(done, pa.string())], ["canonical_path", "digest", "result"])

    return joined.mapInArrow(run, "canonical_path string, digest string, result string")


def published(spark: SparkSession, root: str, tasks: int) -> DataFrame:
    """(path, digest, size) of every file below ``root``, relative to it: empty ones too, which Spark's binaryFile leaves out."""

    def listed(batches):
        for batch in batches:
            for at in batch.column("path").to_pylist():
                with os.scandir(os.path.join(root, at) if at else root) as entries:
                    found = [(f"{at}/{e.name}" if at else e.name, e.is_dir(follow_symlinks=False)) for e in entries if not e.name.startswith(".part-")]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found[k : k + 10_000]], kind) for j, kind in enumerate((pa.string(), pa.bool_()))], ["path", "folder"])

    def hashed(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            full = [os.path.join(root, p) for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(map(_sha, full), pa.string()), pa.array(map(os.path.getsize, full), pa.int64())], ["path", "digest", "size"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        seen = written(level.mapInArrow(listed, "path string, folder boolean"), "listing")
        here = seen.where("not folder").select("path")
        files = here if files is None else files.unionByName(here)
        level = seen.where("folder").select("path")
        if level.isEmpty():
            return files.repartition(tasks, "path").mapInArrow(hashed, "path string, digest string, size long")
