"""Directory trees as a source: a listing that follows no link, read by the executors."""

from __future__ import annotations

import hashlib
import os
import stat
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import order_pair
from . import mail


def aliases(a: str, b: str) -> bool:
    """Whether two paths, existing or not, name one place on some system."""
    return os.path.normcase(os.path.realpath(a)).casefold() == os.path.normcase(os.path.realpath(b)).casefold()


def admit(source: str, destination: str) -> None:
    """Raise ValueError unless ``source`` is a real folder or mailbox, apart from ``destination``."""
    path = Path(source)
    if path.is_symlink() or not path.exists():
        raise ValueError("the source has to exist and not be a link")
    if not path.is_dir():
        if not path.is_file() or not mail.is_mbox(path.read_bytes()):
            raise ValueError("a source file has to be a mailbox")
    if Path(destination).is_symlink():
        raise ValueError("the destination can't be a link")
    low = lambda p: os.path.normcase(os.path.realpath(p)).casefold()
    a, b = low(source), low(destination)
    if a == b or a.startswith(b.rstrip(os.sep) + os.sep) or b.startswith(a.rstrip(os.sep) + os.sep):
        raise ValueError("source and destination can't contain each other")


def _walk(folder: str, relative: str, above: list[str]):
    try:
        with os.scandir(folder) as it:
            entries = sorted(it, key=lambda e: (*order_pair(e.name), os.fsencode(e.name)))
    except OSError:
        yield relative or ".", above, folder, "unreadable"
        return
    for e in entries:
        here = f"{relative}/{e.name}" if relative else e.name
        try:
            mode = e.stat(follow_symlinks=False).st_mode
        except OSError:
            yield here, above, e.path, "unreadable"
            continue
        if stat.S_ISDIR(mode):
            yield from _walk(e.path, here, [*above, e.name])
        else:
            yield here, above, e.path, None if stat.S_ISREG(mode) else "unsafe_entry"


def inventory(spark: SparkSession, source: str) -> DataFrame:
    """(ordinal, source_path, folders, path, reason): names alone, listed once on the driver; contents stay where they are.

    Names that aren't UTF-8 carry replacement signs; their paths are kept as bytes.
    """
    rows = [(0, os.path.basename(source), [], os.fsencode(source), None)] if os.path.isfile(source) else [(i, p, a, os.fsencode(f), r) for i, (p, a, f, r) in enumerate(_walk(source, "", []))]
    clean = lambda t: t.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    rows = [(i, clean(p), [clean(x) for x in a], f, r) for i, p, a, f, r in rows]
    return spark.createDataFrame(rows, "ordinal long, source_path string, folders array<string>, path binary, reason string")


def nodes(listing: DataFrame, files_a_task: int = 64, most: int | None = None) -> DataFrame:
    """Level-0 nodes of a listing; the executors read the files, which lie on a file system they share, unless they have over ``most`` bytes."""
    kind = "array<struct<kind:string,identifier:string,original_name:string>>"
    schema = pa.schema([("ordinal", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, reason = None, row["reason"]
                if reason is None:
                    try:
                        with open(os.open(row["path"], os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                            if most is not None and os.fstat(f.fileno()).st_size > most:
                                reason = "member_size_limit"
                            else:
                                data = f.read() if most is None else f.read(most + 1)
                                if most is not None and len(data) > most:  # it grew meanwhile
                                    data, reason = None, "member_size_limit"
                    except OSError:
                        reason = "unreadable"
                yield pa.RecordBatch.from_pylist([{"ordinal": row["ordinal"], "payload": data, "reason": reason}], schema)

    n = listing.count()
    light = listing.select("ordinal", "path", "reason").repartition(max(1, -(-n // files_a_task)), "ordinal")
    read = light.mapInArrow(load, "ordinal long, payload binary, reason string")
    rest = listing.select(F.col("ordinal").alias("o"), "source_path", "folders")
    above = F.transform("folders", lambda f: F.struct(F.lit("source_dir").alias("kind"), f.alias("identifier"), f.alias("original_name"))).cast(kind)
    joined = read.join(rest, read["ordinal"] == rest["o"])
    return joined.select(F.array("ordinal").alias("visit"), F.element_at(F.split("source_path", "/"), -1).alias("name"), "source_path", above.alias("ancestry"), "payload", "reason")


def fingerprint(spark: SparkSession, source: str) -> str:
    """SHA-256 over names, sizes and contents, each framed; unreadable files count by name and reason."""
    rows = nodes(inventory(spark, source)).select("visit", F.concat_ws("|", F.octet_length("source_path"), "source_path", F.coalesce("reason", F.lit("")), F.coalesce(F.octet_length("payload").cast("string"), F.lit("")), F.coalesce(F.sha2("payload", 256), F.lit(""))).alias("line"))
    digest = hashlib.sha256(("file" if os.path.isfile(source) else "directory").encode())
    for r in rows.orderBy("visit").select("line").toLocalIterator():
        digest.update(hashlib.sha256(r["line"].encode()).digest())
    return digest.hexdigest()
