"""Tables whose state is a pointer: folders of rows are only added, and a commit publishes a new list of them.

    <table>/v000003-<id>/kind=a/part-...   rows that commit 3 wrote
    <table>/_log/000003.json               folders that make up the table after commit 3

A reader takes the last pointer and reads its folders, which no later commit touches, so it sees one whole state however
many commits come meanwhile. A commit rewrites only the partitions it changes; the others stay in the list as they are.
Two writers cannot both publish the same number: the second one fails and may try again. `vacuum` removes old folders.
A plain Parquet folder without pointers reads as a table too,;
to change one, commit its rows to a table of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "_log"
_PART = "_part"


@dataclass(frozen=True)
class State:
    """Published state: number, partition columns, schema, and the version folder of every partition ('' if not partitioned)."""

    number: int
    by: tuple[str, ...]
    schema: T.StructType
    parts: dict[str, str]


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def state(spark: SparkSession, path: str) -> State | None:
    """The last published state, or None if nothing was published."""
    numbers = [n for n in _names(spark, f"{path}/{LOG}") if n.endswith(".json")]
    if not numbers:
        return None
    doc = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{LOG}/{numbers[-1]}").collect()))  # one small file
    return State(doc["number"], tuple(doc["by"]), T.StructType.fromJson(doc["schema"]), doc["parts"])


def read(spark: SparkSession, path: str, at: State | None = None) -> DataFrame:
    """The table as last published, or as `at` says."""
    found = at or state(spark, path)
    if found is None:
        return spark.read.parquet(path)
    return _rows(spark, path, found).drop(_PART)


def _rows(spark: SparkSession, path: str, at: State) -> DataFrame:
    """Rows with the partition folder they lie in as `_part`."""
    out = spark.createDataFrame([], at.schema).withColumn(_PART, F.lit(""))
    for version in sorted(set(at.parts.values())):
        root = f"{path}/{version}" if version else path
        folders = [f"{root}/{p}" if p else root for p, v in sorted(at.parts.items()) if v == version]
        d = spark.read.schema(at.schema).option("basePath", root).parquet(*folders)
        tail = "/".join([r"[^/]+"] * len(at.by))
        part = F.regexp_extract(F.col("_metadata.file_path"), f"({tail})/[^/]+$", 1) if at.by else F.lit("")
        out = out.unionByName(d.withColumn(_PART, part))
    return out


def _folders(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Partition folders of a version, `depth` levels deep."""
    found = [""]
    for _ in range(depth):
        found = [f"{p}/{n}".lstrip("/") for p in found for n in _names(spark, f"{root}/{p}") if not n.startswith(("_", "."))]
    return found


def _publish(spark: SparkSession, path: str, new: State) -> None:
    text = json.dumps({"number": new.number, "by": list(new.by), "schema": new.schema.jsonValue(), "parts": new.parts})
    fs, target = _fs(spark, f"{path}/{LOG}/{new.number:06d}.json")
    if fs.exists(target):
        raise RuntimeError(f"{path}: state {new.number} was published by another writer")
    _, draft = _fs(spark, f"{path}/{LOG}/.{new.number:06d}-{spark.sparkContext.applicationId}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, target):
        raise RuntimeError(f"{path}: state {new.number} was published by another writer")


def commit(df: DataFrame, path: str, by: Sequence[str] = (), replaced: Sequence[str] | None = None, before: State | None = None) -> State:
    """Publish a state in which the rows of `df` stand in the place of the partitions `replaced` (None: of the whole table).

    `before` is the state that `df` was made from; if another one was published meanwhile, the commit fails.
    """
    spark = df.sparkSession
    number = before.number + 1 if before else 1
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"  # of this attempt alone, so that one that fails spoils nothing
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{version}")
    kept = {p: v for p, v in before.parts.items() if p not in set(replaced)} if before and replaced is not None else {}
    new = State(number, tuple(by), df.schema, kept | {p: version for p in _folders(spark, f"{path}/{version}", len(by))})
    _publish(spark, path, new)
    return new


def change(spark: SparkSession, path: str, touched: DataFrame, keys: Sequence[str], make: Callable[[DataFrame], DataFrame], fresh: DataFrame | None = None) -> State:
    """Rewrite the partitions that hold a row whose `keys` are in `touched`, or that `fresh` rows belong to: `make(rows)` gives their new rows."""
    before = state(spark, path)
    rows = _rows(spark, path, before)
    hit = rows.join(touched.select(*keys).distinct(), list(keys), "left_semi").select(_PART)
    if fresh is not None and before.by:
        hit = hit.unionByName(rows.join(fresh.select(*before.by).distinct(), list(before.by), "left_semi").select(_PART))
    elif fresh is not None:
        hit = hit.unionByName(spark.createDataFrame([("",)], f"{_PART} string"))
    parts = sorted(r[0] for r in hit.distinct().collect())  # partitions, not rows
    if not parts and fresh is None:
        return before
    mine = rows.where(F.col(_PART).isin(parts)).drop(_PART)
    return commit(make(mine).select(*[f.name for f in before.schema.fields]), path, before.by, parts, before)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove what only states older than the last `keep` refer to; their readers must be done."""
    fs, _ = _fs(spark, path)
    logs = [n for n in _names(spark, f"{path}/{LOG}") if n.endswith(".json")]
    used: set[str] = set()
    for name in logs[-keep:]:
        doc = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{LOG}/{name}").collect()))
        used |= {f"{v}/{p}".rstrip("/") for p, v in doc["parts"].items()}
    depth = len(state(spark, path).by)
    for version in [n for n in _names(spark, path) if n.startswith("v")]:
        for part in _folders(spark, f"{path}/{version}", depth):
            if f"{version}/{part}".rstrip("/") not in used:
                fs.delete(_fs(spark, f"{path}/{version}/{part}")[1], True)
    for name in logs[:-keep]:
        fs.delete(_fs(spark, f"{path}/{LOG}/{name}")[1], False)
