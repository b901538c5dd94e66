"""Keyed tables in a folder: rows are replaced key by key, everything else stays, and a reader sees one version as a whole.

Rows lie in buckets by hash of their key. An upsert writes the buckets that it touches anew, beside the old ones, and then a manifest with the next number, which
says where each bucket is. Files are never changed, so a table that is being read can be written in the same job; of two writers that finish
with the same number the second begins again from what the first left. ``vacuum`` deletes what no recent manifest names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.shared import work_path

BUCKETS, ATTEMPTS = 64, 8
_AT = "_bucket"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_names(spark, f"{path}/manifest"))


def _manifest(spark: SparkSession, path: str, name: str) -> dict | None:
    fs, p = _fs(spark, f"{path}/manifest/{name}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:  # still being written
        return None
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: number, key, buckets, format, schema, folders by bucket."""
    for name in reversed(_names(spark, f"{path}/manifest")):
        if found := _manifest(spark, path, name):
            return found
    return None


def _commit(spark: SparkSession, path: str, state: dict) -> bool:
    """Write a manifest unless its number is taken."""
    fs, p = _fs(spark, f"{path}/manifest/{state['number']:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as problem:
        if "FileAlreadyExists" not in str(problem):
            raise
        return False
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    return True


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def folders_of(path: str, state: dict, buckets: list[int] | None = None) -> list[str]:
    return [f"{path}/{f}" for b, f in state["folders"].items() if buckets is None or int(b) in buckets]


def _load(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    folders = folders_of(path, state, buckets)
    return spark.read.schema(schema).format(state["format"]).load(folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, **key: object) -> DataFrame:
    """The table, or the rows of one key: only its bucket is read."""
    state = latest(spark, path)
    if state is None:
        raise FileNotFoundError(path)
    if set(key) != set(state["key"]):
        rows = _load(spark, path, state)
    else:
        types = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(state["schema"]))}
        one = spark.range(1).select(*(F.lit(key[k]).cast(types[k]).alias(k) for k in state["key"]))
        rows = _load(spark, path, state, [one.select(_bucket(state["key"], state["buckets"])).first()[0]])
    return rows.filter(reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()), F.lit(True)))


def matching(keys: DataFrame, path: str) -> DataFrame | None:
    """Stored rows whose key is among ``keys`` (which has the key's columns); only their buckets are read. None if nothing was ever stored."""
    spark = keys.sparkSession
    state = latest(spark, path)
    if state is None:
        return None
    touched = [r[0] for r in keys.select(_bucket(state["key"], state["buckets"]).alias(_AT)).distinct().collect()]  # at most ``buckets``
    wanted = keys.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(state["key"]))).distinct()
    return _load(spark, path, state, touched).join(wanted, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(state["key"]))), "left_semi")


def upsert(rows: DataFrame, path: str, key: list[str], stays: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, form: str = "parquet") -> None:
    """Rows replace those stored under their keys. ``stays`` (stored rows of these keys, new rows) gives stored rows that are kept all the same."""
    spark = rows.sparkSession
    staged = work_path(spark, "upsert")
    rows.write.parquet(staged)
    new = spark.read.schema(rows.schema).parquet(staged)
    names = [f"_k{k}" for k in range(len(key))]
    touched_keys = new.select(*(F.col(k).alias(n) for k, n in zip(key, names))).distinct()
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names)))
    for _ in range(ATTEMPTS):
        number = 1 + max((int(n.split(".")[0]) for n in _names(spark, f"{path}/manifest")), default=0)
        state = latest(spark, path) or {"key": key, "buckets": buckets, "format": form, "folders": {}}
        if state["key"] != key:
            raise ValueError(f"{path} is keyed by {state['key']}")
        at = _bucket(key, state["buckets"])
        touched = [r[0] for r in new.select(at.alias(_AT)).distinct().orderBy(_AT).collect()]  # at most ``buckets``
        whole = new
        if "schema" in state:
            before = _load(spark, path, state, touched)
            whole = before.join(touched_keys, same, "left_anti").unionByName(new, allowMissingColumns=True)
            if stays:
                whole = whole.unionByName(stays(before.join(touched_keys, same, "left_semi"), new), allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            laid = whole.withColumn(_AT, at).hint("rebalance", _AT)
            laid.write.partitionBy(_AT).format(state["format"]).option("ignoreNullFields", False).save(f"{path}/{folder}")
        after = state | {"number": number, "schema": whole.schema.json(), "folders": state["folders"] | {str(b): f"{folder}/{_AT}={b}" for b in touched}}
        if _commit(spark, path, after):
            delete(spark, staged)
            return
        delete(spark, f"{path}/{folder}")
    raise RuntimeError(f"{path} is written by too many others at once")


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> None:
    """Delete manifests but the newest ``versions`` and the data that they alone name."""
    names = _names(spark, f"{path}/manifest")
    recent = [m for n in names[-versions:] if (m := _manifest(spark, path, n))]
    used = {f.split("/")[1] for m in recent for f in m["folders"].values()}
    for name in names[:-versions]:
        delete(spark, f"{path}/manifest/{name}")
    for name in _names(spark, f"{path}/data"):
        if name not in used:
            delete(spark, f"{path}/data/{name}")
