"""Versioned tables of models, dictionaries and profiles, published in one step and guarded by their parameters.

Data is written to a folder of its own first. A version exists once its manifest does, which is a small file that is created only if no
one else has created it: readers see a whole version or none, and two writers never share a number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str, name: str) -> list[int]:
    """Published versions of a table, ascending."""
    fs, path = _fs(spark, f"{base}/{name}/versions")
    if not fs.exists(path):
        return []
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))


def publish(df: DataFrame, base: str, name: str, params: dict) -> int:
    """Writes a table and publishes it as the next version; its number."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{base}/{name}/{folder}")
    manifest = json.dumps({"folder": folder, "params": params, "schema": df.schema.jsonValue()}, sort_keys=True)
    number = (versions(spark, base, name) or [0])[-1]
    while True:
        number += 1
        fs, path = _fs(spark, f"{base}/{name}/versions/{number:06d}.json")
        try:
            out = fs.create(path, False)
        except Exception:  # another writer took the number
            if not fs.exists(path):
                raise
            continue
        try:
            out.write(bytearray(manifest.encode()))
        finally:
            out.close()
        return number


def manifest(spark: SparkSession, base: str, name: str, version: int | None = None) -> dict:
    known = versions(spark, base, name)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{base}/{name} has the versions {known}, not {version}")
    number = known[-1] if version is None else version
    text = spark.read.option("wholetext", True).text(f"{base}/{name}/versions/{number:06d}.json").first()[0]
    return json.loads(text) | {"version": number}


def load(spark: SparkSession, base: str, name: str, params: dict, version: int | None = None) -> DataFrame:
    """A published table, the newest unless told; refuses one that was made with other values of ``params``."""
    from pyspark.sql.types import StructType

    found = manifest(spark, base, name, version)
    wrong = {k: found["params"].get(k) for k, v in params.items() if found["params"].get(k) != v}
    if wrong:
        raise ValueError(f"version {found['version']} of {name} was made with {wrong}, not {({k: params[k] for k in wrong})}")
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{base}/{name}/{found['folder']}")


def prune(spark: SparkSession, base: str, name: str, keep: int = 1) -> list[int]:
    """Deletes all but the newest ``keep`` versions: a manifest first, then its data; the numbers that went."""
    gone = versions(spark, base, name)[:-keep] if keep else versions(spark, base, name)
    for number in gone:
        folder = manifest(spark, base, name, number)["folder"]
        for path in (f"{base}/{name}/versions/{number:06d}.json", f"{base}/{name}/{folder}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    return gone
