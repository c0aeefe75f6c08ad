"""A chunk index whose documents can be replaced and deleted, in snapshots.

Below the folder of an index lie

* ``rows/change=<name>``: chunks that one change added, never rewritten;
* ``gone/change=<name>``: ids of the documents whose earlier chunks no longer count;
* ``versions/<number>.json``: what belongs to a version, in the order of the changes.

A change writes its tables first and is then made visible by one small file under the
next number, which is there in full or not at all. A reader takes the newest number and
sees the index before a change or after it, never between; a job that ends half-way
leaves tables no version names. Two writers that aim for one number cannot both get it:
the later one takes the next. Chunks are merged with the ids when they are read, and
``compact`` writes what is left anew once many changes have come together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import written
from passagework.sources.files import names, publish, read_text, remove
from passagework.sources.index_store import INDEX_SCHEMA, empty_index

MAX_BROADCAST_IDS = 1_000_000
ATTEMPTS = 20


class TickerSectionMissing(ValueError):
    """A ticker that was to be refreshed lacks one of its sections."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that can be read, oldest first."""
    found = [n for n in names(spark, f"{path.rstrip('/')}/versions") if n.endswith(".json")]
    return [int(n.removesuffix(".json")) for n in found if not n.startswith("_")]


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    elif version not in known and version != 0:
        raise ValueError(f"no version {version} in {path}")
    if version == 0:
        return 0, {"changes": [], "streams": {}}
    return version, json.loads(read_text(spark, _file(path, version)))


def _file(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/versions/{version:012d}.json"


def _commit(spark: SparkSession, path: str, change) -> int:
    """The next version: ``change`` makes its manifest from the newest one, or None."""
    for _ in range(ATTEMPTS):
        version, manifest = _manifest(spark, path, None)
        wanted = change(manifest)
        if wanted is None:
            return version
        if publish(spark, _file(path, version + 1), json.dumps(wanted)):
            return version + 1
    raise RuntimeError(f"{path}: other writers took {ATTEMPTS} versions in a row")


def _added(manifest: dict, **change) -> dict:
    return manifest | {"changes": [*manifest["changes"], change]}


def load_version(
    spark: SparkSession, path: str, model_name: str | None = None, version: int | None = None
) -> DataFrame:
    """The chunks of a version, the newest by default; none where nothing is stored."""
    _, manifest = _manifest(spark, path, version)
    live = _live(spark, path, manifest["changes"])
    return live if model_name is None else live.where(F.col("model_name") == model_name)


def _live(spark: SparkSession, path: str, changes: list[dict]) -> DataFrame:
    """Chunks without those of documents that a later change replaced or deleted."""
    added = [n for n, change in enumerate(changes) if change.get("rows")]
    if not added:
        return empty_index(spark)
    # What was gone before the first chunks came can be left out.
    gone = [n for n, change in enumerate(changes) if change.get("gone") and n > added[0]]
    chunks = _changes(spark, f"{path.rstrip('/')}/rows", changes, added, "rows", INDEX_SCHEMA)
    if gone:
        last = _changes(spark, f"{path.rstrip('/')}/gone", changes, gone, "gone", "doc_id string")
        last = last.groupBy("doc_id").agg(F.max("_number").alias("_gone"))
        if sum(changes[n]["n_gone"] for n in gone) <= MAX_BROADCAST_IDS:
            last = F.broadcast(last)
        chunks = chunks.join(last, "doc_id", "left").where(
            F.col("_gone").isNull() | (F.col("_gone") <= F.col("_number"))
        )
    return chunks.select(*empty_index(spark).columns)


def _changes(spark, folder: str, changes, numbers, kind: str, schema: str) -> DataFrame:
    """The tables of some changes as one scan, each row with the number of its change."""
    names_of = [(changes[n][kind], n) for n in numbers]
    tables = spark.read.option("basePath", folder).schema(f"{schema}, change string")
    rows = tables.parquet(*[f"{folder}/change={name}" for name, _ in names_of])
    order = spark.createDataFrame(names_of, "change string, _number int")
    return rows.join(F.broadcast(order), "change").drop("change")


def _name() -> str:
    return f"c-{uuid.uuid4().hex}"


def _write_rows(rows: DataFrame, path: str, name: str) -> None:
    fitted = rows.sparkSession.createDataFrame([], INDEX_SCHEMA).unionByName(rows)
    fitted.write.partitionBy("model_name").parquet(f"{path.rstrip('/')}/rows/change={name}")


def _write_gone(ids: DataFrame, path: str, name: str) -> int:
    """The distinct ids as a table, and their number."""
    folder = f"{path.rstrip('/')}/gone/change={name}"
    ids.select(F.col("doc_id").cast("string").alias("doc_id")).where(
        "doc_id is not null"
    ).distinct().write.parquet(folder)
    return ids.sparkSession.read.parquet(folder).count()


def put_documents(
    rows: DataFrame,
    path: str,
    also_gone: DataFrame | None = None,
    stream: tuple[str, int] | None = None,
) -> int:
    """Index rows in place of all earlier chunks of their documents; the new version.

    Documents that the index does not have are added. ``also_gone`` has a column doc_id
    of documents that go in the same step. ``stream`` names a stream and its batch: a
    batch that has been put before, by its number, changes nothing. Rows without a
    doc_id are added and cannot be replaced.
    """
    spark = rows.sparkSession
    if stream is not None:
        _, manifest = _manifest(spark, path, None)
        if manifest["streams"].get(stream[0], -1) >= stream[1]:
            return versions(spark, path)[-1]
    name = _name()
    _write_rows(rows, path, name)
    written = spark.read.schema(INDEX_SCHEMA).parquet(f"{path.rstrip('/')}/rows/change={name}")
    ids = written.select("doc_id")
    n_gone = _write_gone(ids if also_gone is None else ids.unionAll(also_gone.select("doc_id")),
                         path, name)

    def change(manifest: dict) -> dict | None:
        if stream is not None:
            if manifest["streams"].get(stream[0], -1) >= stream[1]:
                return None
            manifest = manifest | {"streams": manifest["streams"] | {stream[0]: stream[1]}}
        return _added(manifest, rows=name, gone=name, n_gone=n_gone)

    return _commit(spark, path, change)


def delete_documents(ids: DataFrame, path: str) -> int:
    """The index without the chunks of these documents (column doc_id); the new version."""
    name = _name()
    n_gone = _write_gone(ids, path, name)
    return _commit(
        ids.sparkSession, path, lambda manifest: _added(manifest, gone=name, n_gone=n_gone)
    )


def clear_versions(spark: SparkSession, path: str) -> int:
    """An empty index in one step; older versions can still be read."""
    return _commit(spark, path, lambda manifest: manifest | {"changes": []})


def compact(spark: SparkSession, path: str) -> int:
    """The chunks of the newest version as one table, so that reading merges nothing.

    Changes that others commit meanwhile stay behind the compacted ones.
    """
    version, manifest = _manifest(spark, path, None)
    done = manifest["changes"]
    if len(done) < 2:
        return version
    name = _name()
    _write_rows(_live(spark, path, done), path, name)

    def change(newest: dict) -> dict | None:
        if newest["changes"][: len(done)] != done:
            return None
        return newest | {"changes": [{"rows": name}, *newest["changes"][len(done) :]]}

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the newest ``keep`` versions and the tables only they named.

    Only to be called while no writer is at work and no older version is being read.
    Returns the number of tables removed.
    """
    root = path.rstrip("/")
    known = versions(spark, path)
    dropped, kept = known[: -max(keep, 1)], known[-max(keep, 1) :]
    named = set()
    for version in kept:
        for change in _manifest(spark, path, version)[1]["changes"]:
            named |= {f"{kind}/change={change.get(kind)}" for kind in ("rows", "gone")}
    for version in dropped:
        remove(spark, _file(path, version))
    removed = 0
    for kind in ("rows", "gone"):
        for name in names(spark, f"{root}/{kind}"):
            if f"{kind}/{name}" not in named:
                remove(spark, f"{root}/{kind}/{name}")
                removed += 1
    return removed


def refresh_tickers(
    tickers: DataFrame, profiles: DataFrame, path: str, index_rows
) -> int:
    """Fresh profiles of the wanted tickers in place of their old ones, all or nothing.

    ``tickers`` has a column ticker, ``profiles`` are documents of ``ticker_profiles``,
    which has none for a ticker without all sections; ``index_rows`` makes index rows of
    documents. If a wanted ticker has no profile, nothing changes and
    ``TickerSectionMissing`` names some. Periods that left the profile leave the index.
    """
    spark = tickers.sparkSession
    profiles = written(profiles, "profiles")  # read three times below
    wanted = written(tickers.select("ticker").distinct(), "wanted-tickers")  # these too
    have = profiles.select(F.col("metadata.ticker").alias("ticker")).distinct()
    lacking = [r[0] for r in wanted.join(have, "ticker", "left_anti").limit(5).collect()]
    if lacking:
        raise TickerSectionMissing(f"sections are missing for {', '.join(sorted(lacking))}")
    fresh = profiles.join(
        wanted.withColumnRenamed("ticker", "_ticker"),
        F.col("metadata.ticker") == F.col("_ticker"), "left_semi",
    )
    old = load_version(spark, path).select("doc_id", F.col("metadata.ticker").alias("ticker"))
    leaving = old.join(wanted, "ticker", "left_semi").select("doc_id")
    return put_documents(index_rows(fresh), path, also_gone=leaving)
