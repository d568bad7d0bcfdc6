"""Document versions as an append-only table.

Columns: document_id, version_number, created_at, created_by, change_summary,
content, metadata. History and comparison stay rows: a document with very many
versions is never gathered into one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.functions.ranks import bucketed_row_number, hot_keys, skew_join

KEY = "document_id"


def with_hashes(versions: DataFrame) -> DataFrame:
    """Add content_hash and file_size_bytes."""
    text = F.col("content").cast("binary")
    return versions.withColumn("content_hash", F.sha2(text, 256)).withColumn(
        "file_size_bytes", F.octet_length("content").cast("long")
    )


def latest(versions: DataFrame) -> DataFrame:
    """Newest version per document (G8); versions combine before the shuffle."""
    rest = [c for c in versions.columns if c != KEY]
    return versions.groupBy(KEY).agg(F.max_by(F.struct(*rest), "version_number").alias("v")).select(KEY, "v.*")


def _current(versions: DataFrame) -> DataFrame:
    return versions.groupBy(KEY).agg(F.max("version_number").alias("current_version"))


def _in_order(requests: DataFrame, sequence: str | None) -> DataFrame:
    """Add ``_seq``: the order of requests, by ``sequence`` or else by a hash of the whole row."""
    order = F.col(sequence).cast("long") if sequence else _row_hash(requests)
    return requests.withColumn("_seq", order)


def _row_hash(rows: DataFrame) -> Column:
    """Hash of all columns; maps count as their sorted entries."""
    maps = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.MapType)}
    return F.xxhash64(*(F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in rows.columns))


def _numbered(requests: DataFrame, by_hash: bool) -> DataFrame:
    """Add ``_nth``: the number of a request among those of its document."""
    # the bucket must not decrease along the order; it only bounds what one task ranks
    bucket = F.shiftright("_seq", 54 if by_hash else 10)
    return bucketed_row_number(requests, [KEY], bucket, [F.col("_seq").asc(), _row_hash(requests).asc()], "_nth")


def create(versions: DataFrame, requests: DataFrame, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """First versions of new documents, and conflicts (G1).

    A request conflicts when its document exists, or an earlier request of the same
    batch creates it. ``sequence`` names the column of request order.
    """
    existing = versions.select(KEY).distinct()
    fresh = _numbered(_in_order(requests.join(existing, KEY, "left_anti"), sequence), sequence is None).drop("_seq")
    first = fresh.where("_nth = 1").drop("_nth").withColumn("version_number", F.lit(1).cast("long"))
    late = fresh.where("_nth > 1").drop("_nth")
    return with_hashes(first), requests.join(existing, KEY, "left_semi").unionByName(late)


def merge_metadata(old: Column, new: Column) -> Column:
    """Map union where the new value wins."""
    kept = F.map_filter(old, lambda k, _v: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def _merged(old: list | None, new: list | None) -> list | None:
    if old is None or new is None:
        return old if new is None else new
    return list({**dict(old), **dict(new)}.items())


def _apply_updates(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Walk the sorted requests; only the document at hand is remembered."""
    key, version, metadata = None, None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (KEY, "expected_version", "current_version", "metadata", "_old")]
        out: list[tuple[str, int | None, list | None]] = []
        for doc, expected, current, new, old in zip(*columns):
            if doc != key:
                key, version, metadata = doc, current, old
            if version is None:
                out.append(("not_found", None, None))
            elif expected is not None and expected != version:
                out.append(("conflict", None, None))
            else:
                version, metadata = version + 1, _merged(metadata, new)
                out.append(("updated", version, metadata))
        done = dict(zip(("status", "version_number", "metadata"), map(list, zip(*out)))) if out else {}
        arrays = [
            pa.array(done.get(f.name, []), f.type) if f.name in ("status", "version_number", "metadata") else batch.column(f.name).cast(f.type)
            for f in schema
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def update(versions: DataFrame, requests: DataFrame, sequence: str | None = None) -> DataFrame:
    """Next versions with a ``status``: updated, conflict or not_found.

    ``requests(document_id, content, metadata, expected_version, ...)``; a null
    expected version is not checked. Requests of one document take effect one after
    the other in the order of ``sequence``: each sees the version and metadata that
    the one before it left. Only accepted requests have a version, metadata and hash.
    """
    current = latest(versions.select(KEY, "version_number", "metadata")).select(
        KEY, F.col("version_number").alias("current_version"), F.col("metadata").alias("_old")
    )
    joined = _in_order(requests, sequence).join(current, KEY, "left")
    ordered = joined.withColumn("_tie", _row_hash(requests)).repartition(KEY).sortWithinPartitions(KEY, "_seq", "_tie")
    hidden = ("_seq", "_old", "_tie", "version_number", "status")
    fields = [T.StructField(f.name, f.dataType) for f in joined.schema.fields if f.name not in hidden]
    out = T.StructType([*fields, T.StructField("status", T.StringType()), T.StructField("version_number", T.LongType())])
    arrow = to_arrow_schema(out)
    done = with_hashes(ordered.mapInArrow(lambda it: _apply_updates(it, arrow), out))
    ok = F.col("status") == "updated"
    return done.withColumn("content_hash", F.when(ok, F.col("content_hash"))).withColumn(
        "file_size_bytes", F.when(ok, F.col("file_size_bytes"))
    )


def rollback(versions: DataFrame, requests: DataFrame, sequence: str | None = None) -> DataFrame:
    """New versions with the content of an older one; history stays.

    ``requests(document_id, target_version, rolled_back_by, change_summary)``. The target
    is one of the stored versions; several accepted requests of one document get
    consecutive numbers in the order of ``sequence``.
    """
    target = versions.select(
        KEY, F.col("version_number").alias("target_version"), "content", "metadata", F.lit(True).alias("_found")
    )
    joined = _in_order(requests, sequence).join(_current(versions), KEY, "left").join(target, [KEY, "target_version"], "left")
    joined = joined.withColumn("_ok", F.coalesce(F.col("_found"), F.lit(False)) & (F.col("target_version") >= 1)).drop("_found")
    summary = F.coalesce(F.col("change_summary"), F.format_string("Rolled back to version %d", "target_version"))
    bucket = F.shiftright("_seq", 10 if sequence else 54)
    order = [F.col("_seq").asc(), F.col("target_version").asc()]
    good = bucketed_row_number(joined.where("_ok"), [KEY], bucket, order, "_nth")
    bad = joined.where("NOT _ok").withColumn("_nth", F.lit(None).cast("long"))
    return with_hashes(
        good.unionByName(bad)
        .withColumn("status", F.when(F.col("_ok"), "rolled_back").otherwise("not_found"))
        .withColumn("version_number", F.col("current_version") + F.col("_nth"))
        .withColumn("change_summary", F.when(F.col("_ok"), summary))
        .drop("_ok", "_nth", "_seq")
    )


def history(versions: DataFrame, include_content: bool = False) -> DataFrame:
    """Every version next to current and total numbers of its document."""
    totals = versions.groupBy(KEY).agg(
        F.max("version_number").alias("current_version"), F.count(F.lit(1)).alias("total_versions")
    )
    rows = with_hashes(versions)
    rows = rows if include_content else rows.drop("content")
    return skew_join(rows, totals, [KEY], ["version_number"], hot_keys(totals, [KEY], "total_versions"))


def get_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (document_id, version_number) pairs of ``wanted``."""
    return with_hashes(versions.join(wanted, [KEY, "version_number"], "left_semi"))


def compare(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare ``pairs(document_id, version1, version2)`` by hash and size."""
    info = with_hashes(versions).select(KEY, "version_number", "content_hash", "file_size_bytes", "created_by")

    def side(n: int) -> DataFrame:
        return info.select(
            KEY,
            F.col("version_number").alias(f"version{n}"),
            F.col("content_hash").alias(f"hash{n}"),
            F.col("file_size_bytes").alias(f"size{n}"),
            F.col("created_by").alias(f"created_by{n}"),
        )

    valid = pairs.where((F.col("version1") >= 1) & (F.col("version2") >= 1))
    both = valid.join(side(1), [KEY, "version1"]).join(side(2), [KEY, "version2"])
    return both.select(
        KEY,
        "version1",
        "version2",
        (F.col("hash1") == F.col("hash2")).alias("content_same"),
        (F.col("size2") - F.col("size1")).alias("size_difference_bytes"),
        "created_by1",
        "created_by2",
    )


def delete_documents(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop all versions of the given documents."""
    return versions.join(ids.select(KEY), KEY, "left_anti")


def stats(versions: DataFrame) -> DataFrame:
    """Documents, versions, bytes, contributors, versions per document."""
    per_pair = versions.groupBy(KEY, "created_by").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("content")).alias("_bytes")
    )
    per_doc = per_pair.groupBy(KEY).agg(F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    contributors = per_pair.select("created_by").distinct().agg(F.count(F.lit(1)).alias("n"))
    return per_doc.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_versions"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).cast("long").alias("total_storage_bytes"),
    ).select(
        "*",
        F.round(F.col("total_storage_bytes") / (1024.0 * 1024.0), 6).alias("total_storage_mb"),
        contributors.scalar().alias("unique_contributors"),
        F.when(
            F.col("total_documents") > 0, F.round(F.col("total_versions") / F.col("total_documents"), 6)
        )
        .otherwise(F.lit(0.0))
        .alias("average_versions_per_document"),
    )
