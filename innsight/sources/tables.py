"""Reading listings, writing and reading the run tables, and the document table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.fixed_values import ERROR_MESSAGE_CHARS
from innsight.functions import text as tx
from innsight.operators.documents import latest_versions
from innsight.operators.report import capped_evidence
from innsight.sources.shared import stored

RUN_COLUMNS = [
    "run_id string", "run_utc_ts timestamp", "property_id string", "status string",
    "neighbors_selected_count bigint", "target_distinct_sentences_used bigint",
    "neighbors_distinct_sentences_used bigint", "payload_json string", "error_message string",
]
NEIGHBOR_COLUMNS = [
    "run_id string", "run_utc_ts timestamp", "property_id string", "neighbor_property_id string",
    "similarity double",
]
TOPIC_COLUMNS = [
    "run_id string", "run_utc_ts timestamp", "property_id string", "kind string", "topic string",
    "negative_rate_gap double", "target_negative_rate double", "neighbors_negative_rate double",
    "target_sentence_topic_assignments bigint", "neighbors_sentence_topic_assignments bigint",
]
EVIDENCE_COLUMNS = [
    "run_id string", "run_utc_ts timestamp", "property_id string", "kind string", "topic string",
    "evidence_role string", "evidence_property_id string", "review_idx int", "sent_idx int",
    "sentence_id string", "topic_similarity double", "sentiment_label string", "sentence_text string",
]
RUN_TABLES = {
    "runs": RUN_COLUMNS, "neighbors": NEIGHBOR_COLUMNS, "topics": TOPIC_COLUMNS, "evidence": EVIDENCE_COLUMNS,
}
_DATE, _ATTEMPT, _COMPLETE = "run_date", "attempt", "complete"
#: Folders that a namespace of the document table is cut into by a hash of the id, and tasks that may write one.
BUCKETS, WRITERS = 32, 2


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in any format the session knows; a schema spares the inference."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, by a unique key, when a scan gives fewer tasks than there are cores.

    Meant ahead of expensive work per row on a few files; a scan of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows per source, counted in one job."""
    counts = [df.agg(F.count("*").alias("rows")).withColumn("source", F.lit(name)) for name, df in sources.items()]
    total = counts[0]
    for count in counts[1:]:
        total = total.unionByName(count)
    return total.select("source", "rows")


def _shaped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table's columns in its order and types; absent ones become null."""
    out = []
    for column in columns:
        name, kind = column.split(" ")
        value = F.col(name) if name in df.columns else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def append_run(
    base: str, run_id: str, frames: dict[str, DataFrame], run_ts=None, fmt: str = "parquet"
) -> dict[str, str]:
    """Append the frames of one run to the tables ``runs``, ``neighbors``, ``topics``, ``evidence``.

    The frames are written as they are computed; nothing passes through the driver. Rows carry
    the attempt that wrote them, and a marker is written when all tables stand: readers see
    marked attempts only, so a run that fails midway is invisible and can be repeated. A run id
    that is marked already adds nothing. Tables are split by the day of the run and sorted by
    property, with filters on property and run that let readers skip row groups.
    """
    spark = next(iter(frames.values())).sparkSession
    paths = {name: f"{base.rstrip('/')}/{name}" for name in frames}
    if complete_runs(spark, base, fmt).where(F.col("run_id") == run_id).limit(1).count():
        return paths
    attempt = str(uuid.uuid4())
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    for name, frame in frames.items():
        if name == "evidence":
            frame = capped_evidence(frame)
        stamped = frame.withColumn("run_id", F.lit(run_id)).withColumn("run_utc_ts", stamp)
        table = _shaped(stamped, RUN_TABLES[name]).withColumns({_ATTEMPT: F.lit(attempt), _DATE: F.to_date("run_utc_ts")})
        writer = table.repartitionByRange("property_id").sortWithinPartitions("property_id").write.format(fmt)
        for column in ("property_id", "run_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.mode("append").partitionBy(_DATE).save(paths[name])
    marker = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias(_ATTEMPT), F.current_timestamp().alias("done"))
    marker.write.format(fmt).mode("append").save(f"{base.rstrip('/')}/{_COMPLETE}")
    return paths


def complete_runs(spark: SparkSession, base: str, fmt: str = "parquet") -> DataFrame:
    """``(run_id, attempt)`` of the runs that stand; of several attempts the one done first."""
    path = f"{base.rstrip('/')}/{_COMPLETE}"
    if not table_exists(spark, path):
        return spark.createDataFrame([], f"run_id string, {_ATTEMPT} string")
    done = read_table(spark, path, fmt, f"run_id string, {_ATTEMPT} string, done timestamp")
    return done.groupBy("run_id").agg(F.min_by(_ATTEMPT, F.struct("done", _ATTEMPT)).alias(_ATTEMPT))


def error_run(spark: SparkSession, property_ids: Sequence[str], message: str) -> DataFrame:
    """The rows a failed run leaves in ``runs``, one per requested property."""
    rows = spark.createDataFrame([(p, message) for p in property_ids], "property_id string, error_message string")
    return rows.withColumn("status", F.lit("error")).withColumn(
        "error_message", tx.cap(F.col("error_message"), ERROR_MESSAGE_CHARS)
    )


def new_run_id() -> str:
    return str(uuid.uuid4())


def read_run_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """The rows of a table's complete runs."""
    schema = ", ".join([*RUN_TABLES[name], f"{_ATTEMPT} string", f"{_DATE} date"])
    rows = read_table(spark, f"{base.rstrip('/')}/{name}", fmt, schema)
    return rows.join(complete_runs(spark, base, fmt), ["run_id", _ATTEMPT], "left_semi").drop(_ATTEMPT)


def latest_runs(df: DataFrame, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    """Rows of the latest run of each property.

    The latest run is found from one (time, id) pair per property, and the rows are joined
    with that; a property's rows are never ordered.
    """
    latest = df.groupBy(*keys).agg(F.max(F.struct("run_utc_ts", "run_id")).alias("_run"))
    marked = latest.select(*keys, F.col("_run.run_id").alias("run_id"))
    return df.join(marked, [*keys, "run_id"], "left_semi")


def _selected(df: DataFrame, run_id: str | None, property_id: str | None, newest: int, latest: bool) -> DataFrame:
    if run_id:
        df = df.filter(F.col("run_id") == run_id)
    if property_id:
        df = df.filter(F.col("property_id") == property_id)
        if latest and not run_id:
            df = latest_runs(df)
    if not run_id and not property_id:
        ties = [c for c in ("property_id", "kind", "topic", "neighbor_property_id") if c in df.columns]
        df = df.orderBy(F.desc("run_utc_ts"), *ties).limit(newest)
    return df


def read_neighbours(spark, base: str, run_id: str | None = None, property_id: str | None = None,
                    newest: int = 50, latest: bool = True, fmt: str = "parquet") -> DataFrame:
    """Neighbours by run or property, or the newest rows without either."""
    return _selected(read_run_table(spark, base, "neighbors", fmt), run_id, property_id, newest, latest)


def read_topics(spark, base: str, run_id: str | None = None, property_id: str | None = None,
                kind: str | None = None, newest: int = 20, latest: bool = True, fmt: str = "parquet") -> DataFrame:
    """Topics by run or property and kind, or the newest rows."""
    df = read_run_table(spark, base, "topics", fmt)
    if kind:
        df = df.filter(F.col("kind") == kind)
    return _selected(df, run_id, property_id, newest, latest)


def read_evidence(spark, base: str, run_id: str | None = None, topic: str | None = None,
                  property_id: str | None = None, limit: int = 10, fmt: str = "parquet") -> DataFrame:
    """The best evidence by run, topic and property."""
    df = read_run_table(spark, base, "evidence", fmt)
    for name, value in (("run_id", run_id), ("topic", topic), ("property_id", property_id)):
        if value:
            df = df.filter(F.col(name) == value)
    return df.orderBy(F.desc("topic_similarity"), "sentence_id", "kind", "evidence_role", "property_id").limit(limit)


def _bucket_column(buckets: int) -> str:
    """The count is part of the name: a table cut otherwise is refused instead of mixed."""
    return f"bucket_of_{buckets}"


def read_documents(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The document table, its namespace as text, without the folder of the row."""
    return spark.read.parquet(path).drop(_bucket_column(buckets)).withColumn("namespace", F.col("namespace").cast("string"))


def _meeting(rows: DataFrame, incoming: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``rows`` with ``_meets``: false only where no incoming document has the namespace and id.

    It is read from a table of ``bits`` bits, whose broadcast is bounded however many documents
    come in; some rows are marked without a need.
    """
    place = F.pmod(F.xxhash64("namespace", "doc_id"), F.lit(bits))
    words = (
        incoming.select(place.alias("_place"))
        .groupBy(F.shiftright("_place", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_place % 64 as int))")).alias("_bits"))
    )
    placed = rows.withColumn("_place", place)
    met = F.expr("coalesce(shiftright(_bits, cast(_place % 64 as int)) & 1L, 0L) = 1")
    joined = placed.join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    return joined.withColumn("_meets", met).drop("_place", "_word", "_bits")


def _merged(rows: DataFrame, bucket: str) -> DataFrame:
    """The latest version of each document, dealt once by folder, which the window needs no other order for."""
    part = F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(WRITERS)).cast("int")
    dealt = rows.withColumn("_writer", part).repartition("namespace", bucket, "_writer")
    return latest_versions(dealt, ("namespace", bucket, "_writer", "doc_id")).drop("_writer")


def upsert_documents(
    spark: SparkSession, path: str, incoming: DataFrame, version: int, replace: Sequence[str] = (), buckets: int = BUCKETS
) -> list[str]:
    """Merge documents into the table at ``path`` by namespace and id, the newest version staying.

    Returns the namespaces that received documents.

    A namespace is cut into ``buckets`` folders by a hash of the id, and only folders that receive
    documents are rewritten; the others keep their files. Namespaces in ``replace`` keep nothing
    of what they held. The new files stand before the old ones are taken away, when the job
    commits, so a run that fails leaves the table as it was.
    """
    bucket = _bucket_column(buckets)
    stamped = incoming.withColumns({
        "version": F.lit(version).cast("bigint"), bucket: F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    })
    held = _has_documents(spark, path)
    if held:
        stamped = stored(stamped, "incoming-documents")  # read for what it touches, for its ids, and itself
        touched = stamped.select("namespace", bucket).distinct()  # bounded: folders
        current = spark.read.parquet(path).withColumn("namespace", F.col("namespace").cast("string"))
        current = current.filter(~F.col("namespace").isin(list(replace)))
        current = _meeting(current.join(F.broadcast(touched), ["namespace", bucket], "left_semi"), stamped)
        meeting = current.filter("_meets").drop("_meets").unionByName(stamped, allowMissingColumns=True)
        # the table holds a document once, so those that meet no other are not shuffled
        apart = current.filter("not _meets").drop("_meets")
        merged = _merged(meeting, bucket).unionByName(apart, allowMissingColumns=True)
    else:
        merged = _merged(stamped, bucket)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("namespace", bucket)
        .parquet(path)
    )
    if not held:
        return namespaces(spark, path)
    received = {(r[0], r[1]) for r in stamped.select("namespace", bucket).distinct().collect()}  # folders, not rows
    for namespace in {n for n, _ in received}.intersection(replace):
        # folders of replaced namespaces that got nothing new still hold what was there
        for n in range(buckets):
            if (namespace, n) not in received:
                _remove(spark, f"{path.rstrip('/')}/namespace={namespace}/{bucket}={n}")
    return sorted({n for n, _ in received})


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path, fs = _hadoop_path(spark, path)
    return fs.exists(jvm_path)


def _has_documents(spark: SparkSession, path: str) -> bool:
    """Whether the document table holds files; a cleared one has none."""
    pattern, fs = _hadoop_path(spark, f"{path.rstrip('/')}/namespace=*/*/*.parquet")
    return len(fs.globStatus(pattern) or []) > 0


def _remove(spark: SparkSession, path: str) -> None:
    jvm_path, fs = _hadoop_path(spark, path)
    if fs.exists(jvm_path):
        fs.delete(jvm_path, True)


def namespaces(spark: SparkSession, path: str) -> list[str]:
    """The namespaces that the document table holds, by its folders."""
    pattern, fs = _hadoop_path(spark, f"{path.rstrip('/')}/namespace=*")
    return sorted(f.getPath().getName().removeprefix("namespace=") for f in fs.globStatus(pattern) or [])


def drop_namespaces(spark: SparkSession, path: str, namespaces: Sequence[str]) -> None:
    """Remove whole namespaces from the document table; each is one folder."""
    for namespace in namespaces:
        _remove(spark, f"{path.rstrip('/')}/namespace={namespace}")


def write_json_results(results: DataFrame, summary: DataFrame, path: str) -> dict[str, str]:
    """Results as JSON lines, and the one-row summary beside them."""
    paths = {"results": f"{path.rstrip('/')}/results", "summary": f"{path.rstrip('/')}/summary"}
    results.write.mode("overwrite").json(paths["results"])
    summary.coalesce(1).write.mode("overwrite").json(paths["summary"])
    return paths


def parse_params(params_json: str, defaults: dict) -> dict:
    """Defaults overlaid with a JSON object of parameters."""
    if not params_json:
        return dict(defaults)
    given = json.loads(params_json)
    if not isinstance(given, dict):
        raise ValueError("parameters must be a JSON object")
    return {**defaults, **given}
