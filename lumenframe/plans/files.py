"""Queries of sources, formats and the live feed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions.shared import shared_folder
from lumenframe.operators import assemble
from lumenframe.plans.bindings import dims, read
from lumenframe.plans.registry import register
from lumenframe.sources import load, null, sink

EDGE = 12
NULL_SQL = f"""SELECT i AS arrival, i // {EDGE * 20} AS seq, (i // {EDGE}) % 20 AS t, i % {EDGE} AS s FROM range({2 * 20 * EDGE}) AS g(i)"""


@register(
    "null_source_chunks",
    f"""SELECT arrival, seq::INTEGER AS "sequenceNumber", (CASE WHEN seq = 0 THEN s WHEN s < {EDGE // 2} THEN s * 2 ELSE (s - {EDGE // 2}) * 2 + 1 END + t * {EDGE})::BIGINT AS "acquisitionNumber",
      round(s * (110.0::DOUBLE / {EDGE}) - 50, 6) AS z, ((t * 40) % 256 + 4 * ((255 - s * 20 + 256) % 256))::BIGINT AS total FROM ({NULL_SQL})""",
)
def null_source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x).cast("long")
    return null.null_chunks(spark, EDGE).select("arrival", "sequenceNumber", "acquisitionNumber", F.round("indexOrigin.z", 6).alias("z"), total.alias("total"))


@register("null_source_images", f"SELECT s * {20 * EDGE}::BIGINT AS image_id, {EDGE} AS c, {EDGE} AS r, {EDGE} AS s, 20 AS t, true AS clean FROM range(2) AS g(s)")
def null_source_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble(null.null_chunks(spark, EDGE)).images.select("image_id", "dims.*", "clean")


@register("null_sink_check", "SELECT 0 AS \"sequenceNumber\", 5::BIGINT AS \"acquisitionNumber\", 'voxels' AS what UNION ALL SELECT 1, 7::BIGINT, 'missing'")
def null_sink_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk changed and one taken away: the check finds these two."""
    hit = (F.col("sequenceNumber") == 0) & (F.col("acquisitionNumber") == 5)
    gone = (F.col("sequenceNumber") == 1) & (F.col("acquisitionNumber") == 7)
    c = null.null_chunks(spark, EDGE).filter(~gone).withColumn("voxels", F.when(hit, F.transform("voxels", lambda x: x + 1)).otherwise(F.col("voxels")))
    return null.differences(c, EDGE)


def _roundtrip(name: str, module: str) -> None:
    @register(name, "SELECT vec_id, true AS same FROM embeddings")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import importlib

            import numpy as np

            from lumenframe.sources.model import Chunk

            form = importlib.import_module(f"lumenframe.sources.{module}")
            for f in frames:
                same = []
                for v in f["embedding"]:
                    x = np.asarray(v, "f4")
                    c = Chunk(np.rint(x * 100 + 128).clip(0, 255).astype("u1"), (8, 8, 1, 1), "u8bit") if module == "png" else Chunk(x, (4, 4, 4, 1), "float", voxelSize=(2.0, 1.5, 3.0), indexOrigin=(1.0, -2.0, 3.0))
                    got = form.decode(form.encode(c) if module == "png" else form.encode([c]))[0]
                    same.append(bool((got.voxels == c.voxels).all() and got.dims == c.dims and np.allclose(got.voxelSize, c.voxelSize)))
                yield pd.DataFrame({"vec_id": f["vec_id"], "same": same})

        return read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, same boolean")


for _name in ("nifti", "png", "vista"):
    _roundtrip(f"{_name}_roundtrip", _name)


def own_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_folder(spark)}/lumenframe-{uuid.uuid4().hex}"


@register("stream_reassembly", "SELECT user_id::VARCHAR AS sender, event_id AS acquisition, 4 AS \"columns\", 2 AS \"rows\", event_id % 256 + 8 * 256 + 8 AS total FROM events WHERE event_id % 256 < 200".replace("event_id % 256 + 8 * 256 + 8 AS total", "(8 * (event_id % 256))::BIGINT AS total"))
def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as datagrams (a header and two parts each; some are cut short), put together by a streaming query."""
    from lumenframe.streaming.datagrams import reassemble

    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sender"), "event_id")
    level = F.col("event_id") % 256
    header = F.concat(F.lit("<data_block_header>\nacquisition = "), F.col("event_id").cast("string"), F.lit("\ncolumns = 4\nrows = 2\nimages = 1\ndata_size_in_bytes = 16\n")).cast("binary")
    word = F.unhex(F.concat(F.lpad(F.hex(level), 2, "0"), F.lit("00")))
    half = F.unhex(F.repeat(F.hex(word), 4))
    parts = F.when(level < 200, F.array(header, half, half)).otherwise(F.array(header, half))
    folder = own_folder(spark)
    e.select("sender", F.posexplode(parts).alias("k", "payload"), "event_id").select("sender", (F.col("event_id") * 4 + F.col("k")).alias("seq"), "payload").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("sender string, seq long, payload binary").parquet(f"{folder}/in")
    query = reassemble(stream, timeout_ms=None).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{folder}/out").filter("complete")
    return done.select("sender", "acquisition", "columns", "rows", F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@register(
    "stream_chunks",
    """SELECT user_id::VARCHAR AS source, event_id AS "acquisitionNumber", (1 + event_id % 9)::INTEGER AS "sequenceNumber", 2 AS c, 2 AS r, 3 AS s, (12 * (event_id % 200) + 70)::BIGINT AS total,
      (event_id % 200 + 6)::DOUBLE AS second, 'subject' || event_id AS name, -1.0::DOUBLE AS row_y, -0.5::DOUBLE AS gap FROM events WHERE event_id % 7 <> 0""",
)
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as mosaics of three 2 x 2 slices, in a header and four parts over several batches; every seventh lacks its end."""
    from lumenframe.streaming.records import chunks, rocks_state

    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sender"), "event_id")
    tag = lambda k, v: F.concat(F.lit(f"<{k}>\n"), v if not isinstance(v, str) else F.lit(v), F.lit(f"\n</{k}>\n"))
    fields = {"width": "4", "height": "4", "mosaic": "yes", "images_in_mosaic": "3", "data_type": "short", "data_size_in_bytes": "32", "slice_orientation": "TRANSVERSE", "inplane_rotation": "0", "fov_read": "20", "fov_phase": "30", "slice_thickness": "2.5", "repetition_time": "2000", "patient_sex": "2"}
    fields |= {"read_vector": "1,0,0", "phase_vector": "0,1,0", "slice_norm_vector": "0,0,1"} | {f"slice_position_{k}": f"0,0,{2 * k}" for k in range(3)}
    own = {"acquisition_number": F.col("event_id").cast("string"), "meas_uid": (1 + F.col("event_id") % 9).cast("string"), "patient_name": F.concat(F.lit("subject"), F.col("event_id").cast("string"))}
    header = F.concat(F.lit("<data_block_header>\n"), *[tag(k, v) for k, v in (fields | own).items()]).cast("binary")
    word = lambda i: F.unhex(F.concat(F.lpad(F.hex((F.col("event_id") % 200 + i) % 256), 2, "0"), F.lit("00")))
    part = lambda k: F.concat(*[word(4 * k + i) for i in range(4)])
    parts = F.when(F.col("event_id") % 7 == 0, F.array(header, part(0), part(1))).otherwise(F.array(header, *[part(k) for k in range(4)]))
    folder = own_folder(spark)
    sent = e.select("sender", F.posexplode(parts).alias("k", "payload"), "event_id").select("sender", (F.col("event_id") * 8 + F.col("k")).alias("seq"), "payload")
    # three deliveries, cut in the middle of records; each is a batch, as the stream takes all that came since it stopped
    last = e.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("n")).first()["n"] * 8 + 8
    cuts = [0, last // 3 | 1, last // 3 * 2 | 1, last]
    for low, high in zip(cuts, cuts[1:], strict=False):
        sent.filter((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("sender string, seq long, payload binary").parquet(f"{folder}/in")
        with rocks_state(spark):
            query = chunks(stream, timeout_ms=None).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    done = spark.read.parquet(f"{folder}/out").filter("complete")
    return done.select(
        "source", "acquisitionNumber", "sequenceNumber", "dims.c", "dims.r", "dims.s", F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"), F.get("voxels", F.lit(6)).alias("second"),
        F.col("props")["subjectName"].alias("name"), F.col("rowVec.y").alias("row_y"), F.col("voxelGap.z").alias("gap"),
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunks of a file for each fifth of a label: a slice each, in the order of their ids."""
    e = read(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("set"), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 5).cast("string"), F.lit(".nii"))
    return e.select(
        name.alias("file_name"), F.col("vec_id").alias("lookup"), F.lit("double").alias("type_id"), dims(8, 8, 1, 1).alias("dims"), F.col("label").alias("sequenceNumber"), F.col("vec_id").alias("acquisitionNumber"),
        G.struct(G.vector(0, 0, F.col("vec_id").cast("double"))).alias("indexOrigin"), G.struct(G.vector(1, 0, 0)).alias("rowVec"), G.struct(G.vector(0, 1, 0)).alias("columnVec"), G.struct(G.vector(1, 1, 1)).alias("voxelSize"),
        F.transform("embedding", lambda x: x.cast("double")).alias("voxels"),
    )


@register("chunks_saved", "SELECT 'set' || label || '-' || vec_id % 5 || '.nii' AS name, 64 * count(*) AS voxels, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS total, arg_min(embedding, vec_id)[1]::DOUBLE AS first FROM embeddings GROUP BY ALL")
def chunks_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks saved by Spark's writer, twice, and loaded by its reader."""
    folder = own_folder(spark)
    for _ in range(2):  # a rerun replaces the files
        sink.write_chunks(_files(spark, sf_dir), folder)
    got = spark.read.format("chunks").load(folder)
    total = F.round(F.sum(F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x)), 6)
    return got.groupBy(F.substring_index("source", "/", -1).alias("name")).agg(F.sum(F.size("voxels")).cast("long").alias("voxels"), total.alias("total"), F.min_by(F.get("voxels", F.lit(0)), "part").alias("first"))


@register("writer_fallback", "SELECT 'v' || vec_id || '.img' AS file_name, CASE WHEN vec_id % 3 = 0 THEN 'png' ELSE 'nifti' END AS format, vec_id % 3 <> 0 AS refused, true AS written FROM embeddings")
def writer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first format refuses them: slices of bytes are written by it, volumes and real numbers by the next."""
    kind = F.col("vec_id") % 3
    level = F.transform("embedding", lambda x: F.rint(x.cast("double") * 100 + 128))
    c = read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".img")).alias("file_name"), F.lit(0).alias("lookup"), F.when(kind == 2, "float").otherwise("u8bit").alias("type_id"),
        F.when(kind == 1, dims(4, 4, 4, 1)).otherwise(dims(8, 8, 1, 1)).alias("dims"), F.lit(0).alias("sequenceNumber"), F.col("vec_id").alias("acquisitionNumber"), F.lit(None).cast("double").alias("acquisitionTime"),
        *[G.struct(G.vector(*v)).alias(n) for n, v in (("indexOrigin", (0, 0, 0)), ("rowVec", (1, 0, 0)), ("columnVec", (0, 1, 0)), ("sliceVec", (0, 0, 1)), ("voxelSize", (1, 1, 1)), ("voxelGap", (0, 0, 0)))],
        F.lit(None).cast("double").alias("repetitionTime"), F.create_map().cast("map<string,string>").alias("props"), F.when(kind == 2, F.transform("embedding", lambda x: x.cast("double"))).otherwise(level).alias("voxels"),
    )
    import os

    folder = own_folder(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    done = load.write(c, folder, formats=("png", "nifti"))
    return done.select("file_name", "format", F.col("refused").isNotNull().alias("refused"), (F.col("error").isNull() & (F.col("bytes") > 0)).alias("written"))
