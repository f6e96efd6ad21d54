"""The engine's programs as one command line: convert, diff, dump, flip, gauss, raw, calc."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import expr, names
from lumenframe.functions.scaling import MODES
from lumenframe.operators import assemble, diff, filters, image, props
from lumenframe.sources import load, null, raw


def read_chunks(spark: SparkSession, paths: list[str], suffix: str = "", dialect: str = "") -> DataFrame:
    if paths == [".null"]:
        return null.null_chunks(spark, dialect=int(dialect or 10))
    return load.load(spark, paths, suffix, dialect)


def images_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with image_id and lookup, and the images."""
    a = assemble.assemble(chunks)
    return a.chunks, a.images


def convert(chunks: DataFrame, target: str | None, mode: str) -> DataFrame:
    return image.converted(chunks, target, mode) if target else chunks


def calculate(chunks: DataFrame, expression: str) -> DataFrame:
    from lumenframe.functions.arrays import map_voxels

    value = lambda v, x, y, z, t: expr.voxel_expression(expression, v, x, y, z, t)
    return chunks.withColumns({"voxels": map_voxels(F.col("voxels"), F.col("dims"), value), "type_id": F.lit("double")})


def store(chunks: DataFrame, folder: str, pattern: str, suffix: str = "", formats: tuple[str, ...] = ()) -> DataFrame:
    """Write every image under a name from its properties; (file_name, bytes, error, format, refused).

    ``suffix`` takes the place of the pattern's; ``formats`` are tried in turn whatever the suffix.
    """
    if suffix:
        pattern = f"{pattern.rsplit('.', 1)[0]}.{suffix.lstrip('.')}"
    first = chunks.groupBy("image_id").agg(F.min("sequenceNumber").alias("sequenceNumber"))
    named = first.withColumn("name", names.file_name(pattern, {"sequenceNumber": F.col("sequenceNumber")}, {"sequenceNumber": "u16bit"}))
    unique = names.unique_names(named, "name", ["image_id"], list(load.REGISTRY) + [f"{s}.gz" for s in load.REGISTRY]).select("image_id", F.col("unique_name").alias("file_name"))
    return load.write(chunks.join(unique, "image_id"), folder, formats=formats)


def dump(chunks: DataFrame, by_chunk: bool = True) -> DataFrame:
    """(owner, text): the properties of every chunk, or of every image: those that all of its chunks have."""
    if by_chunk:
        leaves = chunks.select(F.col("arrival").alias("owner"), F.explode("props").alias("path", "value"))
    else:
        plain = [f.name for f in chunks.schema if f.dataType.typeName() in ("integer", "long", "double", "string") and f.name not in ("arrival", "part")]
        i = assemble.assemble(chunks.drop("voxels"), common=(*plain, "props"), geometry=True).images
        vectors = [*assemble.GEOMETRY, "indexOrigin", "fov"]
        text = lambda v: F.concat(F.lit("<"), F.concat_ws("|", *[F.col(v)[k] for k in "xyz"]), F.lit(">"))
        own = [F.struct(F.lit(n).alias("path"), F.col(n).cast("string").alias("value")) for n in plain]
        own += [F.struct(F.lit(v).alias("path"), F.when(F.col(v).isNotNull(), text(v)).alias("value")) for v in vectors]
        own.append(F.struct(F.lit("size").alias("path"), image.size_text(F.col("dims")).alias("value")))
        more = F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
        leaves = i.select(F.col("image_id").alias("owner"), F.explode(F.concat(F.filter(F.array(*own), lambda x: x["value"].isNotNull()), more)).alias("e")).select("owner", "e.*")
    return props.listing(props.with_key(leaves.withColumn("type", F.lit("string"))).select(*props.COLUMNS))


def compare(left: DataFrame, right: DataFrame, select: list[str], ignore: list[str]) -> diff.DataSetDiff:
    sides = []
    for chunks in (left, right):
        own, _ = images_of(chunks)
        table = own.groupBy("image_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in select])
        tree = props.from_columns(own.filter("lookup = 0"), "image_id", {"sequenceNumber": "u16bit", "repetitionTime": "float"})
        sides.append((table, tree, own))
    (lt, lp, lc), (rt, rp, rc) = sides
    return diff.diff(lt, rt, lp, rp, lc, rc, select, tuple(ignore))


def formats() -> list[str]:
    """A line per format: name, suffixes, dialects, and whether it writes."""
    known = {f.name: f for group in load.REGISTRY.values() for f in group}
    return [f"{n}: {', '.join(f.suffixes)}; dialects: {', '.join(f.dialects) or 'none'}; {'reads and writes' if f.encode else 'reads'}" for n, f in sorted(known.items())]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenframe", description=__doc__)
    p.add_argument("program", choices=("convert", "diff", "dump", "flip", "gauss", "raw", "calc"))
    p.add_argument("--in", dest="inputs", nargs="+", default=[])
    p.add_argument("--in2", nargs="+", default=[])
    p.add_argument("--out", help="folder that all executors share")
    p.add_argument("--name", default="S{%d_sequenceNumber}.nii")
    p.add_argument("--rf", default="", help="read as this suffix")
    p.add_argument("--rdialect", default="")
    p.add_argument("--repn", help="type of the output")
    p.add_argument("--scale-mode", default="autoscale", choices=MODES)
    p.add_argument("--along", default="c", choices=(*image.DIMENSIONS, *image.SCANNER_AXES))
    p.add_argument("--flip", default="image", choices=("image", "space", "both"))
    p.add_argument("--center", action="store_true", help="mirror space about the center of what is flipped")
    p.add_argument("--wf", default="", help="write as this suffix")
    p.add_argument("--wformats", nargs="*", default=[], help="formats to try in turn for writing")
    p.add_argument("--np", action="store_true", help="no progress bar")
    p.add_argument("--help-io", action="store_true", help="list the formats and end")
    p.add_argument("--rawdims", type=int, nargs="+", help="columns, rows, slices, time steps of raw files; a square without them")
    p.add_argument("--read-repn", default="u8bit", choices=raw.DTYPES, help="type of raw files")
    p.add_argument("--offset", type=int, default=0, help="bytes before the first element of raw files")
    p.add_argument("--byteswap", action="store_true", help="raw files have reversed bytes")
    p.add_argument("--voxel", type=float, nargs=3, help="voxel size of raw files")
    p.add_argument("--origin", type=float, nargs=3, help="index origin of raw files")
    p.add_argument("--chunks", action="store_true", help="dump chunks instead of images")
    p.add_argument("--fwhm", type=float, default=2.0)
    p.add_argument("--voxelop", default="vox")
    p.add_argument("--selectwith", nargs="+", default=["sequenceNumber"])
    p.add_argument("--ignore", nargs="*", default=["source"])
    return p


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    o = parser().parse_args(arguments)
    if o.help_io:
        for line in formats():
            print(line)
        return 0
    if not o.inputs:
        parser().error("--in is needed")
    spark = spark or SparkSession.builder.appName("lumenframe").getOrCreate()
    if o.np:
        spark.conf.set("spark.ui.showConsoleProgress", "false")
    if o.program == "raw" or o.rf == "raw":
        chunks = load.load_raw(spark, o.inputs, o.read_repn, tuple(o.rawdims) if o.rawdims else None, o.offset, o.byteswap, tuple(o.voxel) if o.voxel else None, tuple(o.origin) if o.origin else None)
    else:
        chunks = read_chunks(spark, o.inputs, o.rf, o.rdialect)
    if o.program == "dump":
        for r in dump(chunks, o.chunks).toLocalIterator():
            print(f"{r['owner']}\n{r['text']}")
        return 0
    if o.program == "diff":
        d = compare(chunks, read_chunks(spark, o.in2, o.rf, o.rdialect), o.selectwith, o.ignore)
        found = [d.metadata.count(), d.voxels.count(), d.unmatched.count()]
        print(f"{found[0]} properties and the voxels of {found[1]} images differ; {found[2]} images have no partner")
        return min(255, sum(found))
    own, images = images_of(chunks)
    if o.program == "flip":
        if o.flip != "space":  # chunks may have exchanged their places, so they are put in order again
            own, images = images_of(image.flipped_along(own, images, o.along, "image").drop("image_id", "lookup", "horizontal", "vertical"))
        if o.flip != "image":
            own = image.flipped_along(own, images, o.along, "space", o.center)
    elif o.program == "gauss":
        own = filters.gauss(own, fwhm=o.fwhm)
    elif o.program == "calc":
        own = calculate(own, o.voxelop)
    failed = 0
    for r in store(convert(own, o.repn, o.scale_mode), o.out, o.name, o.wf, tuple(o.wformats)).toLocalIterator():
        print(f"{r['file_name']}: {r['error'] or f'{r['bytes']} bytes'}")
        failed += r["error"] is not None
    return min(255, failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
