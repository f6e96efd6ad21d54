"""Operations on assembled images: (image_id, lookup, dims, voxels, ...) chunks and the images' table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import geometry as G
from lumenframe.functions import scaling as S
from lumenframe.functions.types import of

NUMBERS = ["u8bit", "s8bit", "u16bit", "s16bit", "u32bit", "s32bit", "float", "double"]


def image_range(chunks: DataFrame, group: str = "image_id") -> DataFrame:
    """(group, low, low_type, high, high_type) over all chunks (voxels, type_id); values that aren't finite don't count."""
    r = chunks.select(group, "type_id", S.array_range(F.col("voxels")).alias("r")).filter("r is not null")
    return r.groupBy(group).agg(
        F.min("r.low").alias("low"), F.min_by("type_id", F.struct("r.low", "type_id")).alias("low_type"),
        F.max("r.high").alias("high"), F.max_by("type_id", F.struct("r.high", "type_id")).alias("high_type"),
    )


def with_major_type(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("major_type", S.major_type(F.col("low"), F.col("low_type"), F.col("high"), F.col("high_type"), NUMBERS))


def max_bytes(chunks: DataFrame, group: str = "image_id") -> DataFrame:
    size = F.lit(None).cast("int")
    for name in NUMBERS:
        size = F.when(F.col("type_id") == name, of(name).bytes).otherwise(size)
    return chunks.groupBy(group).agg(F.max(size).alias("bytes"))


def _dynamic_scaling(low: Column, high: Column, source: Column, target: str, mode: str) -> Column:
    """The scaling into ``target`` for a source type that each row names: whole numbers and real ones differ in whether they may be enlarged."""
    whole = source.isin([n for n in NUMBERS if of(n).is_integer])
    kinds = [S.scaling(low, high, k, target, mode) for k in ("s32bit" if target != "s32bit" else "s16bit", "double" if target != "double" else "float")]
    return F.when(whole, kinds[0]).otherwise(kinds[1])


def conversion(chunks: DataFrame, target: str | None = None, mode: str = "autoscale", group: str = "image_id", order: str = "lookup") -> DataFrame:
    """(group, target, low, high, source, scale, offset, error): what it takes to bring each image into one type.

    Ranges and first places are taken by (image, type), so an image is a few short rows from then on.  They tell the range of all chunks, the types of its
    ends, and the first chunk that isn't of the target type, whose type decides the scaling.  Without ``target`` images go to their major type: their
    only one, or that of one end which holds the other; if neither does, ``error`` says so.  An image wholly of the target type has scale 1 and offset 0.
    """
    place = F.col(order) if order in chunks.columns else F.lit(0)
    rows = chunks.select(group, "type_id", place.alias("at"), S.array_range(F.col("voxels")).alias("r"))  # chunks without a finite voxel have a type but no range
    by_type = rows.groupBy(group, "type_id").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"), F.min("at").alias("at"))
    end = lambda n: F.when(F.col(n).isNotNull(), F.struct(n, "type_id"))
    d = by_type.groupBy(group).agg(
        F.min("low").alias("low"), F.min_by("type_id", end("low")).alias("low_type"), F.max("high").alias("high"), F.max_by("type_id", end("high")).alias("high_type"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "type_id"))), lambda x: x["type_id"]).alias("types"),
    )
    if target is None:
        major = S.major_type(F.col("low"), F.col("low_type"), F.col("high"), F.col("high_type"), NUMBERS)
        d = d.withColumn("target", F.when((F.size("types") == 1) | F.col("low").isNull(), F.get("types", F.lit(0))).otherwise(major))
    else:
        d = d.withColumn("target", F.lit(target))
    d = d.withColumn("source", F.get(F.filter("types", lambda x: x != F.col("target")), F.lit(0)))
    s = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    for name in NUMBERS if target is None else [target]:
        s = F.when((F.col("target") == name) & F.col("source").isNotNull() & F.col("low").isNotNull(), _dynamic_scaling(F.col("low"), F.col("high"), F.col("source"), name, mode)).otherwise(s)
    error = F.when(F.col("target").isNull(), F.concat(F.lit("no type of "), F.array_join(F.array_sort("types"), ", "), F.lit(" holds both ends")))
    return d.withColumn("s", F.when(error.isNull(), s)).select(group, "target", "low", "high", "source", "s.scale", "s.offset", error.alias("error"))


def converted(chunks: DataFrame, target: str | None, mode: str = "autoscale", group: str = "image_id") -> DataFrame:
    """Chunks in one type (without ``target`` the image's major type), with one scaling for the whole image.

    Chunks of the target type are passed on untouched, whatever the mode.  Chunks of an image without a major type stay as they are.
    """
    made = conversion(chunks, target, mode, group).select(group, F.col("target").alias("__t"), F.col("scale").alias("__s"), F.col("offset").alias("__o"))
    # one short row per image; the chunks don't move unless it is large
    d = chunks.join(made, group)
    out = F.col("voxels")
    element = chunks.schema["voxels"].dataType.elementType.simpleString()
    if target is not None:  # one carrier for the whole column: that of the target
        fits = S.convert_array(F.col("voxels"), target)
        moved = S.convert_array(F.col("voxels"), target, F.col("__s"), F.col("__o"))
        out = F.when(F.col("type_id") == F.col("__t"), fits).otherwise(moved)
    else:  # images of several types in one column keep its carrier
        for name in NUMBERS:
            moved = F.transform(S.convert_array(F.col("voxels"), name, F.col("__s"), F.col("__o")), lambda x: x.cast(element))
            out = F.when((F.col("__t") == name) & (F.col("type_id") != name), moved).otherwise(out)
    return d.withColumns({"voxels": out, "type_id": F.coalesce("__t", "type_id")}).drop("__t", "__s", "__o")


def chunk_with_image(chunks: DataFrame, common: DataFrame, names: list[str]) -> DataFrame:
    """Chunks with the image's common properties; a chunk's own value comes first."""
    right = common.select("image_id", *[F.col(n).alias(f"__i_{n}") for n in names])
    d = chunks.join(right, "image_id", "left")
    for n in names:
        d = d.withColumn(n, F.coalesce(F.col(n), F.col(f"__i_{n}")) if n in chunks.columns else F.col(f"__i_{n}"))
    return d.drop(*[f"__i_{n}" for n in names])


def voxels(chunks: DataFrame) -> DataFrame:
    """(image_id, lookup, x, y, z, t, value): a row per voxel, places inside the chunk."""
    d = chunks.select("image_id", "lookup", "dims", F.posexplode("voxels").alias("__i", "value"))
    return d.withColumn("__c", A.coordinates(F.col("dims"), F.col("__i"))).select("image_id", "lookup", "__c.*", "value")


def gathered(chunks: DataFrame) -> DataFrame:
    """(image_id, voxels): all chunks one after another in image order.  A row holds one whole image."""
    both = F.array_sort(F.collect_list(F.struct("lookup", "voxels")))
    return chunks.groupBy("image_id").agg(F.flatten(F.transform(both, lambda x: x["voxels"])).alias("voxels"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, different, total) of two images with the same chunks (image_id, lookup, voxels); chunks of one side differ wholly."""
    left, right = (x.select("image_id", "lookup", F.col("voxels").alias(n)) for x, n in ((a, "va"), (b, "vb")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    empty = F.expr("transform(array(), x -> cast(null as double))")
    different = A.count_different(F.coalesce("va", empty), F.coalesce("vb", empty))
    return left.join(right, ["image_id", "lookup"], "full").groupBy("image_id").agg(F.sum(different).cast("long").alias("different"), F.sum(F.greatest(n("va"), n("vb"))).cast("long").alias("total"))


def chunk_properties(chunks: DataFrame, name: str, unique: bool = False, group: str = "image_id", order: str = "lookup") -> DataFrame:
    """(group, values): a property of all chunks in order; ``unique`` drops empty ones and repeats of the one before."""
    d = chunks
    if unique:
        d = d.filter(F.col(name).isNotNull())
        before = F.lag(name).over(Window.partitionBy(group).orderBy(order))
        d = d.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col(name)))
    return d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("values"))


def auto_splice(chunks: DataFrame, stride: int = 1) -> DataFrame:
    """The highest dimension cut apart: a chunk per part, its origin moved along and its acquisition number raised."""
    d = chunks.withColumn("__top", A.relevant_dims(F.col("dims")))
    dims = F.col("dims")
    count = splice_parts(dims)
    less = F.struct(*[F.when(F.col("__top") == k + 1, 1).otherwise(dims[a]).alias(a) for k, a in enumerate(A.AXES)])
    block = (F.size("voxels") / count).cast("int")
    d = d.select("*", F.posexplode(A.splice(F.col("voxels"), block)).alias("__i", "__v"))
    step = F.col("voxelSize")
    if "voxelGap" in chunks.columns:
        step = G.each(lambda size, gap: size + F.coalesce(gap, F.lit(0.0)), step, F.col("voxelGap"))
    normal = G.cross(F.col("rowVec"), F.col("columnVec"))
    if "sliceVec" in chunks.columns:
        normal = G.each(lambda own, made: F.coalesce(own, made), F.col("sliceVec"), normal)
    along = lambda x, r, c, s: x + F.col("__i") * (F.when(F.col("__top") == 3, s * step["z"]).when(F.col("__top") == 2, c * step["y"]).when(F.col("__top") == 1, r * step["x"]).otherwise(0.0))
    moved = G.struct(G.each(along, F.col("indexOrigin"), F.col("rowVec"), F.col("columnVec"), normal))
    return d.withColumns({"voxels": F.col("__v"), "dims": less, "indexOrigin": moved, "acquisitionNumber": F.col("acquisitionNumber") + F.lit(stride) * F.col("__i")}).drop("__top", "__i", "__v")


def splice_parts(dims: Column) -> Column:
    """Into how many chunks the highest dimension is cut."""
    top = A.relevant_dims(dims)
    return F.when(top == 4, dims["t"]).when(top == 3, dims["s"]).when(top == 2, dims["r"]).otherwise(dims["c"])


def splice_properties(tree: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The property tree of spliced chunks: (owner, part, path, idx, type, value), and (owner, path, length, parts) of the lists that were dropped.

    ``parts`` says for each owner into how many chunks it is cut.  Every chunk gets all single values; a list is dealt out in equal runs, one to a chunk, if its
    length is a multiple of the number of chunks, and dropped else.  Each list value goes to one chunk; only single values are repeated.
    """
    counted = tree.join(parts.select("owner", F.col("parts").alias("__n")), "owner")
    length = F.max(F.col("idx") + 1).over(Window.partitionBy("owner", "path_lc"))
    d = counted.withColumn("__len", length)
    is_list, fits = F.col("__len") > 1, F.col("__len") % F.col("__n") == 0
    run = F.floor(F.col("__len") / F.col("__n")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("__n").cast("int") - 1)
    dealt = d.filter(~is_list | fits).withColumn("part", F.explode(F.when(is_list, F.array(F.floor(F.col("idx") / run).cast("int"))).otherwise(all_parts)))
    dealt = dealt.withColumn("idx", F.when(is_list, F.col("idx") % run).otherwise(F.col("idx")).cast("int"))
    dropped = d.filter(is_list & ~fits & (F.col("idx") == 0)).select("owner", "path", F.col("__len").alias("length"), F.col("__n").alias("parts"))
    return dealt.select("owner", "part", "path", "path_lc", "idx", "type", "value"), dropped


def splice_down_to(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks of at most ``dim`` dimensions (all with as many as the first to begin with are cut alike)."""
    d, stride = chunks, 1
    for top in range(4, dim, -1):
        tall = A.relevant_dims(F.col("dims")) == top
        d = d.filter(~F.coalesce(tall, F.lit(False))).unionByName(auto_splice(d.filter(tall), stride))
    return d


def flipped(chunks: DataFrame, axis: str) -> DataFrame:
    return chunks.withColumn("voxels", A.flip(F.col("voxels"), F.col("dims"), axis))


def flipped_order(chunks: DataFrame) -> DataFrame:
    """Chunks of an image in reverse order, their properties in place: lookup is mirrored."""
    last = F.max("lookup").over(Window.partitionBy("image_id"))
    return chunks.withColumn("__last", last).withColumn("lookup", F.col("__last") - F.col("lookup")).drop("__last")


def swapped_properties(chunks: DataFrame, images: DataFrame, axis: str, carried: tuple[str, ...] = ("voxels",), unpaired: bool = True) -> DataFrame:
    """Chunks along one axis of the image exchange their properties, first with last, and keep what is ``carried``.

    Only for axes above the chunks' own dimensions, where an image has more than one chunk; others keep their place.  The mirrored place follows
    from the image's and the chunk's dims, so chunks meet properties by (image_id, lookup).  A chunk without a partner keeps its own, or is left out if
    ``unpaired`` is false.
    """
    k = A.AXES.index(axis)
    sizes = images.select("image_id", F.col("dims").alias("__image"))
    d = chunks.join(sizes, "image_id")
    along = [F.floor(F.col("__image")[a] / F.col("dims")[a]).cast("long") for a in A.AXES]
    below = F.lit(1).cast("long")
    for n in along[:k]:
        below = below * n
    here = F.floor(F.col("lookup") / below).cast("long") % along[k]
    mirrored = F.col("lookup") + below * (along[k] - 1 - 2 * here)
    names = [c for c in chunks.columns if c not in ("image_id", "lookup", *carried)]
    moved = d.select("image_id", mirrored.alias("lookup"), F.struct(*names).alias("__moved"))
    both = chunks.join(moved, ["image_id", "lookup"], "left" if unpaired else "inner")
    given = F.col("__moved").isNotNull()
    return both.select(*[F.when(given, F.col("__moved")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in chunks.columns])


#: What a program calls the axes: image dimensions, and scanner axes of which each image has its own dimension.
DIMENSIONS = {"row": 0, "column": 1, "slice": 2, "c": 0, "r": 1, "s": 2, "t": 3}
SCANNER_AXES = ("x", "y", "z")


def _slice_direction(columns: list[str]) -> Column:
    made = G.cross(F.col("rowVec"), F.col("columnVec"))
    return G.struct(G.each(lambda own, other: F.coalesce(own, other), F.col("sliceVec"), made)) if "sliceVec" in columns else G.struct(made)


def dimension_along(along: str, columns: list[str]) -> Column:
    """The image dimension (0 to 3) of an axis by name."""
    if along in DIMENSIONS:
        return F.lit(DIMENSIONS[along])
    if along not in SCANNER_AXES:
        raise ValueError(f"an axis is one of {', '.join([*DIMENSIONS, *SCANNER_AXES])}")
    return G.image_dimension_of_axis(F.col("rowVec"), F.col("columnVec"), _slice_direction(columns), along)


def mirrored_space(rows: DataFrame, dimension: Column, center: bool = False) -> DataFrame:
    """Chunks or images with physical space mirrored about its origin in component ``dimension`` (0 to 2), or about their own center along direction ``dimension``."""
    d = rows.withColumns({"__k": dimension, "sliceVec": _slice_direction(rows.columns)})
    sign = [F.when(F.col("__k") == k, -1.0).otherwise(1.0) for k in range(3)]
    zero = F.lit(0.0)
    t = tuple(G.vector(*[sign[i] if i == j else zero for j in range(3)]) for i in range(3))
    axes = G.from_columns(F.col("rowVec"), F.col("columnVec"), F.col("sliceVec"))
    if center:
        gap = F.col("voxelGap") if "voxelGap" in rows.columns else None
        step = G.add(F.col("voxelSize"), G.each(lambda g: F.coalesce(g, zero), gap)) if gap is not None else F.col("voxelSize")
        origin, turned = G.transform_about_center(t, F.col("indexOrigin"), axes, tuple(F.col("dims")[a] for a in "crs"), step)
    else:
        origin, turned = G.transform_about_origin(t, F.col("indexOrigin"), axes)
    row, column, slice_ = G.transposed(turned)
    return d.withColumns({"indexOrigin": G.struct(origin), "rowVec": G.struct(row), "columnVec": G.struct(column), "sliceVec": G.struct(slice_)}).drop("__k")


def flipped_along(chunks: DataFrame, images: DataFrame, along: str, what: str = "both", center: bool = False) -> DataFrame:
    """Images flipped along an axis: their voxels (``image``), their place in space (``space``), or both.

    Inside chunks voxels change places; above the chunks' dimensions chunks exchange properties.
    """
    if what not in ("image", "space", "both"):
        raise ValueError("what is image, space or both")
    d = chunks.withColumn("__axis", dimension_along(along, chunks.columns))
    if what != "space":
        inside = A.relevant_dims(F.col("dims")) > F.col("__axis")
        voxels = F.col("voxels")
        for k, a in enumerate(A.AXES):
            voxels = F.when(F.col("__axis") == k, A.flip(F.col("voxels"), F.col("dims"), a)).otherwise(voxels)
        carried = tuple(c for c in ("voxels", "type_id") if c in chunks.columns)
        parts = [d.filter(inside).withColumn("voxels", voxels)]
        for k in [DIMENSIONS[along]] if along in DIMENSIONS else range(3):
            parts.append(swapped_properties(d.filter(~inside & (F.col("__axis") == k)), images, A.AXES[k], carried))
        d = parts[0]
        for p in parts[1:]:
            d = d.unionByName(p)
    if what != "image":
        d = mirrored_space(d, F.col("__axis"), center)
    return d.drop("__axis")


def size_text(dims: Column) -> Column:
    return F.concat_ws("x", *[dims[a].cast("string") for a in A.AXES])


def identity(sequence: Column, description: Column, start: Column, path: Column | None = None) -> Column:
    """A label: S<number>, description, start, and the source path."""
    label = F.concat(F.lit("S"), sequence.cast("string"), F.coalesce(F.concat(F.lit("_"), description), F.lit("")), F.coalesce(F.concat(F.lit("_"), start.cast("string")), F.lit("")))
    return label if path is None else F.concat(label, F.coalesce(F.concat(F.lit(" from "), path), F.lit("")))


def voxel_at(chunks: DataFrame, images: DataFrame, places: DataFrame) -> DataFrame:
    """(image_id, x, y, z, t, value) of asked places: the chunk that holds a place follows from its linear index."""
    d = places.join(images.select("image_id", F.col("dims").alias("__image")), "image_id")
    size = chunks.groupBy("image_id").agg(F.max(F.size("voxels")).alias("__size"))
    d = d.join(size, "image_id").withColumn("__at", A.linear_index(F.col("__image"), F.col("x"), F.col("y"), F.col("z"), F.col("t")))
    d = d.withColumns({"lookup": F.floor(F.col("__at") / F.col("__size")).cast("long"), "__in": (F.col("__at") % F.col("__size")).cast("int")})
    found = d.join(chunks.select("image_id", "lookup", "voxels"), ["image_id", "lookup"], "left")
    inside = A.in_range(F.col("__image"), F.col("x"), F.col("y"), F.col("z"), F.col("t"))
    return found.select("image_id", "x", "y", "z", "t", F.when(inside, F.get("voxels", F.col("__in"))).alias("value"))


def for_each_chunk(chunks: DataFrame, f, schema: str | None = None) -> DataFrame:
    """f(frame) -> frame on batches of chunk rows, where built-in functions don't do; each row is a whole chunk."""

    def run(frames):
        for frame in frames:
            yield f(frame)

    return chunks.mapInPandas(run, schema or chunks.schema)


def count_failures(chunks: DataFrame, holds, group: str = "image_id") -> DataFrame:
    """(group, failures): voxels for which holds(value, x, y, z, t) is false or null."""
    failed = F.size(F.filter(A.map_voxels(F.col("voxels"), F.col("dims"), holds), lambda ok: ~F.coalesce(ok, F.lit(False))))
    return chunks.groupBy(group).agg(F.sum(failed).cast("long").alias("failures"))


def repetition_time(times: Column) -> Column:
    """Largest step between neighbouring slice times of an array."""
    steps = F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: F.abs(b - a))
    return F.array_max(steps)


def duplicate_metadata(chunks: DataFrame, columns: list[str], order: str = "image_id") -> DataFrame:
    """(digest, ids): images whose listed properties are all equal; pairs are never built."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return chunks.groupBy(digest.alias("digest")).agg(F.sort_array(F.collect_set(order)).alias("ids")).filter(F.size("ids") > 1)
