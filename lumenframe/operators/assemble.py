"""Assembly of an unordered bag of chunks into images, as one window plan over chunk headers.

A chunk is a row with ``arrival`` (order of appearance, unique), ``dims`` struct<c, r, s, t>, ``indexOrigin``, ``rowVec``,
``columnVec``, ``sliceVec`` (may be null) structs<x, y, z>, ``acquisitionNumber`` and further equality columns.

Voxels take no part: run it on headers and join voxels back by arrival.  Headers move once, by a hash of what is equal in an image; all
windows and groupings that follow keep that hash first, so they sort where they are.  Chunks of one image meet in one task, as
their order decides the shape; that is the image's header count, not its voxels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import geometry as G

#: Properties that must be equal in all chunks of an image (those a table has).
EQUALITY = ("sequenceNumber", "voxelSize", "rowVec", "columnVec", "sliceVec", "coilChannelMask", "echoNumbers", "coilString")
#: Properties without which a chunk is dropped.
NEEDED = ("indexOrigin", "acquisitionNumber", "voxelSize", "rowVec", "columnVec")
#: Headers are dealt over so many times the session's partitions, as a task sorts its share several times over and holds two sorts of it at once.
FINER = 4


@dataclass(frozen=True)
class Assembly:
    """chunks: kept chunks with image_id, lookup (place in the image), horizontal, vertical.
    images: image_id, dims, chunk_count, timesteps, clean.  rejected: chunks that are in no image, with the reason.
    """

    chunks: DataFrame
    images: DataFrame
    rejected: DataFrame


def valid_chunks(chunks: DataFrame, needed: tuple[str, ...] = NEEDED) -> Column:
    """Volume above 0 and all needed properties there."""
    ok = A.volume(F.col("dims")) > 0
    for name in needed:
        if name in chunks.columns:
            ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def projected_position(chunks: DataFrame) -> Column:
    """Origin in the chunk's own axes; a missing slice direction is the cross product of the others."""
    o, r, c = F.col("indexOrigin"), F.col("rowVec"), F.col("columnVec")
    s = G.cross(r, c)
    if "sliceVec" in chunks.columns:
        s = G.each(lambda own, made: F.when(F.col("sliceVec").isNotNull(), own).otherwise(made), F.col("sliceVec"), s)
    return G.struct(G.vector(G.dot(o, r), G.dot(o, c), G.dot(o, s)))


def _names(secondary: str | tuple[str, ...]) -> tuple[str, ...]:
    return (secondary,) if isinstance(secondary, str) else tuple(secondary)


def _sorted_by(d: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add ``__by``: which of ``names`` a chunk is sorted by (null: it has none of them).

    The first chunk of a group decides: the first name that it has.  Chunks that lack it stay for the next round, where the first of them decides;
    so every round uses up a name.
    """
    if len(names) == 1:
        return d.withColumn("__by", F.when(F.col(names[0]).isNotNull(), 0))
    own = F.coalesce(*[F.when(F.col(n).isNotNull(), i) for i, n in enumerate(names)])
    d = d.withColumn("__by", F.lit(None).cast("int"))
    group = Window.partitionBy("__k", "__g")
    for _ in names:
        free = F.col("__by").isNull() & own.isNotNull()
        d = d.withColumn("__choice", F.min_by(F.when(free, own), F.when(free, F.col("arrival"))).over(group))
        held = F.lit(False)
        for i, n in enumerate(names):
            held = held | ((F.col("__choice") == i) & F.col(n).isNotNull())
        d = d.withColumn("__by", F.when(free & held, F.col("__choice")).otherwise(F.col("__by"))).drop("__choice")
    return d


def placed(chunks: DataFrame, equality: tuple[str, ...] = EQUALITY, secondary: str | tuple[str, ...] = "acquisitionNumber", needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """Valid chunks with image_id, depth at their position, and rectangular (of their image).

    The n-th chunk (by arrival) with the same key, position and secondary value goes to the n-th image of its key.  Of several ``secondary``
    names the first that an image's first chunk has is taken; the others are what to fall back on.  A chunk with none of them has no image_id.
    """
    names = _names(secondary)
    key = [F.col("dims"), *[F.col(n) for n in equality if n in chunks.columns], F.when(F.col("dims")["s"] > 1, F.col("indexOrigin"))]
    d = chunks.filter(valid_chunks(chunks, needed)).withColumns({"__key": F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]), "__p": projected_position(chunks)})
    parts = FINER * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("__k", F.xxhash64("__key")).repartition(parts, "__k")  # the only exchange
    d = _sorted_by(d.withColumn("__g", F.min("arrival").over(Window.partitionBy("__k", "__key"))), names)
    d = d.withColumn("__v", F.struct(*[F.when(F.col("__by") == i, F.col(n)).alias(n) for i, n in enumerate(names)]) if len(names) > 1 else F.col(names[0]))
    d = d.withColumn("__dup", F.row_number().over(Window.partitionBy("__k", "__g", "__by", "__p", "__v").orderBy("arrival")))
    image, place = Window.partitionBy("__k", "__g", "__by", "__dup"), Window.partitionBy("__k", "__g", "__by", "__dup", "__p")
    sorts = F.col("__by").isNotNull()
    d = d.withColumns({"image_id": F.when(sorts, F.min("arrival").over(image)), "depth": F.count(F.lit(1)).over(place)})
    return d.withColumn("rectangular", sorts & (F.min("depth").over(image) == F.max("depth").over(image)))


def ordered(chunks: DataFrame) -> DataFrame:
    """Placed chunks of rectangular images with horizontal (rank of the position), vertical (rank in it) and lookup, all from 0."""
    p = F.col("__p")
    by_place = Window.partitionBy("__k", "image_id").orderBy(*G.lexical_key(p))
    inside = Window.partitionBy("__k", "image_id", "__p").orderBy("__v")
    d = chunks.filter("rectangular").withColumns({"horizontal": F.dense_rank().over(by_place) - 1, "vertical": F.row_number().over(inside) - 1})
    positions = F.max("horizontal").over(Window.partitionBy("__k", "image_id")) + 1
    return d.withColumn("lookup", (F.col("horizontal") + F.col("vertical") * positions).cast("long"))


def _distance(a: Column, b: Column) -> Column:
    return G.square_length(G.subtract(a, b))


def _stride(origins: Column, n: Column, timesteps: Column, base: Column) -> Column:
    """Chunks until the geometry starts over, in steps of ``base``; all of a time step if it never does."""
    at = lambda i: F.get(origins, i)
    first = at(F.lit(0))
    steps = F.when(n > 2 * base, F.sequence(base, n - base - 1, base)).otherwise(F.array().cast("array<int>"))
    breaks = F.filter(steps, lambda i: _distance(at(i + base), first) <= _distance(at(i + base), at(i)))
    found = F.when(F.size(breaks) > 0, F.get(breaks, F.lit(0)) + base)
    many = F.when(_distance(at(base), first) == 0, base).otherwise(found)
    whole = F.floor(n / timesteps).cast("int")
    return F.when(n >= 4 * base, F.coalesce(many, whole)).when(n % base != 0, n - n % base).otherwise(whole)


#: What the geometry of an image is made from.
GEOMETRY = ("rowVec", "columnVec", "sliceVec", "voxelSize", "voxelGap")


def _common_entries(name: str) -> Column:
    """Of a map column the entries that all chunks have."""
    all_entries = F.collect_list(F.coalesce(F.map_entries(name), F.array().cast("array<struct<key:string,value:string>>")))
    return F.map_from_entries(F.aggregate(F.slice(all_entries, 2, F.count(F.lit(1)).cast("int")), F.get(all_entries, F.lit(0)), lambda a, b: F.array_intersect(a, b)))


def _common_value(name: str) -> Column:
    """The value that all chunks have; null if there is none."""
    same = (F.min(name) == F.max(name)) & (F.count(name) == F.count(F.lit(1)))
    return F.when(same, F.min(name))


def image_table(chunks: DataFrame, min_dim: int = 0, common: tuple[str, ...] = (), geometry: bool = False) -> DataFrame:
    """(image_id, dims, chunk_count, timesteps, clean) from ordered chunks, the ``common`` columns that all chunks of an image agree on, and geometry.

    Origins are gathered in image order: one struct per chunk, which bounds the row by the image's chunk count.
    """
    near = ["__k", "image_id"] if "__k" in chunks.columns else ["image_id"]
    maps = {f.name for f in chunks.schema if f.dataType.typeName() == "map"}
    kept = [n for n in common if n in chunks.columns]
    axes = [n for n in GEOMETRY if geometry and n in chunks.columns and n not in kept]
    grouped = chunks.groupBy(*near).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max("depth").cast("int").alias("timesteps"),
        F.min_by("dims", "lookup").alias("chunk_dims"),
        F.array_sort(F.collect_list(F.struct("lookup", "indexOrigin"))).alias("o"),
        *[(_common_entries(n) if n in maps else _common_value(n)).alias(f"__c_{n}") for n in kept],
        *[_common_value(n).alias(f"__c_{n}") for n in axes],
    )
    d = grouped.withColumns({"origins": F.transform("o", lambda x: x["indexOrigin"]), "below": F.greatest(A.relevant_dims(F.col("chunk_dims")), F.lit(min_dim))}).drop("o")
    d = d.withColumns({"sort_dims": F.lit(4) - (F.col("timesteps") > 1).cast("int"), "size": F.lit(1)})
    for i, axis in enumerate(A.AXES):  # from the lowest free dimension up, each from the product below it
        free = (F.lit(i) >= F.col("below")) & (F.lit(i) < F.col("sort_dims"))
        step = F.when(free, F.floor(_stride(F.col("origins"), F.col("n"), F.col("timesteps"), F.col("size")) / F.col("size")).cast("int")).otherwise(1)
        d = d.withColumn(f"n_{axis}", step).withColumn("size", F.col("size") * F.col(f"n_{axis}"))
    sizes = []
    for i, axis in enumerate(A.AXES):
        n = F.when(F.lit(i) < F.col("below"), F.col("chunk_dims")[axis])
        n = n.when((F.lit(i) == F.col("sort_dims")) & (F.col("timesteps") > 1), F.col("timesteps"))
        sizes.append(n.otherwise(F.col(f"n_{axis}")).cast("int").alias(axis))
    over_time = F.when(F.col("timesteps") > 1, F.col("timesteps")).otherwise(1)
    clean = F.when(F.col("below") >= 4, F.col("n") == 1).otherwise(F.col("size") * over_time == F.col("n"))
    facts = ["image_id", F.struct(*sizes).alias("dims"), F.col("n").cast("long").alias("chunk_count"), F.col("timesteps").cast("long").alias("timesteps"), clean.alias("clean"), *[F.col(f"__c_{n}").alias(n) for n in kept]]
    if not geometry:
        return d.select(*facts)
    # only slices that are apart tell of the direction between them
    stacked = (F.col("below") == 2) & (F.col("n_s") > 1)
    ends = {"first_origin": F.when(stacked, F.get("origins", F.lit(0))), "last_origin": F.when(stacked, F.get("origins", F.col("n_s") - 1))}
    none = F.lit(None).cast("struct<x:double,y:double,z:double>")
    own = [F.col(f"__c_{n}").alias(n) if n in axes else none.alias(n) for n in GEOMETRY if n not in kept]
    return repaired_geometry(d.select(*facts, *own, F.get("origins", F.lit(0)).alias("indexOrigin"), *[c.alias(n) for n, c in ends.items()])).drop("first_origin", "last_origin")


def hoisted(chunks: DataFrame, images: DataFrame, common: tuple[str, ...]) -> DataFrame:
    """Ordered chunks without what their image has from all of them (null there now); of a map the other entries stay.

    Plain columns are settled where the headers are; only maps fetch their image's entries by a join.
    """
    kept = [f for f in chunks.schema if f.name in common]
    image = Window.partitionBy("__k", "image_id")
    d = chunks
    for f in kept:
        if f.dataType.typeName() != "map":
            same = (F.min(f.name).over(image) == F.max(f.name).over(image)) & (F.count(f.name).over(image) == F.count(F.lit(1)).over(image))
            d = d.withColumn(f.name, F.when(~F.coalesce(same, F.lit(False)), F.col(f.name)))
    maps = [f.name for f in kept if f.dataType.typeName() == "map"]
    if maps:
        d = d.join(images.select("image_id", *[F.map_entries(n).alias(f"__i_{n}") for n in maps]), "image_id", "left")
        for n in maps:
            d = d.withColumn(n, F.map_from_entries(F.array_except(F.map_entries(n), F.coalesce(f"__i_{n}", F.array().cast("array<struct<key:string,value:string>>")))))
    return d.drop(*[f"__i_{n}" for n in maps])


def assemble(chunks: DataFrame, min_dim: int = 0, equality: tuple[str, ...] = EQUALITY, secondary: str | tuple[str, ...] = "acquisitionNumber", needed: tuple[str, ...] = NEEDED, common: tuple[str, ...] = (), geometry: bool = False) -> Assembly:
    """Images of a bag of chunks, in the order of their first chunks (image_id is that chunk's arrival).

    ``min_dim`` is the lowest dimension that chunks are laid along.  The ``common`` columns go from the chunks to the image where all chunks agree (lists
    shouldn't be named: they belong to their chunk); of a map column, entry by entry.  With ``geometry`` images have directions, voxel size, gap
    and field of view, as ``repaired_geometry`` makes them.
    """
    p = placed(chunks, equality, secondary, needed)
    o = ordered(p)
    internal = ["__k", "__g", "__by", "__key", "__p", "__v", "__dup", "depth", "rectangular"]
    invalid = chunks.filter(~valid_chunks(chunks, needed)).select("arrival", F.lit("invalid").alias("reason"))
    broken = p.filter("not rectangular").select("arrival", F.when(F.col("image_id").isNull(), "no property to sort by").otherwise("not rectangular").alias("reason"))
    images = image_table(o, min_dim, common, geometry)
    return Assembly((hoisted(o, images, common) if common else o).drop(*internal), images, invalid.unionAll(broken))


def repaired_geometry(images: DataFrame) -> DataFrame:
    """Images with normalised directions, usable voxel sizes, slice direction, gap and field of view.

    Reads image_id, dims, rowVec, columnVec, sliceVec, voxelSize, voxelGap, and first_origin, last_origin (of the lowest and
    highest position).  A zero direction becomes the unit vector of its axis; a voxel size of 0 or infinity 1; a missing
    slice direction runs from first to last origin, or else is the cross product; an unknown gap along the slices
    follows from that distance.
    """
    usable = lambda x: F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), 1.0).otherwise(x)
    d = images.withColumns(
        {
            "rowVec": G.struct(G.normalized(F.col("rowVec"), G.vector(1, 0, 0))),
            "columnVec": G.struct(G.normalized(F.col("columnVec"), G.vector(0, 1, 0))),
            "voxelSize": G.struct(G.each(usable, F.col("voxelSize"))),
            "__span": G.struct(G.subtract(F.col("last_origin"), F.col("first_origin"))),
        }
    )
    given, span, normal = F.col("sliceVec"), F.col("__span"), G.cross(F.col("rowVec"), F.col("columnVec"))
    own = given.isNotNull() & (G.length(given) > 0)
    pick = lambda g, s, n, z: F.when(own, g).otherwise(F.coalesce(s, n, z))
    d = d.withColumn("sliceVec", G.struct(G.each(pick, G.normalized(given), G.normalized(span), G.normalized(normal), G.vector(0, 0, 1))))
    apart = G.length(span) / F.nullif(F.col("dims")["s"] - 1, F.lit(0)) - F.col("voxelSize")["z"]
    gap = G.each(lambda x: F.coalesce(x, F.lit(0.0)), F.col("voxelGap"))
    found = F.when(F.col("voxelGap").isNull() & (F.col("dims")["s"] > 1) & (apart > 1e-6), apart).otherwise(gap["z"])
    d = d.withColumn("voxelGap", G.struct(G.vector(gap["x"], gap["y"], found))).drop("__span")
    return d.withColumn("fov", A.field_of_view(F.col("dims"), F.col("voxelSize"), F.col("voxelGap")))
