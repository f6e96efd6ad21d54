import gzip
import io
import socket
import struct
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import assemble
from lumenframe.plans import programs
from lumenframe.sources import archive, dicom, load, nifti, png, raw, vista
from lumenframe.sources.model import DTYPES, Chunk, FormatError
from lumenframe.streaming import datagrams as D


@pytest.mark.parametrize("kind", ["u8bit", "s16bit", "s32bit", "float", "double", "u16bit"])
def test_nifti_round_trip(kind):
    v = np.arange(4 * 3 * 2 * 2).astype(DTYPES[kind])
    c = Chunk(v, (4, 3, 2, 2), kind, voxelSize=(1.0, 2.0, 3.0), indexOrigin=(5.0, -6.0, 7.0), repetitionTime=2000.0, props={"key": "value"})
    got = nifti.decode(nifti.encode([c], extension=True))[0]
    assert (got.voxels == v).all() and got.dims == c.dims and got.type_id == kind and got.indexOrigin == c.indexOrigin and got.rowVec == c.rowVec
    assert np.allclose(got.voxelSize, c.voxelSize) and got.repetitionTime == 2000.0 and got.props["key"] == "value"
    big = bytearray(nifti.encode([c]))
    with pytest.raises(FormatError):
        nifti.decode(bytes(big[:100]))


def test_nifti_slices_and_orders():
    v = np.arange(2 * 2 * 4, dtype="i2")
    data = bytearray(nifti.encode([Chunk(v, (2, 2, 4, 1), "s16bit")]))
    data[122] = 3
    parts = nifti.decode(bytes(data), "slices")
    assert [c.acquisitionNumber for c in parts] == [0, 2, 1, 3] and (np.concatenate([c.voxels for c in parts]) == v).all()
    for code in nifti.ORDERS:
        assert nifti.order_code([float(x) for x in nifti.acquisition_order(code, 7)]) == code
    assert nifti.parse_spm_description(nifti.spm_description(2000, 30, 90)) == {"repetitionTime": 2000, "echoTime": 30, "flipAngle": 90}


def test_png():
    for kind, top in (("u8bit", 255), ("u16bit", 65535)):
        c = Chunk(np.linspace(0, top, 20).astype(DTYPES[kind]), (5, 4, 1, 1), kind)
        assert (png.decode(png.encode(c), "stacked", "/x/slice007.png")[0].voxels == c.voxels).all()
    assert png.decode(png.encode(c), "stacked", "/x/slice007.png")[0].acquisitionNumber == 7
    # every row filter, made by hand
    rows = np.array([[10, 20, 30], [11, 22, 33], [12, 21, 35], [9, 19, 31], [1, 2, 3]], np.uint8)
    import zlib

    body, before = b"", np.zeros(3, int)
    for kind, row in enumerate(rows.astype(int)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [np.zeros(3, int), left, before, (left + before) // 2, near][kind]
        body += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    block = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = png.SIGNATURE + block(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + block(b"IDAT", zlib.compress(body)) + block(b"IEND", b"")
    assert (png.decode(data)[0].voxels.reshape(5, 3) == rows).all()


def test_raw_vista_and_archives():
    assert raw.decode(bytes(range(16)))[0].dims == (4, 4, 1, 1)
    with pytest.raises(FormatError):
        raw.decode(bytes(15))
    assert raw.view(b"\x01\x02", "u16bit", swap=True)[0] == 0x0102
    c = Chunk(np.arange(24, dtype="i2"), (4, 3, 1, 2), "s16bit", repetitionTime=2.0)
    got = vista.decode(vista.encode([c, c]))
    assert len(got) == 2 and got[0].dims == (4, 3, 1, 2) and (got[0].voxels == c.voxels).all()
    assert len(vista.decode(vista.encode([c, c]), "onlyfirst")) == 1
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name in ("a.raw", "b.raw"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"abcd"))
    assert [n for n, _ in archive.members("x.tar.gz", buffer.getvalue())] == ["x.tar.gz/a.raw", "x.tar.gz/b.raw"]
    assert list(archive.members("a.raw.gz", gzip.compress(b"abcd"))) == [("a.raw", b"abcd")]


def element(group, tag, vr, body):
    body += b" " * (len(body) % 2)
    long = vr in (b"OB", b"OW", b"SQ")
    return struct.pack("<2H", group, tag) + vr + (b"\0\0" + struct.pack("<I", len(body)) if long else struct.pack("<H", len(body))) + body


def test_dicom_and_mosaic():
    tiles = np.arange(4 * 6, dtype="u2").reshape(4, 2, 3)
    sheet = tiles.reshape(2, 2, 2, 3).transpose(0, 2, 1, 3).reshape(4, 6)
    us = lambda v: struct.pack("<H", v)
    data = bytes(128) + b"DICM" + element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + element(8, 8, b"CS", b"ORIGINAL\\PRIMARY\\MOSAIC") + element(0x10, 0x1010, b"AS", b"042Y") + element(0x19, 0x100A, b"US", us(4))
    data += element(0x20, 0x11, b"IS", b"7") + element(0x20, 0x32, b"DS", b"1\\2\\3") + element(0x28, 0x10, b"US", us(4)) + element(0x28, 0x11, b"US", us(6)) + element(0x28, 0x30, b"DS", b"2\\1") + element(0x28, 0x100, b"US", us(16)) + element(0x7FE0, 0x10, b"OW", sheet.astype("<u2").tobytes())
    c = dicom.decode(data)[0]
    assert c.dims == (3, 2, 4, 1) and (c.voxels == tiles.reshape(-1)).all() and c.sequenceNumber == 7 and c.props["subjectAge"] == "042Y" and c.voxelSize[:2] == (1.0, 2.0)
    assert c.indexOrigin == (1 + 1.5, 2 + 2.0, 3.0)
    with pytest.raises(FormatError):
        dicom.decode(b"nothing")


def test_load_assemble_write_and_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(0)
    for s in range(3):
        c = Chunk(rng.integers(0, 200, 16).astype("u1"), (4, 4, 1, 1), "u8bit", sequenceNumber=0, acquisitionNumber=s, indexOrigin=(0.0, 0.0, float(s)))
        (tmp_path / "in" / f"slice{s}.nii.gz").write_bytes(archive.compress("x.gz", nifti.encode([c])))
    (tmp_path / "in" / "broken.nii").write_bytes(b"no image")
    (tmp_path / "in" / "notes.txt").write_text("nothing to read")
    chunks = load.load(spark, str(tmp_path / "in"))
    assert chunks.count() == 3
    assert sorted(r.source.rsplit("/", 1)[1] for r in load.failures(spark, str(tmp_path / "in")).collect()) == ["broken.nii", "notes.txt"]
    a = assemble.assemble(chunks)
    assert tuple(a.images.first().dims) == (4, 4, 3, 1)
    (tmp_path / "out").mkdir()
    done = programs.store(a.chunks, str(tmp_path / "out"), "S{%d_sequenceNumber}.nii.gz").collect()
    assert [(r.file_name, r.error) for r in done] == [("S00000.nii.gz", None)]
    again = load.load(spark, str(tmp_path / "out")).first()
    want = [x for r in a.chunks.orderBy("lookup").collect() for x in r.voxels]
    assert again.voxels == want
    spark.dataSource.register(load.ChunkSource)
    assert spark.read.format("chunks").load(str(tmp_path / "out")).count() == 1
    pngs = load.write(chunks.withColumn("file_name", F.concat(F.lit("p"), F.col("indexOrigin.z").cast("int").cast("string"), F.lit(".png"))), str(tmp_path / "out"), order="arrival").collect()
    assert all(r.error is None for r in pngs) and load.load(spark, str(tmp_path / "out"), dialect="stacked").count() == 3
    refused = load.write(a.chunks.withColumn("file_name", F.lit("all.png")), str(tmp_path / "out")).first()
    assert "one slice" in refused.error
    names = tmp_path / "list.txt"
    names.write_text("\n".join(str(tmp_path / "in" / f"slice{s}.nii.gz") for s in range(2)))
    assert load.load_list(spark, str(names)).count() == 2
    with pytest.raises(PermissionError):
        load.load_process(spark, ["ls"])
    assert load.load_process(spark, ["cat", str(names)], allowed=True).count() == 2


def test_programs(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for s in range(2):
        c = Chunk(np.arange(16, dtype="u1") + s, (4, 4, 1, 1), "u8bit", indexOrigin=(0.0, 0.0, float(s)), acquisitionNumber=s)
        (tmp_path / "in" / f"s{s}.nii").write_bytes(nifti.encode([c]))
    (tmp_path / "out").mkdir()
    where = ["--in", str(tmp_path / "in"), "--out", str(tmp_path / "out")]
    assert programs.main(["calc", *where, "--voxelop", "vox * 2 + pos_x", "--name", "calc.nii"], spark) == 0
    got = nifti.decode((tmp_path / "out" / "calc.nii").read_bytes())[0]
    assert got.type_id == "double" and got.voxels[5] == 5 * 2 + 1
    assert programs.main(["flip", *where, "--along", "c", "--name", "flip.nii"], spark) == 0
    assert nifti.decode((tmp_path / "out" / "flip.nii").read_bytes())[0].voxels[0] == 3
    assert programs.main(["diff", "--in", str(tmp_path / "in"), "--in2", str(tmp_path / "in")], spark) == 0
    assert "0 properties" in capsys.readouterr().out


def test_feed_is_put_together(spark, tmp_path):
    sheet = np.arange(24, dtype="<u2").tobytes()
    header = lambda n, size=48: f"<data_block_header>\nacquisition = {n}\ncolumns = 3\nrows = 2\nimages = 4\ndata_size_in_bytes = {size}\n".encode()
    rows = [("a", 0, header(1)), ("b", 1, header(9)), ("a", 2, sheet[:20]), ("b", 3, sheet[:4]), ("a", 4, sheet[20:]), ("a", 5, header(2)), ("a", 6, header(3)), ("a", 7, sheet), ("b", 8, b"<series_finished>"), ("c", 9, b"stray")]
    spark.createDataFrame([(s, k, bytearray(p)) for s, k, p in rows], "sender string, seq long, payload binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender string, seq long, payload binary").parquet(str(tmp_path / "in"))
    q = D.reassemble(stream, timeout_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.sender, r.acquisition): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r.complete for k, r in got.items()} == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 9): False}
    want = D.untile(np.arange(24.0), 3, 2, 4)
    assert got["a", 1].voxels == want.tolist() and got["a", 2].voxels is None


def test_datagrams_are_received_in_order():
    reader = D._DatagramReader({"port": "54399"})
    assert reader.initialOffset() == {"seq": 0} and list(reader.read({"seq": 0})[0]) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for k in range(3):
            s.sendto(bytes([k]), ("127.0.0.1", 54399))
    time.sleep(0.2)
    rows, end = reader.read({"seq": 0})
    assert [r[2] for r in rows] == [b"\0", b"\1", b"\2"] and end == {"seq": 3}
    assert len(list(reader.readBetweenOffsets({"seq": 1}, {"seq": 3}))) == 2
    reader.commit({"seq": 3})
    assert not reader.kept
    reader.socket.close()
    assert D.parse_header(b"<data_block_header>\n a = 1 \nb=x y\n") == {"a": "1", "b": "x y"}
    assert F is not None


def test_unreadable_members_and_batches(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/x.tar", "w") as t:
        for name, body in (("a.raw", b"abcd"), ("bad.raw", b"abc"), ("c.raw", bytes(range(16)))):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    rows = sorted(load.scan(spark, str(tmp_path)).collect(), key=lambda r: r.part)
    assert [r.voxels for r in rows] == [[97.0, 98.0, 99.0, 100.0], [float(k) for k in range(16)], None]
    assert [r.error is None for r in rows] == [True, True, False] and "bad.raw" in rows[2].error
    assert load.load(spark, str(tmp_path)).count() == 2 and load.failures(spark, str(tmp_path)).count() == 1
    spark.dataSource.register(load.ChunkSource)
    source = spark.read.format("chunks")
    assert source.option("ignoreErrors", "true").load(str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="bad.raw"):
        source.option("ignoreErrors", "false").load(str(tmp_path)).collect()


def test_long_dicom_values_are_whole():
    body = bytes(range(200))
    got, _ = dicom.tags(bytes(128) + b"DICM" + element(0x0029, 0x1010, b"OB", body) + element(0x0010, 0x0010, b"PN", b"name"))
    assert got["(0029,1010)"] == body.hex()


def test_voxels_as_arrow():
    head = Chunk(np.arange(4, dtype="i2"), (4, 1, 1, 1), "s16bit", props={"k": "v"}).head("s", 0)
    none = (("s", 1, *[None] * (len(head) - 2)), None, "why")
    empty = (head, np.zeros(0, "u1"), None)
    got = load._arrow([none, (head, np.arange(4, dtype="i2"), None), empty, none]).to_pylist()
    assert [r["voxels"] for r in got] == [None, [0.0, 1.0, 2.0, 3.0], [], None] and [r["error"] for r in got] == ["why", None, None, "why"]
    assert load._arrow([none]).to_pylist()[0]["voxels"] is None and dict(got[1]["props"]) == {"k": "v"}
