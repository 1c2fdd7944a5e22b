import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from catalumen.operators import pipeline, reports
from catalumen.sources import kernels, listing, scan, sinks
from catalumen.sources.snapshots import Catalog
from catalumen.streaming.ingest import arrivals, stream_into


def tiff_block(model=b"cam  \0", date=b"2020:01:02 03:04:05\0"):
    head = b"II*\0" + struct.pack("<I", 8)
    data_at = 8 + 2 + 12 * 2 + 4
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x0110, 2, len(model), data_at) + struct.pack("<HHII", 0x8769, 4, 1, data_at + len(model)) + struct.pack("<I", 0)
    exif_at = data_at + len(model)
    exif = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(date), exif_at + 18) + struct.pack("<I", 0)
    return head + ifd + model + exif + date


def jpeg(width=2000, height=1000):
    body = b"Exif\0\0" + tiff_block()
    size = struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">H", len(size) + 2) + size + b"\xff\xd9"


def png(pixels):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes(r) for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def movie():
    mvhd = b"\0\0\0\0" + struct.pack(">IIII", 3_660_779_045, 0, 1000, 5000) + b"\0" * 80
    box = struct.pack(">I", 8 + len(mvhd)) + b"mvhd" + mvhd
    return struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8 + len(box)) + b"moov" + box


def psd(name="pic.jpg"):
    raw = (name + "\0").encode("utf-16-be")
    return b"8BPS" + b"\0" * 22 + b"liFD" + struct.pack(">I", 7) + b"\x03abc" + struct.pack(">I", len(raw) // 2) + raw


@pytest.fixture
def tree(tmp_path):
    files = {"src/img.jpg": jpeg(), "src/copy of img.jpg": jpeg(), "src/img.dng": tiff_block(), "src/img.xmp": b"x", "src/img.psd": psd(), "src/clip.mp4": movie(), "src/skip/skip.txt": b"s", "src/a/b.bin": b"b", "src/._img.jpg": b"r"}
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_kernels(tmp_path):
    p = str(tmp_path / "x")
    open(p, "wb").write(jpeg())
    assert kernels.image_head(p)[1:] == (2000, 1000)
    assert kernels.exif(p) == {"date": "2020:01:02 03:04:05", "camera": "cam", "lens": None}
    open(p, "wb").write(movie())
    assert kernels.movie_head(p) == {"encoded_date": "2020-01-02 03:04:05 UTC", "duration": "5000"}
    open(p, "wb").write(psd("bild ü.jpg"))
    assert kernels.embedded_names(p) == ["bild ü.jpg"]
    grey = [[(x * y) % 256 for x in range(64)] for y in range(48)]
    open(p, "wb").write(png(grey))
    a = kernels.picture_hash(p)
    open(p, "wb").write(png([[min(255, v + 3) for v in r] for r in grey]))
    assert bin(int(a, 16) ^ int(kernels.picture_hash(p), 16)).count("1") <= 5
    open(p, "wb").write(b"")
    assert kernels.image_head(p) == ({}, None, None) and kernels.picture_hash(p) is None and kernels.movie_head(p) == {}


def late_tiff(gap=1 << 20):
    """A TIFF whose directories and values follow its strip data, far from each other."""
    model, date, lens = b"cam late\0", b"2020:01:02 03:04:05\0", b"lens late\0"
    ifd_at = 8 + gap
    model_at = ifd_at + 2 + 12 * 4 + 4
    exif_at = model_at + len(model) + gap
    date_at = exif_at + 2 + 12 * 2 + 4
    entry = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
    ifd = struct.pack("<H", 4) + entry(0x0100, 4, 1, 900) + entry(0x0101, 4, 1, 600) + entry(0x0110, 2, len(model), model_at) + entry(0x8769, 4, 1, exif_at) + b"\0" * 4
    exif = struct.pack("<H", 2) + entry(0x9003, 2, len(date), date_at) + entry(0xA434, 2, len(lens), date_at + len(date)) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", ifd_at) + b"\1" * gap + ifd + model + b"\1" * gap + exif + date + lens


def test_late_tiff_directories(spark, tmp_path):
    for name in ("late.tif", "late.dng"):
        (tmp_path / name).write_bytes(late_tiff())
        assert kernels.image_head(str(tmp_path / name))[1:] == (900, 600)
    rows = scan.scan(spark, str(tmp_path), dialect="v1").collect()
    assert {(r.camera_model, r.lens_model, str(r.capture_datetime)) for r in rows} == {("cam late", "lens late", "2020-01-02 03:04:05")}
    assert {(r.orig_name, r.width, r.height) for r in rows} == {("late.tif", 900, 600), ("late.dng", None, None)}
    (tmp_path / "cut.tif").write_bytes(late_tiff()[: 9 + (1 << 20)])
    assert kernels.image_head(str(tmp_path / "cut.tif")) == ({}, None, None)


def test_listing(spark, tree):
    skips = spark.createDataFrame([(str(tree / "src/skip"),)], "skip_dir string")
    rows = listing.list_files(spark, str(tree / "src"), skips)
    got = [os.path.relpath(r.path, tree / "src") for r in rows.orderBy("order_key").collect()]
    assert got == ["._img.jpg", "clip.mp4", "copy of img.jpg", "img.dng", "img.jpg", "img.psd", "img.xmp", "a/b.bin"]
    (tree / "skip.txt").write_text("# all\n\nskip # here\n/abs\n")
    assert {r[0] for r in listing.skip_list(spark, str(tree / "skip.txt"), "/r/").collect()} == {"/r/skip", "/abs"}
    assert {r[0] for r in listing.skip_list(spark, str(tree / "skip.txt")).collect()} == {"skip", "/abs"}


def test_unknown_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Orig_Path,size_bytes\n/images/a.dng,10\n/images/a.dng,10\n")
    assert [r[0] for r in listing.unknown_paths(spark, str(tmp_path / "u.csv")).collect()] == ["/images/a.dng"]
    assert listing.unknown_paths(spark, str(tmp_path / "none.csv")).count() == 0


def test_scan(spark, tree):
    rows = {r.orig_name: r for r in scan.scan(spark, str(tree / "src"), least=100).collect()}
    assert rows["img.jpg"].camera_model == "cam" and str(rows["img.jpg"].capture_datetime) == "2020-01-02 03:04:05"
    assert rows["clip.mp4"].duration_sec == 5.0 and rows["._img.jpg"].type == "other" and rows["img.jpg"].width is None
    # the second file of a known sparse hash gets its full hash
    assert rows["copy of img.jpg"].hash is None and rows["img.jpg"].hash is not None
    assert rows["copy of img.jpg"].sparse_hash == rows["img.jpg"].sparse_hash
    old = {r.orig_name: r for r in scan.scan(spark, str(tree / "src"), dialect="v1").collect()}
    assert (old["img.jpg"].width, old["img.jpg"].height) == (2000, 1000) and old["._img.jpg"].type == "jpeg"


def test_scan_videos(spark, tmp_path, monkeypatch):
    src = tmp_path / "2019-05-06"
    src.mkdir()
    undated = movie().replace(struct.pack(">IIII", 3_660_779_045, 0, 1000, 5000), struct.pack(">IIII", 0, 0, 1000, 0))
    for name, data in {"clip.mp4": movie(), "fragments.mp4": undated, "a.avi": b"RIFF", "b.mts": b"G", "c.mpg": b"\0\0\1", "broken.avi": b"x"}.items():
        (src / name).write_bytes(data)
        os.utime(src / name, (1_500_000_000, 1_500_000_000))
    scanned = lambda **k: {r.orig_name: (str(r.capture_datetime), r.duration_sec, r.camera_model) for r in scan.scan(spark, str(src), **k).collect()}
    v1 = scanned(dialect="v1", zone="Asia/Tokyo")
    assert v1["clip.mp4"] == ("2020-01-02 12:04:05", 5.0, None) and v1["a.avi"] == ("2019-05-06 00:00:00", None, None)
    # a stand-in for exiftool, found on the workers' path
    tool = tmp_path / "bin/exiftool"
    tool.parent.mkdir()
    tool.write_text("""#!/bin/sh
[ "$1 $2" = "-j -n" ] || exit 2
case "$3" in
*broken.avi) echo 'Error: unknown type' >&2; exit 1;;
*) echo '[{"SourceFile": "x", "CreateDate": "2018:03:04 05:06:07", "Duration": 12.5, "Model": "TapeCam"}]';;
esac
""")
    tool.chmod(0o755)
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", f"{tool.parent}:{os.environ['PATH']}")
    v2 = scanned()
    told, clock = ("2018-03-04 05:06:07", 12.5, "TapeCam"), ("2017-07-14 02:40:00", None, None)
    assert v2 == {"clip.mp4": ("2020-01-02 03:04:05", 5.0, None), "fragments.mp4": told, "a.avi": told, "b.mts": told, "c.mpg": told, "broken.avi": clock}
    assert scanned(dialect="v1", zone="UTC")["a.avi"] == v1["a.avi"]  # v1 has no other tool


def test_organize(spark, tree):
    cat = Catalog(spark, str(tree / "cat"))
    with pytest.raises(FileNotFoundError):
        Catalog(spark, str(tree / "nowhere"), must_exist=True)
    records = scan.scan(spark, str(tree / "src"))
    pipeline.ingest(cat, records)
    files = {r.orig_name: r for r in cat.table("files").collect()}
    assert len(files) == 8 and "copy of img.jpg" not in files
    assert cat.table("file_occurrences").count() == 9
    pipeline.ingest(cat, records)  # again changes nothing but times
    again = {r.orig_name: r for r in cat.table("files").collect()}
    assert {k: v.id for k, v in again.items()} == {k: v.id for k, v in files.items()} and cat.table("file_occurrences").count() == 9
    pipeline.link(cat, scan.embedded_references(spark, cat.table("files").filter("type = 'psd'")))
    assert [tuple(r) for r in cat.table("raw_sidecars").collect()] == [(files["img.dng"].id, files["img.xmp"].id)]
    pipeline.plan(cat, str(tree / "out"))
    dest = {r.orig_name: r.dest_path for r in cat.table("files").collect()}
    assert dest["img.dng"].endswith("/raw/2020/2020-01/img_2020-01-02_03-04-05.dng") and dest["img.psd"].endswith("/output/2020/2020-01/img.psd")
    assert dest["img.xmp"].endswith("/raw/2020/2020-01/img_2020-01-02_03-04-05.xmp") and not os.path.exists(tree / "out")
    dry = sinks.move_files(cat.table("files"), dry_run=True)
    assert {r.status for r in dry.collect()} == {"pending"}
    made = sinks.move_files(cat.table("files")).collect()
    assert {r.status for r in made} == {"copied"} and all(os.path.exists(r.dest_path) for r in made)
    assert {r.status for r in sinks.move_files(cat.table("files")).collect()} == {"present"}
    occ = sinks.moved_occurrences(spark.createDataFrame(made), cat.table("files")).collect()
    assert {r.path for r in occ} == {r.dest_path for r in made} and not any(r.hash_is_sparse for r in occ)
    listing_ = records.select(F.col("orig_path").alias("path"), "hash")
    status = {os.path.basename(r.path): r.status for r in reports.source_report(listing_, cat.table("files"), cat.table("file_occurrences")).collect()}
    assert status["img.jpg"] == "Scheduled Copy/Move" or status["copy of img.jpg"] == "Scheduled Copy/Move"
    assert status["b.bin"] == "Indexed (Ignored Type)" and sorted([status["img.jpg"], status["copy of img.jpg"]]) == ["Duplicate", "Scheduled Copy/Move"]
    sinks.write_report(reports.copy_report(cat.table("file_occurrences"), cat.table("files")), "copy", str(tree / "report"))
    assert spark.read.csv(str(tree / "report"), header=True).columns == ["path", "type", "is_seed", "status", "dest_path", "duplicate_of", "hash"]


def test_stream(spark, tree):
    records = scan.scan(spark, str(tree / "src")).withColumn("scanned_at", F.timestamp_seconds("mtime"))
    records.repartition(3).write.parquet(str(tree / "stream"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tree / "stream"))
    cat = Catalog(spark, str(tree / "cat2"))
    stream_into(cat, stream.drop("scanned_at"), str(tree / "cp")).awaitTermination()
    assert cat.table("files").count() == 8 and cat.table("file_occurrences").count() == 9
    q = arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tree / "cp2")).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(records) FROM arrivals").head()[0] == 9


def test_command_line(spark, tree, capsys):
    from catalumen import __main__ as cli

    cat = Catalog(spark, str(tree / "cat3"))
    pipeline.ingest(cat, scan.scan(spark, str(tree / "src")))
    assert cli.main(["query", "--db", str(tree / "cat3"), "--unprocessed-raws"]) == 0
    assert cli.main(["query", "--db", str(tree / "cat3"), "--raw-path", str(tree / "src/img.dng")]) == 0
    assert cli.main(["query", "--db", str(tree / "cat3"), "--raw-id", "999"]) == 1
    (tree / "o.log").write_text("No EXIF tags found for /x.jpg\n")
    assert cli.main(["issues", "--log", str(tree / "o.log"), "--out", str(tree / "iss")]) == 0
    assert "img.dng" in capsys.readouterr().out


def test_diagnostic_and_inspector(spark, tree, capsys):
    from catalumen import __main__ as cli
    from catalumen.sources import diagnostics

    rows = diagnostics.video_diagnostic(spark, str(tree / "src")).collect()
    assert [(r.file, r.tool) for r in rows] == [("clip.mp4", t) for t in ("mediainfo", "ffprobe", "exiftool")]
    assert rows[0].capture_datetime == "2020-01-02 03:04:05 UTC" and rows[0].duration_sec == "5.0"
    tags = spark.createDataFrame([("f", "General", {"Device_Model": "X", "empty": "", "long": "y" * 70})], "file string, track string, tags map<string,string>")
    got = {r.tag: (r.value, r.about_camera) for r in diagnostics.tag_rows(tags).collect()}
    assert got == {"Device_Model": ("X", True), "long": ("y" * 57 + "...", False)}
    assert cli.main(["inspect", str(tree / "src/clip.mp4")]) == 0
    assert "encoded_date" in capsys.readouterr().out


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_user_data_of_movies(tmp_path):
    p = str(tmp_path / "x.mov")
    mvhd = box(b"mvhd", b"\0\0\0\0" + struct.pack(">IIII", 3_660_779_045, 0, 1000, 5000) + b"\0" * 80)
    text = lambda t: struct.pack(">HH", len(t), 0) + t
    open(p, "wb").write(box(b"ftyp", b"qt  \0\0\0\0") + box(b"moov", mvhd + box(b"udta", box(b"\xa9mod", text(b"Cam 7")) + box(b"\xa9swr", text(b"1.0")))))
    assert kernels.movie_head(p) == {"encoded_date": "2020-01-02 03:04:05 UTC", "duration": "5000", "device_model": "Cam 7", "encoded_library": "1.0"}
    key = b"com.apple.quicktime.creationdate"
    keys = box(b"keys", b"\0\0\0\0" + struct.pack(">I", 1) + struct.pack(">I", 8 + len(key)) + b"mdta" + key)
    ilst = box(b"ilst", box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0) + b"2020-01-02T03:04:05+0200")))
    hdlr = box(b"hdlr", b"\0" * 8 + b"mdta" + b"\0" * 12)
    for wrap in (box(b"meta", hdlr + keys + ilst), box(b"udta", box(b"meta", b"\0\0\0\0" + hdlr + keys + ilst))):
        open(p, "wb").write(box(b"moov", mvhd + wrap))
        assert kernels.movie_head(p)["recorded_date"] == "2020-01-02T03:04:05+0200"
    for cut in range(0, os.path.getsize(p), 7):  # a file that breaks off is read as far as it goes
        open(str(tmp_path / "y.mov"), "wb").write(open(p, "rb").read()[:cut])
        kernels.movie_head(str(tmp_path / "y.mov"))


def test_avi_head(tmp_path):
    part = lambda k, d: k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    avih = part(b"avih", struct.pack("<5I", 40_000, 0, 0, 0, 250) + b"\0" * 36)
    body = b"AVI " + part(b"LIST", b"hdrl" + avih + part(b"IDIT", b"Thu Jan 02 03:04:05 2020\n\0")) + part(b"LIST", b"INFO" + part(b"ISFT", b"CanonMVI02\0")) + part(b"LIST", b"movi" + b"x" * 99)
    (tmp_path / "x.avi").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert kernels.movie_head(str(tmp_path / "x.avi")) == {"duration": "10000", "recorded_date": "2020-01-02 03:04:05", "encoder": "CanonMVI02"}


def test_long_embedded_names(tmp_path):
    (tmp_path / "x.psd").write_bytes(psd("n" * 5000 + ".jpg"))
    assert kernels.embedded_names(str(tmp_path / "x.psd")) == ["n" * 5000 + ".jpg"]
    (tmp_path / "x.psd").write_bytes(psd()[:-3])
    assert kernels.embedded_names(str(tmp_path / "x.psd")) == []


def test_unreadable_files_are_told(spark, tree, caplog):
    from catalumen import __main__ as cli

    os.symlink(str(tree / "nowhere"), str(tree / "src/dangling.jpg"))
    bad = tree / "src/gone.jpg"
    bad.write_bytes(b"x")
    told = []
    cat = Catalog(spark, str(tree / "cat"))
    pipeline.ingest(cat, scan.scan(spark, str(tree / "src")))
    rows = scan.scan(spark, str(tree / "src"), force_full=True, keep_unread=True, errors=lambda df: told.extend(df.collect()))
    assert told == [] and rows.filter("error is not null").count() == 0
    # what a failed read looks like in the report
    listing_ = spark.createDataFrame([("/new/lost.jpg", None, "denied"), ("/new/lost.bin", None, "denied"), (str(bad), None, "denied")], "path string, hash string, error string")
    out = reports.with_notes(reports.source_report(listing_.drop("error"), cat.table("files"), cat.table("file_occurrences")), listing_)
    assert {(os.path.basename(r.path), r.status, r.note) for r in out.collect()} == {("lost.jpg", "Error", "Hash failed: denied"), ("lost.bin", "Skipped", "Unsupported extension"), ("gone.jpg", "Indexed (No Dest)", "No destination assigned")}
    cli.log_errors(spark.createDataFrame([("/x", "denied")], "path string, error string"))
    assert "Failed to scan /x: denied" in caplog.text
    assert listing.skip_list(spark, str(tree / "no-list"), "/r").count() == 0 and "skip list not found" in caplog.text


def test_whole_runs_of_both_dialects(spark, tree):
    from catalumen import __main__ as cli

    for dialect, names in (("v1", {"unprocessed_raws.csv", "unknown_files.csv", "unlinked_psds.csv"}), ("v2", set())):
        dest = tree / dialect
        args = ["organize", str(tree / "src"), str(dest), "--dialect", dialect, "--copy-report", str(tree / f"copied-{dialect}")]
        assert cli.main(args) == 0
        cat = Catalog(spark, str(dest / "catalog"))
        planned = {r.dest_path for r in cat.table("files").filter("dest_path is not null").collect()}
        assert planned and all(os.path.exists(p) for p in planned)
        assert names <= set(os.listdir(dest))
        made = {r.path for r in cat.table("file_occurrences").collect()} & planned
        assert made == (planned if dialect == "v2" else set())
        assert cli.main([*args, "--report", "--report-csv", str(tree / f"report-{dialect}")]) == 0
        assert spark.read.csv(str(tree / f"report-{dialect}"), header=True).count() == 9
    assert spark.read.csv(str(tree / "v1/unknown_files.csv"), header=True).columns[-1] == "last_seen_at"
    assert not os.path.exists(tree / "src/moved")
