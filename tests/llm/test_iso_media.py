import struct

from tallyloom.llm import iso_media as M


def test_round_trip_and_ranges():
    for payload in (b"", b"a", b"x" * 64, bytes(range(256)) * 9, b"q" * 20_000):
        data = M.write_container(payload)
        row, stored = M.facts(data)
        assert stored == M.padded(payload) and row["error"] is None
        track = row["tracks"][0]
        assert track["codec"] == "raw" and track["handler"] == "soun"
        assert track["samples"] == len(stored) // 64 and track["duration_s"] == len(stored) / 8000
        for i, k in enumerate(track["keyframes"]):
            assert data[k["start"] : k["end"]] == stored[i * 1024 : i * 1024 + 64]


def _file(sizes, wide=False, sync=(1, 3)):
    """A video track with samples of several sizes in two chunks after a gap, moov first."""
    body = b"".join(bytes([65 + i]) * n for i, n in enumerate(sizes))
    split = sum(sizes[:2])

    def moov(base):
        chunks = (base, base + split + 5)
        offsets = M.full_box(b"co64", struct.pack(">IQQ", 2, *chunks)) if wide else M.full_box(b"stco", struct.pack(">III", 2, *chunks))
        table = M.box(
            b"stbl",
            M.full_box(b"stsd", struct.pack(">I", 1), M.box(b"avc1", bytes(8))),
            M.full_box(b"stts", struct.pack(">III", 1, len(sizes), 10)),
            M.full_box(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, len(sizes) - 2, 1)),
            M.full_box(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
            offsets,
            M.full_box(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        )
        head = M.full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, 30, 10 * len(sizes), 0, 0), version=1)
        return M.box(b"moov", M.box(b"trak", M.box(b"mdia", head, M.full_box(b"hdlr", bytes(4), b"vide", bytes(12)), M.box(b"minf", table))))

    start = M.box(b"ftyp", b"mp42", bytes(4))
    base = len(start) + len(moov(0)) + 16
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body) + 5) + body[:split] + b"?????" + body[split:]
    return start + moov(base) + media


def test_tables_with_gaps_and_wide_boxes():
    sizes = [5, 7, 11, 2, 9]
    for wide in (False, True):
        data = _file(sizes, wide)
        row, stored = M.facts(data)
        assert row["error"] is None and row["brand"] == "mp42"
        assert stored == b"".join(bytes([65 + i]) * n for i, n in enumerate(sizes))
        track = row["tracks"][0]
        assert track["codec"] == "avc1" and track["duration_s"] == 50 / 30
        assert [data[k["start"] : k["end"]] for k in track["keyframes"]] == [b"A" * 5, b"C" * 11]


def test_malformed_files_say_why():
    good = M.write_container(b"payload")
    for bad in (None, b"junk", good[:-3], good[:40], b"\0\0\0\x04ftyp", _file([5, 7, 11], sync=(1, 9))):
        row, stored = M.facts(bad)
        assert row["error"] and row["tracks"] is None and stored is None
    assert M.facts(b"")[0]["tracks"] == []


def test_columns(spark):
    rows = [(1, b"abc", "x"), (2, None, "y"), (2, None, "y"), (3, b"z" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, error_note string")
    got = M.probe(M.store(df), with_samples=True).orderBy("doc_id").collect()
    assert [bytes(r.sample_bytes) for r in got] == [M.padded(p or b"") for _, p, _ in rows]
    assert got[1].media == got[2].media and got[0].tracks[0].codec == "raw"
    assert M.probe(M.store(df.limit(0))).count() == 0


def test_columns_of_the_results_names_are_replaced(spark):
    df = spark.createDataFrame([(1, b"abc", 1, 2, 3, 4, 5, 6)], "doc_id long, payload binary, Media int, brand int, tracks int, Error int, sample_bytes int, codec int")
    got = M.probe(M.store(df), with_samples=True)
    assert got.columns == ["doc_id", "codec", "media", "brand", "tracks", "error", "sample_bytes"]
    row = got.first()
    assert (row.codec, row.brand, row.error, bytes(row.sample_bytes)) == (6, "isom", None, M.padded(b"abc"))
