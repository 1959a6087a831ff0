"""Binary contact maps built by hand, value by value, in three versions."""

import http.server
import re
import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sinks import contact_file as sink
from tessera.sources import contact_file

NAN = float("nan")


def text(s):
    return s.encode() + b"\0"


def dense(version, short):
    """Two rows of three bins from (10, 20) on, one cell missing."""
    head = struct.pack("<iii", 5, 10, 20) + bytes([0 if short else 1]) + (bytes([0, 0]) if version > 8 else b"") + bytes([2])
    cells = struct.pack("<6h", 1, 2, -32768, 4, 5, 6) if short else struct.pack("<6f", 1, 2, NAN, 4, 5, 6.5)
    return head + struct.pack("<ih", 6, 3) + cells


def listed(version, short, wide_x, wide_y):
    """(3, 4): 7, (6, 4): 8, (3, 9): 9, relative to (1, 2)."""
    x, y, c = "i" if wide_x else "h", "i" if wide_y else "h", "h" if short else "f"
    head = struct.pack("<iii", 3, 1, 2) + bytes([0 if short else 1]) + (bytes([wide_x, wide_y]) if version > 8 else b"") + bytes([1])
    return head + struct.pack(f"<{y}", 2) + struct.pack(f"<{y}{x}{x}{c}{x}{c}", 2, 2, 2, 7, 5, 8) + struct.pack(f"<{y}{x}{x}{c}", 7, 1, 2, 9)


def build(version, blocks, chromosomes=(("ALL", 0), ("1", 1000), ("2", 800)), pair=(1, 1), frag=False):
    size, real = ("<q", "f") if version > 8 else ("<i", "d")
    head = text("genome") + (struct.pack("<qq", 0, 0) if version > 8 else b"") + struct.pack("<i", 1) + text("k") + text("v")
    head += struct.pack("<i", len(chromosomes)) + b"".join(text(n) + struct.pack(size, s) for n, s in chromosomes)
    head += struct.pack("<ii", 1, 10) + (struct.pack("<ii", 1, 5) + struct.pack("<i", 0) + struct.pack("<i3i", 3, 7, 8, 9) + struct.pack("<i", 0) if frag else struct.pack("<i", 0))
    out = bytearray(text("HIC") + struct.pack("<iq", version, 0) + head)
    entries = []
    for number, block in blocks:
        data = zlib.compress(block)
        entries.append(struct.pack("<iqi", number, len(out), len(data)))
        out += data
    vectors = []
    for values in ([1.0, 2.0, NAN], [NAN, NAN]):
        vectors.append((len(out), values))
        out += struct.pack(size, len(values)) + struct.pack(f"<{len(values)}{real}", *values)
    at = len(out)
    record = struct.pack("<iii", *pair, 1) + text("BP") + struct.pack("<iffffiiii", 0, 12.5, 0, 0, 0, 10, 8, 16, len(entries)) + b"".join(entries)
    out += record
    master = len(out)
    expected = text("BP") + struct.pack("<i", 10) + struct.pack(size, 3) + struct.pack(f"<3{real}", 3, 2, 1) + struct.pack("<i", 1) + struct.pack(f"<i{real}", 1, 0.5)
    index = struct.pack("<i", 1) + text("{}_{}".format(*pair)) + struct.pack("<qi", at, len(record)) + struct.pack("<i", 1) + expected
    normed = struct.pack("<i", 1) + text("VC") + expected
    rows = struct.pack("<i", 2) + b"".join(text("VC") + struct.pack("<i", c) + text("BP") + struct.pack("<iq", 10, a) + struct.pack(size, 0) for c, (a, _) in zip((1, 2), vectors))
    out += struct.pack(size, len(index)) + index + normed + rows
    struct.pack_into("<q", out, 8, master)
    return bytes(out)


def write(tmp_path, data, name="a.hic"):
    path = tmp_path / name
    path.write_bytes(data)
    return "file://" + str(path)


LIST = {(3, 4, 7.0), (6, 4, 8.0), (3, 9, 9.0)}


@pytest.mark.parametrize("version", [6, 8, 9])
def test_blocks_of_all_kinds(spark, tmp_path, version):
    old = struct.pack("<i", 2) + struct.pack("<iif", 3, 4, 1.5) + struct.pack("<iif", 5, 6, 2.0)
    if version == 6:
        cases = [(old, {(3, 4, 1.5), (5, 6, 2.0)})]
    else:
        cases = [(dense(version, True), {(10, 20, 1.0), (11, 20, 2.0), (10, 21, 4.0), (11, 21, 5.0), (12, 21, 6.0)}), (dense(version, False), {(10, 20, 1.0), (11, 20, 2.0), (10, 21, 4.0), (11, 21, 5.0), (12, 21, 6.5)})]
        cases += [(listed(version, short, x, y), LIST) for short in (True, False) for x in (False, True) for y in (False, True) if version > 8 or not (x or y)]
    for i, (block, want) in enumerate(cases):
        path = write(tmp_path, build(version, [(0, block)]), f"{version}-{i}.hic")
        got = contact_file.read(spark, path).collect()
        assert {(r["bin_x"], r["bin_y"], r["counts"]) for r in got} == want and len(got) == len(want)
        assert {(r["chr1_idx"], r["chr2_idx"], r["unit"], r["bin_size"]) for r in got} == {(1, 1, "BP", 10)}


@pytest.mark.parametrize("version", [8, 9])
def test_metadata_and_vectors(spark, tmp_path, version):
    path = write(tmp_path, build(version, [(0, listed(version, True, 0, 0))], frag=True))
    table = lambda t: [tuple(r) for r in contact_file.read(spark, path, t).collect()]
    assert table("chromosomes") == [(0, "ALL", 0), (1, "1", 1000), (2, "2", 800)]
    assert table("resolutions") == [("BP", 10), ("FRAG", 5)] and table("attributes") == [("k", "v")]
    assert table("matrices") == [(1, 1, "BP", 10, 12.5, 8, 16, 1)]
    got = table("norm_vectors")
    assert got[:2] == [("VC", 1, "BP", 10, 0, 1.0), ("VC", 1, "BP", 10, 1, 2.0)] and len(got) == 3  # chromosome 2 has no number
    assert sorted(table("expected")) == sorted((n, "BP", 10, i, v) for n in ("NONE", "VC") for i, v in enumerate([3.0, 2.0, 1.0]))
    assert sorted(table("expected_factors")) == [("NONE", "BP", 10, 1, 0.5), ("VC", "BP", 10, 1, 0.5)]
    assert table("fragments") == [(1, 0, 7), (1, 1, 8), (1, 2, 9)]
    part = contact_file.read(spark, path, "expected").where("norm = 'VC' AND dist >= 1 AND dist < 2").collect()
    assert [(r["dist"], r["value"]) for r in part] == [(1, 2.0)]


def test_what_is_no_map_is_an_error(spark, tmp_path):
    for data in (b"HID\0aaaaaaaaaa", b"", build(8, [])[:4] + struct.pack("<i", 5) + build(8, [])[8:], build(9, [])[:4] + struct.pack("<i", 10) + build(9, [])[8:]):
        with pytest.raises(Exception, match="not a contact map|is not one of"):
            contact_file.read(spark, write(tmp_path, data, "bad.hic")).collect()
    with pytest.raises(Exception, match="is none of"):
        contact_file.read(spark, write(tmp_path, build(8, [])), "maps").collect()
    assert contact_file.read(spark, write(tmp_path, build(8, []))).count() == 0


@pytest.mark.parametrize("version", [8, 9])
def test_round_trip_and_regions(spark, tmp_path, version):
    rows = [(1, 1, 10, x, y, float((x * 7 + y) % 5) + 0.5 * (x % 2)) for x in range(0, 900, 13) for y in range(x, 900, 29)]
    rows += [(1, 2, 10, x, y, 1.0) for x in range(0, 900, 50) for y in range(0, 700, 50)]
    df = spark.createDataFrame(rows, "chr1_idx int, chr2_idx int, bin_size int, bin_x int, bin_y int, counts double")
    written = sink.write_contacts(df, [("ALL", 0), ("1", 10_000), ("2", 8000)], "file://" + str(tmp_path / "maps"), "g", version, 64, 1000)
    assert written.count() == -(-len(rows) // 1000)
    read = contact_file.read(spark, "file://" + str(tmp_path / "maps"))
    same = lambda a: sorted((r["chr1_idx"], r["chr2_idx"], r["bin_size"], r["bin_x"], r["bin_y"], r["counts"]) for r in a)
    assert same(read.collect()) == sorted(rows)
    for x1, x2, y1, y2 in ((0, 50, 0, 50), (100, 200, 600, 800), (400, 420, 10, 899), (899, 899, 0, 899)):
        got = read.where((F.col("chr1_idx") == 1) & F.col("chr2_idx").isin(1, 2) & F.col("bin_x").between(x1, x2) & (F.col("bin_y") >= y1) & (F.col("bin_y") < y2 + 1))
        assert same(got.collect()) == sorted(r for r in rows if x1 <= r[3] <= x2 and y1 <= r[4] <= y2)
    zoom = contact_file.Zoom("", version, 1, 1, "BP", 10, 0.0, 64, 157, 0, 0)
    kept = contact_file.may_meet(zoom, contact_file.np.arange(157 * 4), (0, 50), (0, 50))
    assert kept[0] and kept.sum() < 10


def test_blocks_are_written_one_by_one(monkeypatch):
    """Records come in batches that cut blocks; each block is encoded once, whole, and a file is a stream of pieces."""
    import pyarrow as pa

    cells = [(1, 1, 10, b, y, 8 * b + x, 1.0) for b in range(6) for y in range(5) for x in range(3)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(sink.RECORD, zip(*cells[i : i + 7])))) for i in range(0, len(cells), 7)]
    made = list(sink.encoded_blocks(iter(batches), 8))
    assert [m[0] for m in made] == [(1, 1, 10)] * 6 and [m[1] for m in made] == list(range(6)) and {m[2] for m in made} == {15.0}
    for (_, number, _, block) in made:
        x, y, c = contact_file.decoded(zlib.decompress(block), 8)
        assert sorted(zip(y.tolist(), x.tolist())) == [(yy, xx) for _, _, _, b, yy, xx, _ in cells if b == number]
    pieces = list(sink.file_pieces({(1, 1, 10): [m[1:] for m in made]}, [("ALL", 0), ("1", 1000)], "g", 8, 8, 16))
    assert len(pieces) >= 6 + 3 and struct.unpack_from("<q", pieces[0], 8)[0] == len(b"".join(pieces[:-1]))


def many_pairs(n):
    """A file of version 8 with n pairs of n chromosomes, a block each, and a vector each; expected values without factors."""
    chromosomes = [("ALL", 0), *((f"c{i}", 100) for i in range(1, n + 1))]
    head = text("genome") + struct.pack("<i", 0) + struct.pack("<i", len(chromosomes)) + b"".join(text(c) + struct.pack("<i", s) for c, s in chromosomes) + struct.pack("<iii", 1, 10, 0)
    out = bytearray(text("HIC") + struct.pack("<iq", 8, 0) + head)
    data = zlib.compress(listed(8, True, 0, 0))
    index, vectors = b"", b""
    for i in range(1, n + 1):
        at = len(out)
        out += data
        record = struct.pack("<iii", i, i, 1) + text("BP") + struct.pack("<iffffiiii", 0, 24.0, 0, 0, 0, 10, 8, 16, 1) + struct.pack("<iqi", 0, at, len(data))
        index += text(f"{i}_{i}") + struct.pack("<qi", len(out), len(record))
        out += record
        vectors += text("VC") + struct.pack("<i", i) + text("BP") + struct.pack("<iqi", 10, len(out), 4 + 16)
        out += struct.pack("<i2d", 2, float(i), NAN)
    struct.pack_into("<q", out, 8, len(out))
    expected = struct.pack("<i", 1) + text("BP") + struct.pack("<ii", 10, 2) + struct.pack("<2d", 3, 4) + struct.pack("<i", 0)
    footer = struct.pack("<i", n) + index + expected
    out += struct.pack("<i", len(footer)) + footer + struct.pack("<i", 0) + struct.pack("<i", n) + vectors
    return bytes(out), len(head), len(footer) + len(vectors)


def test_planning_reads_headers_and_footers(spark, tmp_path, monkeypatch):
    n = 20_000
    data, head, foot = many_pairs(n)
    path = write(tmp_path, data)
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, size, at):
            read.append(min(size, self.file.size() - at))
            return self.file.read_at(size, at)

    plain = contact_file.opened
    monkeypatch.setattr(contact_file, "opened", lambda p: Counted(plain(p)))
    for table in ("contacts", "matrices", "norm_vectors"):
        read.clear()
        parts = contact_file.ContactMapReader(table, [path]).partitions()
        assert sum(read) < head + foot + 6 * (1 << 16) and n / 1024 <= len(parts) <= n / 50
    monkeypatch.undo()
    got = contact_file.read(spark, path)
    assert got.count() == 3 * n and got.where("chr1_idx = 77 AND chr2_idx = 77").count() == 3
    assert contact_file.read(spark, path, "matrices").select("chr1_idx").distinct().count() == n
    assert sorted(r["value"] for r in contact_file.read(spark, path, "norm_vectors").where("bin = 0").collect()) == [float(i) for i in range(1, n + 1)]
    assert contact_file.read(spark, path, "expected").count() == 0  # no factors
    part = contact_file.read(spark, path, "norm_vectors").where("chr_idx = 5 AND bin >= 1").collect()
    assert len(part) <= 1 and all(r["bin"] == 1 for r in part)


def test_large_records_are_shared_out(spark, tmp_path, monkeypatch):
    """The blocks of one pair go to several tasks, each of them to one."""
    blocks = [(i, dense(8, True)) for i in range(50)]
    path = write(tmp_path, build(8, blocks))
    monkeypatch.setattr(contact_file, "BLOCKS", 7)
    monkeypatch.setattr(contact_file, "HEADS", 0)
    reader = contact_file.ContactMapReader("contacts", [path])
    parts = reader.partitions()
    rows = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert len(parts) == 8 and sum(rows) == 50 * 5 and max(rows) <= 2 * 7 * 5


def graphs_text(sizes=(2000, 603, 400)):
    a, b, c = (" ".join(str(i) for i in range(n)) for n in sizes)
    return f"A = [ {a} ]; B = [ {b} ]; D = [ {c} ]; x = [ 10 20 ];"


def test_graphs(spark, tmp_path):
    rows = contact_file.graphs_of(graphs_text())
    assert len(rows) == 2000 + 603 + 400 and rows[1999] == ("fragment_distance", 1999, 0, 1999) and rows[2000 + 5] == ("mapping_quality", 1, 2, 5) and rows[-1] == ("distance_by_orientation", 99, 3, 399)
    for broken in ("", "A = [ 1 2 ];", graphs_text((2000, 603, 399)), graphs_text().replace(" 17 ", " x ", 1), "no brackets 1 2 3"):
        assert contact_file.graphs_of(broken) == []
    data = build(8, [(0, dense(8, True))])
    own = text("graphs") + text(graphs_text())
    longer = data.replace(text("k") + text("v"), own, 1)
    more = len(own) - 4
    longer = longer[:8] + struct.pack("<q", struct.unpack_from("<q", data, 8)[0] + more) + longer[16:]
    got = contact_file.read(spark, write(tmp_path, longer), "graphs").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)
    assert contact_file.read(spark, write(tmp_path, data, "b.hic"), "graphs").count() == 0


class Ranges(http.server.BaseHTTPRequestHandler):
    """Serves one file by ranges; counts the bytes, and fails a few times if told to."""

    data, sent, failures, head = b"", [], 0, True

    def log_message(self, *_):
        pass

    def do_HEAD(self):
        if not self.head:
            return self.send_error(405)
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        if type(self).failures:
            type(self).failures -= 1
            return self.send_error(503)
        if "gone" in self.path:
            return self.send_error(404)
        first, last = map(int, re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers["Range"]).groups())
        body = self.data[first : last + 1]
        type(self).sent.append(len(body))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{last}/{len(self.data)}")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def served():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Ranges.sent, Ranges.failures, Ranges.head = [], 0, True
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_maps_by_http(spark, served):
    filler = [(i, dense(8, False)) for i in range(1, 400)]
    Ranges.data = build(8, [(0, listed(8, True, 0, 0)), *filler]) + bytes(3_000_000)  # what nobody asks for
    Ranges.failures = 2
    url = f"{served}/some/map.hic"
    near = contact_file.read(spark, url).where("chr1_idx = 1 AND chr2_idx = 1 AND bin_x < 8 AND bin_y < 8").collect()
    assert {(r["bin_x"], r["bin_y"], r["counts"]) for r in near} == {(3, 4, 7.0), (6, 4, 8.0)}
    assert 0 < sum(Ranges.sent) < 600_000
    assert [tuple(r) for r in contact_file.read(spark, url, "chromosomes").collect()] == [(0, "ALL", 0), (1, "1", 1000), (2, "2", 800)]
    Ranges.head = False
    assert contact_file.read(spark, [url, url], "matrices").count() == 2
    with pytest.raises(Exception, match="404"):
        contact_file.read(spark, f"{served}/gone.hic").collect()


def test_ranges_of_a_remote_file(served):
    from tessera.sources.http import HttpFile

    Ranges.data = bytes(range(256)) * 10
    file = HttpFile(f"{served}/x", wait=0.01)
    assert file.size() == 2560 and file.read_at(5, 250) == bytes([250, 251, 252, 253, 254]) and file.read_at(100, 2550) == Ranges.data[2550:] and file.read_at(5, 2560) == b""
    Ranges.failures = 4
    assert file.read_at(1, 0) == b"\0"
    Ranges.failures = 9
    with pytest.raises(OSError, match="503"):
        file.read_at(1, 0)
