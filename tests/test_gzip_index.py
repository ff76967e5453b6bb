"""Pieces of compressed files against a single pass over them."""

import gzip
import io
import os
import random
import zlib

import pytest
from tidelog.sources import gzip_index, text_tree
from tidelog.sources.gzip_index import Pass, decoded

SPACING = 200_000


def text(n, seed=0, end="\n"):
    rng = random.Random(seed)
    words = ["error", "warn", "connected", "timeout", "pod", "ünïcode", "GET", "/healthz", "retry", "user"]
    return "".join(f"2024-01-05T10:{rng.randrange(60):02d}:{rng.random():.6f} {' '.join(rng.choices(words, k=rng.randint(0, 12)))}"
                   f" id={rng.getrandbits(40):x}{end}" for _ in range(n)).encode()


def deflated(data, level=6, strategy=zlib.Z_DEFAULT_STRATEGY, flush_every=0):
    engine = zlib.compressobj(level, zlib.DEFLATED, 31, 8, strategy)
    if not flush_every:
        return engine.compress(data) + engine.flush()
    parts = [engine.compress(data[i:i + flush_every]) + engine.flush(zlib.Z_FULL_FLUSH) for i in range(0, len(data), flush_every)]
    return b"".join(parts) + engine.flush()


BIG = text(40_000)
FILES = {
    "level 1": deflated(BIG, 1), "level 6": deflated(BIG), "level 9": deflated(BIG, 9),
    "fixed codes": deflated(BIG, strategy=zlib.Z_FIXED), "flushed": deflated(BIG, flush_every=50_000),
    "many members": b"".join(gzip.compress(BIG[i:i + 90_001]) for i in range(0, len(BIG), 90_001)),
    "members and padding": gzip.compress(BIG) + bytes(5_000) + gzip.compress(text(9_000, 1)) + bytes(3),
    "empty members": gzip.compress(b"") * 3 + gzip.compress(BIG) + gzip.compress(b""),
    "one long line": gzip.compress(text(30_000, 2, " ")), "no last line end": gzip.compress(BIG[:-1]),
    "cut off": gzip.compress(BIG)[:-100_000], "repeats itself": gzip.compress(b"same line\n" * 300_000),
    "noise": gzip.compress(random.Random(5).randbytes(900_000)), "small": gzip.compress(b"a\nb"), "nothing": gzip.compress(b""),
    "garbage behind": gzip.compress(BIG) + b"no member",
}


def plain(data):
    """All text of all members, as far as it goes."""
    out = []
    while data.startswith(b"\x1f\x8b"):
        engine = zlib.decompressobj(31)
        out.append(engine.decompress(data))
        data = engine.unused_data.lstrip(b"\0")
    return b"".join(out)


@pytest.mark.parametrize("name", FILES)
def test_each_piece_decodes_to_the_rest_of_the_text(name):
    whole, done = plain(FILES[name]), Pass(SPACING).run(io.BytesIO(FILES[name]))
    assert done.at == len(whole) and done.lines == whole.count(b"\n")
    for p in done.pieces:
        assert b"".join(decoded(io.BytesIO(FILES[name]), p.bit, p.raw, p.window, p.following)) == whole[p.start:]
        assert whole[:p.start].endswith(p.window) and p.lines_before == whole[:p.start].count(b"\n")
    if name.startswith("level") or name in ("flushed", "many members", "one long line", "cut off"):
        assert len(done.pieces) >= 3  # one a read at most, a read being some 800 KB of text


def test_a_file_that_is_no_gzip_is_an_error():
    with pytest.raises(zlib.error):
        Pass().run(io.BytesIO(b"plain text"))


@pytest.fixture
def tree(tmp_path):
    for i, data in enumerate(FILES.values()):
        folder = tmp_path / "pods" / f"ns{i % 2}_pod_uid" / f"c{i}"
        os.makedirs(folder)
        (folder / "0.log.20240101.gz").write_bytes(data)
    return str(tmp_path / "pods"), str(tmp_path / "index")


def expected_lines(data):
    whole, out, at = plain(data), [], 0
    parts = whole.split(b"\n")
    for i, line in enumerate(parts[:-1] if parts[-1] == b"" else parts):
        out.append((i + 1, at, len(line), line.decode("utf-8", "replace")))
        at += len(line) + 1
    return out


def test_lines_of_pieces_equal_those_of_the_file(spark, tree):
    root, folder = tree
    files = text_tree.list_files(spark, root, "*.gz")
    index = gzip_index.update_index(spark, files, folder, SPACING)
    got = {}
    for r in gzip_index.read_pieces(index).collect():
        got.setdefault(int(r.path.split("/c")[-1].split("/")[0]), []).append((r.line_no, r.start_byte, r.n_bytes, r.line))
    for i, data in enumerate(FILES.values()):
        assert sorted(got.get(i, [])) == expected_lines(data)
    rows = index.count()
    assert gzip_index.update_index(spark, files, folder, SPACING).count() == rows  # nothing new


def test_compressed_logs_as_the_batch_reader_gives_them(spark, tree):
    """A replaced file is indexed anew; one that is gone is not read."""
    root, folder = tree
    for i, name in enumerate(FILES):
        if name in ("cut off", "noise", "garbage behind", "empty members", "members and padding"):  # Spark's reader stops there
            os.remove(f"{root}/ns{i % 2}_pod_uid/c{i}/0.log.20240101.gz")
    order = ["path", "line_no", "start_byte"]

    def both():
        old = text_tree.read_node_logs(spark, root, rotated=True)
        new = text_tree.read_compressed_logs(spark, root, folder, spacing=SPACING).select(*old.columns)
        assert new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()
        return old.count()

    n = both()
    path = f"{root}/ns0_pod_uid/c0/0.log.20240101.gz"
    with gzip.open(path, "wb") as f:
        f.write(b"other\r\nlines\rhere\n")
    assert both() == n - 40_000 + 3
    assert text_tree.read_compressed_logs(spark, root, folder, ["ns1"]).where("ns = 'ns0'").isEmpty()
