import random
import struct
import zlib

import pytest

from recordmill.sources import blocks

RNG = random.Random(9)


def block(data):
    body = zlib.compress(data)
    return struct.pack("<q", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files with a damaged header, a damaged block, a cut end, nothing, and no fault."""
    path = tmp_path_factory.mktemp("gather")
    good = {name: [RNG.randbytes(RNG.randint(0, 400)) for _ in range(30)] for name in "abcd"}
    parts = {name: [block(p) for p in held] for name, held in good.items()}
    parts["b"][12] = struct.pack("<q", -5) + parts["b"][12][8:]
    parts["c"][4] = parts["c"][4][:8] + b"xx" + parts["c"][4][10:]
    for name, held in parts.items():
        data = b"".join(held)
        (path / f"{name}.blk").write_bytes(data[:-3] if name == "d" else data)
    (path / "e.blk").write_bytes(b"")
    (path / "f.blk").write_bytes(b"abc")
    kept = {"a": good["a"], "b": good["b"][:12], "c": good["c"][:4] + good["c"][5:], "d": good["d"][:-1]}
    return str(path), kept


def test_all_that_is_sound_is_gathered_in_order(spark, folder, tmp_path):
    source, kept = folder
    out = str(tmp_path / "out")
    manifest = {r["file"][-5]: r for r in blocks.gather_blocks(spark, source, out, part_bytes=1000).collect()}
    files = sorted((tmp_path / "out").glob("part-*"))
    want = [p for name in "abcd" for p in kept[name]]
    assert b"".join(f.read_bytes() for f in files) == b"".join(want)
    assert len(files) > 10 and all(f.stat().st_size < 1400 for f in files)
    assert sorted(manifest) == list("abcdf")
    for name, failed in zip("abcdf", (0, 1, 1, 1, 1)):
        row, held = manifest[name], kept.get(name, [])
        assert (row["blocks"], row["bytes"], row["failed"]) == (len(held), sum(map(len, held)), failed)
        assert (row["error"] is None) == (failed == 0)
    assert "header" in manifest["f"]["error"] and manifest["a"]["first_part"] == 0
    assert not list((tmp_path / "out").glob(".attempt*"))


def test_gathered_again(spark, folder, tmp_path):
    source, _ = folder
    out = str(tmp_path / "out")
    blocks.gather_blocks(spark, source, out, part_bytes=1000)
    with pytest.raises(Exception):
        blocks.gather_blocks(spark, source, out)
    blocks.gather_blocks(spark, source, out, force=True)
    assert [f.name for f in (tmp_path / "out").glob("part-*")] == ["part-00000"]


def test_without_skipping_a_damaged_header_fails(spark, folder):
    with pytest.raises(Exception, match="block 12"):
        blocks.read_blocks(spark, f"{folder[0]}/b.blk").collect()


def test_index_names_the_damage(spark, folder):
    rows = blocks.read_block_index(blocks.list_files(spark, f"{folder[0]}/b.blk"), skip_bad=True).collect()
    assert len(rows) == 13 and [r["block_id"] for r in rows if r["error"]] == [12]
    assert next(r for r in rows if r["error"])["stored_size"] is None
