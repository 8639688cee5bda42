"""Checksums of files, whole and in blocks, against hashlib."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from airloom.sources import artifacts


def test_state_goes_from_hand_to_hand():
    content, state = random.Random(1).randbytes(1_000), None
    for i in range(0, 1_000, 77):
        part = artifacts._Sha256(state)
        part.feed(content[i : i + 77])
        state = part.state
    assert artifacts._Sha256(state).hexdigest() == hashlib.sha256(content).hexdigest()


@pytest.mark.parametrize("block", [70_000, 1 << 30])
def test_files_in_blocks(spark, tmp_path, monkeypatch, block):
    rng = random.Random(2)
    contents = {
        "sub/random.bin": rng.randbytes(400_000),
        "ends.bin": rng.randbytes(300_000) + b"\n",
        "marked.txt": b"\xef\xbb\xbf" + "Straße\r\n".encode() * 20_000,
        "marked-open.txt": b"\xef\xbb\xbf" + b"a line\r\n" * 20_000 + b"x",
        "blank.txt": b"\n" * 200_000,
        "one line.txt": b"x" * 200_000,
        "packed.txt.gz": gzip.compress(rng.randbytes(200_000), 1),
        "small": b"small",
    }
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    most = []
    real = artifacts._chained
    monkeypatch.setattr(artifacts, "_chained", lambda lines, *rest: most.append(lines.select("path").distinct().count()) or real(lines, *rest))
    try:
        got = artifacts.artifact_manifest(spark, str(tmp_path), block=block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(tuple(r) for r in got) == sorted((name, len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items())
    assert most == ([6] if block == 70_000 else [])
