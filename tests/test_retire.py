"""Retention with a log: hashes of heads, logged before files go."""

import hashlib
import os

from quillmill.streaming import retire as module
from quillmill.streaming.retire import HEAD, entries, retire


def make(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, (age, body) in files.items():
        path = os.path.join(folder, f"{name}.txt")
        with open(path, "wb") as f:
            f.write(body)
        os.utime(path, (1_000_000 - age, 1_000_000 - age))
    return f"file://{folder}", f"file://{folder}-log"


def test_old_files_then_the_oldest_beyond_the_size(spark, tmp_path):
    large = os.urandom(HEAD + 5000)
    src, log = make(tmp_path / "in", old=(9 * 86_400, b"old"), large=(3000, large), mid=(2000, b"m" * 400), new=(10, b"n" * 500))
    with open(tmp_path / "in" / ".hidden", "w") as f:
        f.write("stays")
    got = {r.name: r for r in retire(spark, src, log, 1_000_000, days=7, most_bytes=1000).collect()}
    assert {n: (r.reason, r.gone, r.hash_note) for n, r in got.items()} == {"old.txt": ("ttl", True, "full content"), "large.txt": ("lru", True, "first 64KB only")}
    assert got["large.txt"].sha256 == hashlib.sha256(large[:HEAD]).hexdigest() and got["large.txt"].size == len(large)
    assert sorted(os.listdir(tmp_path / "in")) == [".hidden", "mid.txt", "new.txt"]
    assert retire(spark, src, log, 1_000_000, days=7, most_bytes=1000).count() == 0
    assert {r.name for r in entries(spark, log).collect()} == {"old.txt", "large.txt"}


def test_a_run_lost_before_it_deletes(spark, tmp_path, monkeypatch):
    src, log = make(tmp_path / "in", old=(9 * 86_400, b"old"))
    monkeypatch.setattr(module, "deleted", lambda df: (_ for _ in ()).throw(OSError("lost")))
    try:
        retire(spark, src, log, 1_000_000)
    except OSError:
        pass
    monkeypatch.undo()
    assert os.listdir(tmp_path / "in") == ["old.txt"] and entries(spark, log).count() == 1
    assert retire(spark, src, log, 1_000_050).first().gone and os.listdir(tmp_path / "in") == []
    assert [(r.name, r.retired_at) for r in entries(spark, log).collect()] == [("old.txt", 1_000_050)]
