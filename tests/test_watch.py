"""New and changed files as a stream."""

import os
import time

import office
from lectern.cli import main
from lectern.streaming.files import watch


def put(root, name, data=b"x", age=0.0):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    os.utime(path, (time.time() - age, time.time() - age))


def test_each_change_is_seen_once(spark, tmp_path):
    root, point = str(tmp_path / "tree"), str(tmp_path / "point")
    seen = []
    look = lambda: watch(spark, root, point, lambda rows: seen.append(sorted((r.rel_path, r.format) for r in rows.collect())), lag=0.0)
    for n in ("a.pdf", "d/b.DOCX", "d/e/c.png", "d/n.txt", ".git/x.pdf", "e/.git/y.pdf", "_u/h.pdf"):
        put(root, n, age=5)
    look()
    assert seen[-1] == [("_u/h.pdf", "pdf"), ("a.pdf", "pdf"), ("d/b.DOCX", "docx"), ("d/e/c.png", "image")]
    look()
    assert not [x for batch in seen[1:] for x in batch]  # nothing new
    put(root, "d/e/c.png", b"changed")
    put(root, "new/f.pdf")
    os.utime(os.path.join(root, "a.pdf"))  # touched
    look()
    look()
    late = [p for batch in seen[1:] for p, _ in batch]
    assert sorted(late) == ["a.pdf", "d/e/c.png", "new/f.pdf"]
    # A batch whose end the checkpoint doesn't know looks at the same stretch of time.
    last = max(os.listdir(os.path.join(point, "commits")), key=lambda x: int(x) if x.isdigit() else -1)
    put(root, "later.pdf")
    look()
    for name in [x for x in os.listdir(os.path.join(point, "commits")) if x.strip(".crc").isdigit() and int(x.strip(".crc")) > int(last)]:
        os.remove(os.path.join(point, "commits", name))
    before = len(seen)
    look()
    assert [p for batch in seen[before:] for p, _ in batch] == ["later.pdf"]


def test_files_still_written_wait(spark, tmp_path):
    root, seen = str(tmp_path / "tree"), []
    put(root, "a.pdf", age=100)
    put(root, "b.pdf")
    watch(spark, root, str(tmp_path / "point"), lambda rows: seen.extend(r.rel_path for r in rows.collect()), lag=50.0)
    assert seen == ["a.pdf"]


def test_watch_from_the_command_line(spark, tmp_path):
    root, out, work = (str(tmp_path / x) for x in ("tree", "out", "work"))
    put(root, "t.xlsx", office.xlsx(), age=10)
    command = ["watch", root, "--output", out, "--temp", work]
    assert main(command, spark) == 0 and os.listdir(out).count("t.md") == 1
    was = os.stat(os.path.join(out, "t.md")).st_mtime_ns
    assert main(command, spark) == 0 and os.stat(os.path.join(out, "t.md")).st_mtime_ns == was
    put(root, "u.xlsx", office.xlsx(), age=3)
    assert main(command, spark) == 0 and {"t.md", "u.md", "index.md"} <= set(os.listdir(out))
    assert "[u](u.md)" in open(os.path.join(out, "index.md")).read() and os.stat(os.path.join(out, "t.md")).st_mtime_ns == was
    assert main(["watch", str(tmp_path / "nothing")], spark) == 1
