"""Trees, files, indexes and progress without the driver in the middle."""

import json
import os
import random

from pyspark.sql import functions as F

from lectern.operators import index
from lectern.plans.run import next_batch, read_outputs, read_progress, write_index, write_progress
from lectern.sinks import read_files, write_files, write_lines
from lectern.sources.tree import listing
from lectern.streaming.incremental import process_new


def test_listing(spark, tmp_path):
    want = {}
    for k in range(4000):
        folder = tmp_path / f"d{k % 40}" / (f"e{k % 7}" if k % 3 else "")
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"f{k}.{'MD' if k % 2 else 'txt'}"
        path.write_text("x" * (k % 50))
        if k % 2:
            want[str(path.relative_to(tmp_path))] = k % 50
    (tmp_path / "d1" / "loop").symlink_to(tmp_path)
    (tmp_path / "d1" / "link.md").symlink_to(tmp_path / "d1" / "e1")  # a folder by another name
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("no")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        (tmp_path / "d1" / "loop").unlink(missing_ok=True)
        got = listing(spark, root, (".md",), (".git",))
        assert {r.rel_path: r.length for r in got.collect()} == want
        assert all(n < 1500 for n in got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())  # no task has it all
        assert {r.mtime for r in got.limit(5).collect()} <= {os.stat(tmp_path / p).st_mtime for p in want}
    assert listing(spark, str(tmp_path / "nowhere"), (".md",)).count() == 0


def test_links_to_folders_are_not_followed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("x")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    assert [r.rel_path for r in listing(spark, str(tmp_path), (".md",)).collect()] == ["a/x.md"]


def test_files_there_and_back(spark, tmp_path):
    rows = [(f"d{k % 5}/f {k}.md", f"text ü {k}\n" * (k % 4)) for k in range(200)] + [("top.md", "")]
    for root in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        write_files(spark.createDataFrame(rows, "rel string, text string").repartition(7), root)
        write_files(spark.createDataFrame(rows[:20], "rel string, text string"), root)  # a task that is run again
        listed = listing(spark, root, (".md",))
        assert sorted((r.path, r.markdown) for r in read_files(spark, listed, root).collect()) == sorted(rows)
    left = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".new")]
    assert left == []


def test_one_file_by_many_tasks(spark, tmp_path):
    r = random.Random(4)
    lines = [(k, "ä" * r.randint(0, 30) + str(k)) for k in range(5000)]
    r.shuffle(lines)
    df = spark.createDataFrame(lines, "k long, value string").repartition(9)
    write_lines(df, ["k"], str(tmp_path), "all.txt")
    want = "\n".join(v for _, v in sorted(lines))
    assert (tmp_path / "all.txt").read_text(encoding="utf-8") == want
    write_lines(df, ["k"], f"file://{tmp_path}", "parts")
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 3 and "".join(p.read_text(encoding="utf-8") for p in parts) == want + "\n"
    write_lines(df.where("false"), ["k"], str(tmp_path), "none.txt")
    assert (tmp_path / "none.txt").read_bytes() == b""


def test_index_of_outputs(spark, tmp_path):
    r = random.Random(8)
    for k in range(300):
        path = tmp_path / r.choice(["", "a", "b c", "a/b", "ü"]) / f"f{k}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f'# Title "{k}"\n## héading\nsome words\n' if k % 3 else "no title", encoding="utf-8")
    (tmp_path / "a" / "index.md").write_text("not indexed")
    assert write_index(spark, str(tmp_path)) == 300
    entries = index.manifest(read_outputs(spark, str(tmp_path)))
    assert (tmp_path / "index.md").read_text(encoding="utf-8") == index.index_text(entries).head().text
    got = json.loads((tmp_path / "manifest.json").read_text(encoding="utf-8"))
    assert got == [x.asDict() for x in sorted(entries.collect(), key=lambda x: x.path.split("/"))]


def test_index_lines_stay_spread(spark):
    """A group of any size: no row of the index's plan holds more than one entry."""
    n = 20_000
    entries = spark.range(n).select(F.concat(F.lit("one/f"), F.format_string("%06d", "id"), F.lit(".md")).alias("path"), F.lit("t").alias("title"), F.lit("one").alias("group"), F.array(F.lit("h")).alias("headings"), F.lit(1).cast("long").alias("word_count"))
    rows = index.index_rows(entries, n)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == n + 2 and "collect_list" not in plan and "Window" not in plan


def test_progress_log(spark, tmp_path):
    path = str(tmp_path / "progress")
    put = lambda n, *rows: write_progress(spark.createDataFrame(rows, "rel_path string, mtime double, output string"), path, n)
    assert next_batch(spark, path) == 0 and read_progress(spark, path).count() == 0
    put(0, ("a", 1.0, "a.md"), ("b", 1.0, "b.md"))
    put(1, ("a", 2.0, "a.md"))
    put(1, ("a", 2.0, "a.md"))  # once more
    assert next_batch(spark, path) == 2
    assert sorted(tuple(r) for r in read_progress(spark, path).collect()) == [("a", 2.0, "a.md"), ("b", 1.0, "b.md")]
    assert sorted(tuple(r) for r in read_progress(spark, path, 1).collect()) == [("a", 1.0, "a.md"), ("b", 1.0, "b.md")]


def test_a_batch_is_worked_out_once_and_known_when_it_comes_again(spark, tmp_path):
    """A process that gives something else each time, and a failure between the progress and the checkpoint."""
    import uuid

    src, state, check, out = (str(tmp_path / x) for x in ("src", "state", "check", "out"))
    spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "y")], "rel_path string, mtime double, markdown string").coalesce(1).write.parquet(src)
    runs = []

    def process(rows):
        runs.append(uuid.uuid4().hex)
        return rows.withColumn("output", F.concat("rel_path", F.lit("-"), F.expr("uuid()")))

    write = lambda rows: write_files(rows.select("rel_path", "output"), out)
    process_new(spark, src, state, check, process, write=write)
    done = {r.rel_path: r.output for r in read_progress(spark, state).collect()}
    assert len(runs) == 1 and {p: (tmp_path / "out" / p).read_text() for p in "ab"} == done  # one evaluation for both
    for name in os.listdir(os.path.join(check, "commits")):  # the checkpoint doesn't know that the batch ended
        os.remove(os.path.join(check, "commits", name))
    process_new(spark, src, state, check, process, write=write)
    assert len(runs) == 1 and {r.rel_path: r.output for r in read_progress(spark, state).collect()} == done


def test_index_by_delta(spark, tmp_path, monkeypatch):
    """Only what is new or changed is read, what is gone goes, and the index is that of a whole rebuild."""
    from lectern.plans import run as plans

    r = random.Random(12)
    out, state = tmp_path / "out", str(tmp_path / "state")
    read = []
    whole = plans.read_files
    monkeypatch.setattr(plans, "read_files", lambda s, listed, root: whole(s, listed, root) if read.append(sorted(x.rel_path for x in listed.collect())) is None else None)
    files = {}

    def put(path, text):
        (out / path).parent.mkdir(parents=True, exist_ok=True)
        (out / path).write_text(text)
        files[path] = text

    for k in range(60):
        put(f"g{k % 5}/f{k}.md", f"# T{k}\n")
    for edits in range(4):
        assert write_index(spark, str(out), state) == len(files)
        assert (out / "index.md").read_text() == index.index_text(index.manifest(spark.createDataFrame(list(files.items()), "path string, markdown string"))).head().text
        got = json.loads((out / "manifest.json").read_text())
        assert {e["path"]: e["title"] for e in got} == {p: t[2:].strip() for p, t in files.items()}
        changed = r.sample(sorted(files), 3)
        for p in changed:
            put(p, f"# Changed {edits}\n")
        gone = next(p for p in sorted(files) if p not in changed)
        os.remove(out / gone)
        del files[gone]
        put(f"new/n{edits}.md", "# New\n")
        if edits:
            assert read[-1] == expected
        expected = sorted([*changed, f"new/n{edits}.md"])
    assert len(read[0]) == 60 and len(os.listdir(state)) <= 6  # two versions, and what Spark writes beside them
