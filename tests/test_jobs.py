"""The jobs: against SQL, over growing input, from the command line, and after runs that broke off."""

import json
import random

import pytest
from pyspark.sql import functions as F

from compare import connect, normal
from jobs import publish_knowledge, sync_knowledge
from jobs.queries import QUERIES, SQL
from lectern.plans import catalog

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(connect(SF).sql(SQL[name]).df())


def lines_of(spark, path):
    """Lines of a folder of text files, file by file in the order of their names."""
    rows = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return "".join(r.value for r in sorted(rows.collect(), key=lambda r: r.file.rsplit("/", 1)[-1])).split("\n")


def test_publish(spark, tmp_path):
    docs, talks, out = (str(tmp_path / x) for x in ("docs", "talks", "out"))
    rows = [(1, "# One\ntext \n#bad", "en", "a"), (2, "two", "en", "a"), (2, "two", "en", "a"), (3, None, "en", "a"), (None, "no id", None, None), (4, "", "de", "b/c"), (5, "x\n" * 5, "de", "b")]
    spark.createDataFrame(rows, DOCS).withColumn("path", F.lit("clash")).write.parquet(docs)
    spark.createDataFrame([(7, 1, "assistant", "hi"), (7, None, "user", "first"), (7, 2, None, None), (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").write.parquet(talks)
    for _ in range(2):
        facts = publish_knowledge.publish(spark, docs, talks, out)
        assert facts["documents read"] == 7 and facts["conversation turns read"] == 4 and facts["pages written"] == 6
        got = {r.path: r for r in catalog.read(spark, f"{out}/manifest", publish_knowledge.MANIFEST, "json").collect()}
        nameless = next(p for p in got if p.startswith("unknown/"))
        assert sorted(got, key=lambda p: got[p].place) == ["a/en/d1.md", "a/en/d2.md", "b/c/de/d4.md", "b/de/d5.md", "conversations/c7.md", nameless]
        assert got["a/en/d1.md"].title == "One" and got["a/en/d1.md"].headings == ["One", "bad"] and got["a/en/d1.md"].fixed_count > 0
        assert got["conversations/c7.md"].headings == ["Conversation 7", "user", "assistant", "unknown"]
        pages = {r.path: r.markdown for r in catalog.read(spark, f"{out}/pages", catalog.PAGES).collect()}
        assert pages["a/en/d1.md"] == "# One\n\ntext\n\n# bad\n" and pages["b/c/de/d4.md"] == "\n" and set(pages) == set(got)
        assert lines_of(spark, f"{out}/index/group=a") == ["## a", "", "- [One](a/en/d1.md)", "- [d2](a/en/d2.md)", ""]
        totals = {r.group: r.pages for r in spark.read.json(f"{out}/summary").collect()}
        assert totals == {"a": 2, "b": 2, "conversations": 1, "unknown": 1}
    # What is no longer there goes.
    spark.createDataFrame(rows[:1], DOCS).write.mode("overwrite").parquet(docs)
    publish_knowledge.publish(spark, docs, talks, out)
    assert {r.path for r in catalog.read(spark, f"{out}/pages", catalog.PAGES).collect()} == {"a/en/d1.md", "conversations/c7.md"}


def test_publish_of_empty_tables(spark, tmp_path):
    docs, talks, out = (str(tmp_path / x) for x in ("docs", "talks", "out"))
    spark.createDataFrame([], DOCS).write.parquet(docs)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(talks)
    assert publish_knowledge.publish(spark, docs, talks, out)["pages written"] == 0


def state(spark, out):
    index = {r.path: (r.word_count, r.versions, r.digest) for r in catalog.read(spark, f"{out}/index", sync_knowledge.INDEX, "json").collect()}
    pages = sorted((r.path, r.batch, r.markdown) for r in catalog.read(spark, f"{out}/pages", sync_knowledge.LOG).collect())
    runs = sorted((r.batch, r.arrived, r.changed, r.groups) for r in catalog.read(spark, f"{out}/runs", sync_knowledge.RUNS, "json").collect())
    return index, pages, runs


def test_sync_over_growing_input(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    put = lambda *rows: spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(src)
    put((1, "one", "en", "a"), (2, "two words", "en", "b"), (3, None, "en", "b"), (2, "two words", "en", "b"))
    assert sync_knowledge.sync(spark, src, out, point) == 1
    index, pages, runs = state(spark, out)
    assert {p: v[:2] for p, v in index.items()} == {"a/en/d1.md": (1, 1), "b/en/d2.md": (2, 1)} and runs == [(0, 4, 2, 2)]
    assert sync_knowledge.sync(spark, src, out, point) == 0  # nothing new
    assert state(spark, out) == (index, pages, runs)
    # A new one, one that comes again unchanged, one with another text; group b isn't touched.
    put((1, "one, again", "en", "a"), (2, "two words", "en", "b"), (4, "four", "en", "a"))
    assert sync_knowledge.sync(spark, src, out, point) == 1
    index, pages, runs = state(spark, out)
    assert {p: v[:2] for p, v in index.items()} == {"a/en/d1.md": (2, 2), "b/en/d2.md": (2, 1), "a/en/d4.md": (1, 1)}
    assert runs == [(0, 4, 2, 2), (1, 3, 2, 1)] and [x[:2] for x in pages] == [("a/en/d1.md", 0), ("a/en/d1.md", 1), ("a/en/d4.md", 1), ("b/en/d2.md", 0)]
    # A batch that is run again, as after a failure, leaves the same; so does an index that was lost halfway.
    rows = spark.read.schema(DOCS).parquet(src).where("text IN ('one, again', 'four') OR doc_id = 2").dropDuplicates()
    sync_knowledge.take(rows, 1, out)
    assert state(spark, out)[:2] == (index, pages)
    # A text that goes back to what it was is a third version.
    put((1, "one", "en", "a"))
    sync_knowledge.sync(spark, src, out, point)
    assert state(spark, out)[0]["a/en/d1.md"][:2] == (1, 3)


def test_a_batch_that_breaks_off_is_taken_again(spark, tmp_path, monkeypatch):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    spark.createDataFrame([(1, "one", "en", "a"), (2, "two", "en", "b")], DOCS).coalesce(1).write.parquet(src)
    with monkeypatch.context() as m:
        m.setattr(catalog, "current", lambda *_: 1 / 0)  # after the pages are written, before the index is
        with pytest.raises(Exception, match="division by zero"):
            sync_knowledge.sync(spark, src, out, point)
    assert len(state(spark, out)[1]) == 2 and state(spark, out)[0] == {}
    sync_knowledge.sync(spark, src, out, point)
    index, pages, runs = state(spark, out)
    assert set(index) == {"a/en/d1.md", "b/en/d2.md"} and len(pages) == 2 and runs == [(0, 2, 2, 2)]


def test_only_touched_groups_are_read_and_rewritten(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 20}") for k in range(200)], DOCS).coalesce(1).write.parquet(src)
    sync_knowledge.sync(spark, src, out, point)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "index").rglob("part-*")}
    was = files()
    spark.createDataFrame([(5, "other", "en", "s5")], DOCS).coalesce(1).write.mode("append").parquet(src)
    sync_knowledge.sync(spark, src, out, point)
    now = files()
    assert {f.parent.name for f in set(was) ^ set(now)} == {"group=s5"}
    # The pages' texts aren't read for the index.
    log = catalog.read(spark, f"{out}/pages", sync_knowledge.LOG)
    plan = catalog.current(log, log.where("batch = 1").select("group").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "markdown" not in plan


def test_command_lines(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    config = tmp_path / "publish.toml"
    config.write_text(f'documents = "{SF}/documents.parquet"\nconversations = "nowhere"\noutput = "{tmp_path}/kb"\ncompat = "no"\n')
    assert publish_knowledge.main(["--config", str(config), "--conversations", f"{SF}/conversations.parquet"], spark) == 0
    assert sync_knowledge.main(["--arrivals", f"{SF}/documents.parquet", "--output", f"{tmp_path}/synced", "--checkpoint", f"{tmp_path}/point"], spark) == 0
    assert "documents read: 200" in caplog.text and "pages written: 220" in caplog.text and "200 arrived" in caplog.text
    both = [json.loads(line)["path"] for f in (tmp_path / "synced" / "index").rglob("part-*.json") for line in f.read_text().splitlines()]
    assert len(both) == 200
    with pytest.raises(SystemExit):
        sync_knowledge.main(["--config", str(config)], spark)


def test_index_by_delta_is_the_index_made_anew(spark, tmp_path):
    """Random edits over several batches: what is kept by delta equals what all arrivals together give."""
    r = random.Random(9)
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    newest, versions = {}, {}
    for batch in range(4):
        rows = {}
        for _ in range(60):
            k = r.randrange(40)
            rows[k] = (k, r.choice(["# A\n\ntext", "one", "two  \n#x", f"v{r.randrange(9)}", ""]), "en", f"s{k % 5}")
        for k, row in rows.items():
            if newest.get(k) != row[1]:
                newest[k], versions[k] = row[1], versions.get(k, 0) + 1
        spark.createDataFrame(list(rows.values()), DOCS).coalesce(1).write.mode("append").parquet(src)
        sync_knowledge.sync(spark, src, out, point)
    whole = catalog.pages(publish_knowledge.document_files(spark.createDataFrame([(k, t, "en", f"s{k % 5}") for k, t in newest.items()], DOCS)))
    names = ["path", "title", "headings", "word_count", "fixed_count", "remaining", "digest", "group"]
    index = catalog.read(spark, f"{out}/index", sync_knowledge.INDEX, "json")
    key = lambda rows: sorted(tuple(map(str, x)) for x in rows)
    assert key(index.select(*names).collect()) == key(whole.select(*names).collect())
    assert {x.path: x.versions for x in index.collect()} == {f"s{k % 5}/en/d{k}.md": n for k, n in versions.items()}


def test_output_without_its_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "one", "en", "a")], DOCS).coalesce(1).write.parquet(src)
    sync_knowledge.sync(spark, src, out, str(tmp_path / "point"))
    with pytest.raises(ValueError, match="checkpoint"):
        sync_knowledge.sync(spark, src, out, str(tmp_path / "other"))


def test_many_batches_give_what_one_does(spark, tmp_path):
    """A file a batch, with a document that changes between files and back, and pages that a batch doesn't have."""
    src = str(tmp_path / "src")
    for k, rows in enumerate([[(1, "one", "en", "a"), (2, "x", "en", "a")], [(1, "one, changed", "en", "a")], [(3, None, "en", "c")], [(4, "four", "de", "b"), (2, "x", "en", "a")]]):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{src}/{k}")
    done = {}
    for files in (1, 100):
        whole = str(tmp_path / f"whole{files}")
        assert sync_knowledge.sync(spark, f"{src}/*", whole, f"{whole}-point", files) == (4 if files == 1 else 1)
        index, pages, runs = state(spark, whole)
        done[files] = {p: v[0] for p, v in index.items()}
        assert sum(r[1] for r in runs) == 6
    assert set(done[1]) == set(done[100]) == {"a/en/d1.md", "a/en/d2.md", "b/de/d4.md"}
    assert done[1]["a/en/d1.md"] == 2  # the file that came last
