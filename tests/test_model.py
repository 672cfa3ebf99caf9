"""Model calls by content: equal requests once, nothing logged asked again, whatever dies."""

import os
import sys
import time
import uuid
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.operators import model

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests
SCHEMA = "id long, kind string, text string, context string, image binary, mime string"


@dataclass
class Counting:
    """Leaves a file for each call below a folder; the first time it hears a word it may die or be down."""

    folder: str
    bad: str | None = None
    how: str = "kill"
    model: str = "m"
    wait: float = 0.0

    def ask(self, prompt, image, mime):
        if self.bad and self.bad in prompt:
            fallen = os.path.join(self.folder, "fallen")
            if not os.path.exists(fallen):
                open(fallen, "w").close()
                time.sleep(0.5)
                if self.how == "kill":
                    os._exit(1)  # the whole Python worker
                raise model.ProviderDown(self.bad) if self.how == "down" else RuntimeError("lost")
        if "refuse" in prompt:
            raise model.BadRequest("refuse")
        began = time.time()
        time.sleep(self.wait)
        with open(os.path.join(self.folder, f"{uuid.uuid4().hex}.call"), "w") as f:
            f.write(f"{began} {time.time()} {prompt[-20:]}")
        return model.Reply("ok", f"reply to {prompt[-8:]}", 10, 5, 0.01)


def calls(folder):
    return [open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".call")]


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "log")


def requests(spark, texts):
    return spark.createDataFrame([(i, "cleanup", t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def test_equal_requests_are_asked_once(spark, place):
    folder, log = place
    texts = [f"text {i % 30:04}" for i in range(300)] + ["please refuse"] * 3 + [None, ""]
    replies, paid = model.ask_once(requests(spark, texts), Counting(folder), log)
    got = {r.id: (r.status, r.reply) for r in replies.collect()}
    assert len(got) == 305 and all(got[i] == ("ok", f"reply to ext {i % 30:04}") for i in range(300)) and got[300] == ("skip", None)
    assert len(calls(folder)) == 32 and paid.where("status = 'ok'").count() == 32  # a null text is not an empty one
    assert paid.agg(F.sum("cost")).head()[0] == pytest.approx(0.32)
    # Another run asks nothing that it has been told, refusals included, and only what is new.
    replies, paid = model.ask_once(requests(spark, [*texts, "new"]), Counting(folder), log)
    assert replies.count() == 306 and paid.count() == 1 and len(calls(folder)) == 33
    # Another model is another question.
    model.ask_once(requests(spark, ["new"]), Counting(folder, model="other"), log)
    assert len(calls(folder)) == 34


def test_names_keep_parts_apart(spark):
    rows = [(0, "image", None, "c", b"i", "m"), (1, "image", "c", None, b"i", "m"), (2, "image", None, "c", b"", "m"), (3, "image", None, "c", None, "m"), (4, "image", "", "c", b"i", "m"), (5, "image", None, "c", b"i", "m")]
    names = [r.name for r in model.by_content(spark.createDataFrame(rows, SCHEMA), "x").orderBy("id").collect()]
    assert len(set(names)) == 5 and names[0] == names[5]


def test_what_was_logged_before_the_provider_went_down_is_kept(spark, place):
    folder, log = place
    texts = [f"text {i:04}" for i in range(100)]
    with pytest.raises(Exception, match="ProviderDown"):
        model.ask_once(requests(spark, texts), Counting(folder, "text 0050", "down"), log)
    before = len(calls(folder))
    replies, _ = model.ask_once(requests(spark, texts), Counting(folder), log)
    assert replies.where("status = 'ok'").count() == 100 and before > 0
    assert len({c.split(" ", 2)[2] for c in calls(folder)}) == 100 and len(calls(folder)) <= 100 + model.FLUSH


def test_a_lost_task_asks_no_logged_request_again(tmp_path):
    """Tasks are tried again only on a cluster, so this one has its own session, and its own processes."""
    import subprocess

    (tmp_path / "calls").mkdir()
    script = f"""
import sys
sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]!r}
from pyspark.sql import SparkSession
from lectern.operators import model
from test_model import Counting, requests
spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
replies, paid = model.ask_once(requests(spark, [f"text {{i:04}}" for i in range(400)]), Counting({str(tmp_path / "calls")!r}, "text 0200"), {str(tmp_path / "log")!r})
print("replies", replies.where("status = 'ok'").count())
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert "replies 400" in out.stdout, out.stderr[-2000:]
    heard = [c.split(" ", 2)[2] for c in calls(str(tmp_path / "calls"))]
    assert os.path.exists(tmp_path / "calls" / "fallen") and len(set(heard)) == 400
    assert len(heard) - 400 <= model.FLUSH  # of what the killed task hadn't logged yet


def test_calls_in_flight(spark, place):
    folder, log = place
    df = requests(spark, [f"text {i:04}" for i in range(40)]).coalesce(1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        model.ask_once(df, Counting(folder, wait=0.1), log, in_flight=4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    spans = [tuple(map(float, c.split(" ")[:2])) for c in calls(folder)]
    most = max(sum(1 for x, y in spans if x <= a < y) for a, _ in spans)
    assert len(spans) == 40 and 2 <= most <= 4


def test_prompts_are_cut_for_compat_alone():
    long = "<a>" + "x" * 5000 + "</a>"
    assert long in model.prompt_for("formula_omml", long, "c" * 900) and "c" * 900 in model.prompt_for("formula_omml", long, "c" * 900)
    short = model.prompt_for("formula_omml", long, "c" * 900, compat=True)
    assert "c" * 300 in short and "c" * 301 not in short and len(short) < 3600
    assert "d" * 900 in model.prompt_for("image", None, "d" * 900) and "d" * 501 not in model.prompt_for("image", None, "d" * 900, compat=True)
