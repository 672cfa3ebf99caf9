"""The model as five scalar functions behind a provider protocol, called by iterator over Arrow batches.

A request is known by its content: equal ones are asked once (``ask_once``), and replies are logged as they come, so a task
that is run again, or another run, pays for nothing twice.

A reply is a status and a text: ``ok`` with a text (empty: nothing there), ``skip`` (the request can't be answered, keep
what was there), ``no_key`` (no provider). A provider that is down raises ProviderDown, which fails the run. Only rows that
are sent go through Python: callers route by filter, since a condition around a Python function doesn't stop it.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from dataclasses import asdict, dataclass
from typing import Protocol
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.shared import keep

ATTEMPTS, FATAL = 5, (401, 403, 404)
OMML_CAP, CONTEXT_CAP, IMAGE_CONTEXT_CAP, CLEANUP_CAP, CLEANUP_LEAST = 3000, 300, 500, 10_000, 100
KEY = "OPENROUTER_API_KEY"
ENDPOINT = "https://openrouter.ai/api/v1/chat/completions"
DEFAULT_MODEL = "mistralai/mistral-small-2603"


class ProviderDown(RuntimeError):
    """The provider is set up but doesn't answer: the run ends."""


class BadRequest(ValueError):
    """The provider won't take this request: the item is skipped."""


@dataclass
class Reply:
    status: str
    text: str | None = None
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost: float = 0.0


class Provider(Protocol):
    """Answers a prompt, with a picture if there is one."""

    def ask(self, prompt: str, image: bytes | None, mime: str | None) -> Reply: ...


@dataclass
class NoProvider:
    """Without a key every request stays unanswered."""

    def ask(self, prompt: str, image: bytes | None, mime: str | None) -> Reply:
        return Reply("no_key")


@dataclass
class Scripted:
    """Replies by what a prompt contains, for tests: (part of the prompt, reply or exception name)."""

    script: list[tuple[str, str | None]]

    def ask(self, prompt: str, image: bytes | None, mime: str | None) -> Reply:
        for part, text in self.script:
            if part in prompt:
                if text == "!400":
                    raise BadRequest(part)
                if text == "!down":
                    raise ProviderDown(part)
                return Reply("ok", text, len(prompt) // 4, len(text or "") // 4, 0.001)
        return Reply("ok", "")


@dataclass
class Http:
    """A chat-completions endpoint, retried with waits of 2, 4, 8 and 16 seconds."""

    key: str
    model: str = DEFAULT_MODEL
    url: str = ENDPOINT
    wait: float = 2.0

    def ask(self, prompt: str, image: bytes | None, mime: str | None) -> Reply:
        content: object = prompt
        if image is not None:
            content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": data_uri(image, mime or "image/png")}}]
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": content}]}).encode()
        request = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        last: Exception | None = None
        for attempt in range(ATTEMPTS):
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    got = json.load(r)
                used = got.get("usage") or {}
                return Reply("ok", got["choices"][0]["message"]["content"], used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0, used.get("cost") or 0.0)
            except urllib.error.HTTPError as e:
                if e.code == 400:
                    raise BadRequest(str(e)) from e
                if e.code in FATAL:
                    raise ProviderDown(str(e)) from e
                last = e
            except (OSError, KeyError, ValueError) as e:
                last = e
            if attempt + 1 < ATTEMPTS:
                time.sleep(self.wait * 2**attempt)
        raise ProviderDown(f"no answer after {ATTEMPTS} attempts: {last}")


def from_environment(model: str = DEFAULT_MODEL, file: str = ".env") -> Provider:
    """The provider that the environment, else a file of NAME=value lines, has a key for."""
    key = os.environ.get(KEY)
    if not key and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            pairs = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
        key = next((v.strip().strip("\"'") for k, _, v in pairs if k.strip() == KEY), None)
    return Http(key, model) if key else NoProvider()


def data_uri(data: bytes, mime: str) -> str:
    return f"data:{mime};base64,{base64.b64encode(data).decode()}"


_NOISE = ("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}rPr", "{http://schemas.openxmlformats.org/officeDocument/2006/math}ctrlPr", "{http://schemas.openxmlformats.org/officeDocument/2006/math}fPr")


def clean_omml(xml: str) -> str:
    """A formula's XML without formatting properties; what isn't well-formed stays as it is."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return xml
    for parent in list(root.iter()):
        for child in [x for x in parent if x.tag in _NOISE]:
            parent.remove(child)
    return ET.tostring(root, encoding="unicode")


def prompt_for(kind: str, text: str | None, context: str | None, compat: bool = False) -> str:
    """What is asked for each kind of request. compat: contexts and formulas are cut at fixed lengths."""
    cut = lambda x, n: (x or "")[:n] if compat else x or ""
    if kind == "ocr":
        return "Transcribe all text on this page as Markdown and answer with the text alone. If the page is empty, answer BLANK_PAGE."
    if kind == "image":
        return f"Describe this figure for a reader who can't see it. Give a diagram as a fenced mermaid block. If it only decorates, answer DECORATIVE. Text around it: {cut(context, IMAGE_CONTEXT_CAP)}"
    if kind == "formula_image":
        return f"Write the formula in this picture as LaTeX, without delimiters. If it can't be read, answer UNCLEAR. Text around it: {cut(context, CONTEXT_CAP)}"
    if kind == "formula_omml":
        return f"Write this Office formula as LaTeX, without delimiters. If it makes no sense, answer UNCLEAR. Text around it: {cut(context, CONTEXT_CAP)}\n{cut(clean_omml(text or ''), OMML_CAP)}"
    if kind == "cleanup":
        return f"Tidy this extracted Markdown: mend broken lines and tables, drop page furniture, keep every statement. Answer with the Markdown alone.\n\n{text or ''}"
    raise ValueError(f"unknown kind of request: {kind}")


_ASKED = ("kind", "text", "context", "image", "mime")


def ask(requests: DataFrame, provider: Provider, compat: bool = False) -> DataFrame:
    """requests (id columns, kind, text, context, image, mime) with status, reply, prompt_tokens, completion_tokens, cost.

    The result should be written before it is used: each evaluation asks again.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for kind, text, context, image, mime in zip(*(b.column(c).to_pylist() for c in ("kind", "text", "context", "image", "mime"))):
                try:
                    out.append(provider.ask(prompt_for(kind, text, context, compat), image, mime))
                except BadRequest:
                    out.append(Reply("skip"))
            keys = [c for c in b.schema.names if c not in ("kind", "text", "context", "image", "mime")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keys), b.column("kind"), pa.array([r.status for r in out], pa.string()), pa.array([r.text for r in out], pa.string()), pa.array([r.prompt_tokens for r in out], pa.int64()), pa.array([r.completion_tokens for r in out], pa.int64()), pa.array([r.cost for r in out], pa.float64())],
                [*keys, "kind", "status", "reply", "prompt_tokens", "completion_tokens", "cost"],
            )

    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema if f.name not in ("kind", "text", "context", "image", "mime")]
    order = [f.name for f in requests.schema if f.name not in ("kind", "text", "context", "image", "mime")]
    fields = ", ".join([*keys, "kind string", schemas.REPLIES.replace("text string", "reply string")])
    return requests.select(*order, "kind", "text", "context", "image", "mime").mapInArrow(run, fields)


def request_name(by: str) -> Column:
    """A name for what is asked of whom, from the columns of a request: lengths keep the parts apart, a null is no empty text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.sha2(F.col(c).cast("binary"), 256)), F.lit("-"))
    return F.sha2(F.concat_ws("|", F.lit(by), *map(part, _ASKED)).cast("binary"), 256)


def by_content(requests: DataFrame, by: str) -> DataFrame:
    """requests with their name."""
    return requests.withColumn("name", request_name(by))


#: Parts of the reply log, by the first digits of a request's name; replies that a task holds before it logs them.
DIGITS, FLUSH = 2, 20


def _logged(fs, folder: str) -> dict[str, Reply]:
    """The replies in one part of the log."""
    from pyarrow.fs import FileSelector

    out = {}
    for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                for line in f.read().decode().splitlines():
                    held = json.loads(line)
                    name = held.pop("name")
                    out[name] = Reply(**held)
    return out


def _append(fs, folder: str, replies: dict[str, Reply]) -> None:
    if replies:
        fs.create_dir(folder, recursive=True)
        new = f"{folder}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{new}.new") as f:
            f.write("".join(json.dumps({"name": n, **asdict(r)}) + "\n" for n, r in replies.items()).encode())
        fs.move(f"{new}.new", f"{new}.json")


def ask_once(requests: DataFrame, provider: Provider, log: str, in_flight: int = 4, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The replies of ask() and the calls (name, status, prompt_tokens, completion_tokens, cost) that were paid for now.

    Equal requests are asked once. Replies go to the log, a folder that all machines reach, as they come: FLUSH of them are
    lost at most when a task dies. What the log has isn't asked again, by whichever task or run. A task has in_flight
    calls under way at a time. Two tasks that run the same rows at the same time may both ask.
    """
    spark = requests.sparkSession
    named = keep(by_content(requests, f"{type(provider).__name__}:{getattr(provider, 'model', '')}:{compat}"))
    distinct = named.select("name", *_ASKED).dropDuplicates(["name"]).withColumn("part", F.substring("name", 1, DIGITS))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        from lectern.sources.tree import opened

        fs, base = opened(log)
        part, known = None, {}

        def one(row) -> Reply:
            try:
                return provider.ask(prompt_for(row["kind"], row["text"], row["context"], compat), row["image"], row["mime"])
            except BadRequest:
                return Reply("skip")

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                out = []
                rows = b.to_pylist()
                for k in range(0, len(rows), FLUSH):
                    todo = []
                    for row in rows[k : k + FLUSH]:
                        if row["part"] != part:
                            part = row["part"]
                            known |= _logged(fs, f"{base}/{part}")
                        if row["name"] not in known:
                            todo.append((row, pool.submit(one, row)))
                    fresh: dict[str, dict[str, Reply]] = {}
                    said, failed = {}, None
                    for row, future in todo:  # what came is logged, also if another call ends the run
                        try:
                            reply = said[row["name"]] = future.result()
                        except Exception as e:  # noqa: BLE001  raised again below
                            failed = failed or e
                            continue
                        if reply.status != "no_key":
                            fresh.setdefault(row["part"], {})[row["name"]] = reply
                    for p, replies in fresh.items():
                        _append(fs, f"{base}/{p}", replies)
                    if failed:
                        raise failed
                    for row in rows[k : k + FLUSH]:
                        new = row["name"] in said
                        out.append({"name": row["name"], "fresh": new, "r": said[row["name"]] if new else known[row["name"]]})
                    known = {} if len(known) > 100_000 else known
                    part = part if known else None
                yield pa.RecordBatch.from_pylist([{"name": x["name"], "fresh": x["fresh"], "status": x["r"].status, "reply": x["r"].text, "prompt_tokens": x["r"].prompt_tokens, "completion_tokens": x["r"].completion_tokens, "cost": x["r"].cost} for x in out], schema)

    import pyarrow as pa

    schema = pa.schema([("name", pa.string()), ("fresh", pa.bool_()), ("status", pa.string()), ("reply", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("cost", pa.float64())])
    dealt = distinct.repartition(width, "part").sortWithinPartitions("part")
    told = keep(dealt.mapInArrow(run, "name string, fresh boolean, " + schemas.REPLIES.replace("text string", "reply string")))
    keys = [c for c in requests.columns if c not in _ASKED]
    replies = named.select(*keys, "kind", "name").join(told.drop("fresh"), "name").select(*keys, "kind", "status", "reply", "prompt_tokens", "completion_tokens", "cost")
    return replies, told.where("fresh").select("name", "status", "prompt_tokens", "completion_tokens", "cost")


def sentinel_to_empty(reply, word: str):
    """The reply with the word that stands for nothing turned into an empty text."""
    from lectern.functions.text import _c, is_sentinel

    return F.when(is_sentinel(reply, word), "").otherwise(_c(reply))
