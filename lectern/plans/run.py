"""The batch run: tree -> pending files -> extraction -> formulas, OCR, filter, figures, cleanup -> lint -> outputs -> index.

Every stage is DataFrame to DataFrame. What Python produced (extraction, model replies) is written once into the work
folder and read from there, so nothing is extracted or asked twice. The order of the stages matters: formulas and OCR come
before the filter, figures after it, so that filtered pictures are never sent.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import FORMULA_MIME, IMAGE_MIME, file_name, is_sentinel, media_type, strip, unwrap_reply
from lectern.operators import chunks, index, lint, markers, metrics, model, progress, sections
from lectern.plans import catalog
from lectern.shared import keep, remove
from lectern.sinks import read_files, write_files, write_lines
from lectern.sources.doctree import SLICE, discover, with_content
from lectern.sources.extract import asset_table, extract, formula_table, page_table, to_markdown
from lectern.sources.raster import Raster, blank_pages, formula_regions, render
from lectern.sources.tree import listing

#: The progress log: what each batch finished.
PROGRESS_LOG = f"{schemas.PROGRESS}, batch long"
#: What the index says of each output, and of which time of it.
ENTRIES = f"{schemas.MANIFEST}, mtime double, batch long"


log = logging.getLogger("lectern")
#: Steps between extraction and lint.
STEPS = 5


@dataclass
class Options:
    source: str
    output: str
    work: str
    provider: model.Provider
    compat: bool = False
    raster: Raster | None = None


@dataclass
class Report:
    discovered: int
    pending: int
    processed: int
    failed: int
    skipped: int
    lint_fixed: int
    lint_remaining: int
    calls: int
    cost: float
    aborted: str | None = None
    formats: dict[str, int] = field(default_factory=dict)
    tokens: tuple[int, int] = (0, 0)
    ocr: dict[str, int] = field(default_factory=dict)
    steps: dict[str, tuple[int, int]] = field(default_factory=dict)  # step -> characters after it, and how many it took or added
    seconds: dict[str, float] = field(default_factory=dict)  # step -> how long it took

    @property
    def exit_code(self) -> int:
        return 1 if self.failed or self.aborted else 0


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number of the next batch of a progress log."""
    last = catalog.read(spark, path, PROGRESS_LOG).agg(F.max("batch")).head()[0]
    return 0 if last is None else last + 1


def read_progress(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest row of each file in the progress log, of the batches before the given one if there is one."""
    log = catalog.read(spark, path, PROGRESS_LOG)
    log = log if before is None else log.where(F.col("batch") < before)
    return progress.latest(log, ["rel_path"], [F.col("batch")]).select("rel_path", "mtime", "output")


def write_progress(rows: DataFrame, path: str, batch: int) -> None:
    """What a batch finished, as a partition of the log: written again, it is the same partition."""
    catalog.write(rows.select("rel_path", "mtime", "output", F.lit(batch).cast("long").alias("batch")), path, "batch")


def _asked(requests: DataFrame, o: Options, name: str) -> tuple[DataFrame, DataFrame]:
    """Replies to requests, written, and the calls that were paid for."""
    if isinstance(o.provider, model.NoProvider):
        replies = _written(model.ask(requests, o.provider), f"{o.work}/replies_{name}")
        return replies, replies
    replies, calls = model.ask_once(requests, o.provider, f"{o.work}/asked", compat=o.compat)
    return _written(replies, f"{o.work}/replies_{name}"), calls


def _requests(found: DataFrame, assets: DataFrame, kind: str, table: dict[str, str]) -> DataFrame:
    """Markers whose picture exists, as requests."""
    joined = markers.existing(found, assets, "bytes")
    return joined.select("rel_path", "ordinal", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), F.col("context"), F.col("bytes").alias("image"), media_type("ref", table).alias("mime"))


def _formulas(docs: DataFrame, formulas: DataFrame, assets: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    m = markers.formula_lookup(docs, formulas, "rel_path").where("kind IS NOT NULL").drop("ref")
    base = m.select("rel_path", "ordinal", "formula_idx", "is_inline", "kind", "omml", "context", F.col("image_ref").alias("ref"))
    office = base.where("kind = 'omml'").select("rel_path", "ordinal", F.lit("formula_omml").alias("kind"), F.col("omml").alias("text"), "context", F.lit(None).cast("binary").alias("image"), F.lit(None).cast("string").alias("mime"))
    drawn = _requests(base.where("kind = 'region'").select("rel_path", "ordinal", "ref", "context"), assets, "formula_image", FORMULA_MIME)
    replies, calls = _asked(office.unionByName(drawn), o, "formula")
    latex = F.when(is_sentinel("reply", "UNCLEAR"), None).otherwise(unwrap_reply("reply"))
    new = base.select("rel_path", "ordinal", "is_inline").join(replies.select("rel_path", "ordinal", latex.alias("latex")), ["rel_path", "ordinal"], "left")
    has_key = not isinstance(o.provider, model.NoProvider)
    return markers.splice(docs, "rel_path", new.select("rel_path", "ordinal", markers.formula_text(F.col("latex"), F.col("is_inline"), has_key).alias("new")), "formula"), calls


def _ocr(docs: DataFrame, assets: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = markers.markers(docs, "rel_path", "ocr").withColumn("context", F.lit(None).cast("string"))
    replies, calls = _asked(_requests(found, assets, "ocr", IMAGE_MIME), o, "ocr")
    new = replies.select("rel_path", "ordinal", markers.ocr_text(model.sentinel_to_empty("reply", "BLANK_PAGE")).alias("new"))
    return markers.splice(docs, "rel_path", new, "ocr"), replies, calls


def _figures(docs: DataFrame, assets: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    found = markers.contexts(docs, "rel_path")
    replies, calls = _asked(_requests(found, assets, "image", IMAGE_MIME), o, "image")
    new = replies.select("rel_path", "ordinal", markers.figure_text(model.sentinel_to_empty("reply", "DECORATIVE")).alias("new"))
    return markers.splice(docs, "rel_path", new, "image"), calls


def _cleanup(docs: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Texts of 100 characters or more that weren't scanned are tidied; long ones in chunks (compat: only their beginning
    is sent, and the reply stands for the whole)."""
    todo = docs.where(~F.col("is_scanned") & (F.length(strip("markdown")) >= model.CLEANUP_LEAST))
    parts = F.array(F.substring("markdown", 1, model.CLEANUP_CAP)) if o.compat else chunks.chunks("markdown", model.CLEANUP_CAP)
    rows = todo.select("rel_path", F.posexplode(parts).alias("ordinal", "text"))
    rows = rows.select("rel_path", F.col("ordinal").cast("long").alias("ordinal"), F.lit("cleanup").alias("kind"), "text", F.lit(None).cast("string").alias("context"), F.lit(None).cast("binary").alias("image"), F.lit(None).cast("string").alias("mime"))
    replies, calls = _asked(rows, o, "cleanup")
    whole = replies.groupBy("rel_path").agg(F.min(F.coalesce(F.col("reply") != "", F.lit(False))).alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reply"))), lambda x: x["reply"]), "\n").alias("new"))
    out = docs.join(whole.where("`all`").select("rel_path", "new"), "rel_path", "left")
    return out.withColumn("markdown", F.coalesce("new", "markdown")).drop("new"), calls


def read_outputs(spark: SparkSession, root: str, with_index: bool = False) -> DataFrame:
    """path, markdown of the Markdown files below root; index files only on request."""
    return read_files(spark, _markdown_files(spark, root, with_index), root)


def _markdown_files(spark: SparkSession, root: str, with_index: bool = False) -> DataFrame:
    found = listing(spark, root, (".md",)).where(F.col("rel_path").endswith(".md"))
    return found if with_index else found.where(file_name("rel_path") != "index.md")


def entries_of(spark: SparkSession, output: str, state: str | None = None) -> DataFrame:
    """What the index says of every output. With a state, the table of what it said last, only files that are new or have
    another time are read; those that are gone go."""
    if state is None:
        return keep(index.manifest(read_outputs(spark, output)))
    found = keep(_markdown_files(spark, output).select("rel_path", "mtime"))
    log = catalog.read(spark, state, ENTRIES)
    last = log.agg(F.max("batch")).head()[0]
    had = log.where(F.col("batch") == F.lit(last)).drop("batch")
    here = found.withColumnRenamed("rel_path", "path")
    same = had.join(here, ["path", "mtime"], "left_semi")
    fresh = here.join(had.select("path", "mtime"), ["path", "mtime"], "left_anti")
    said = index.manifest(read_files(spark, fresh.select(F.col("path").alias("rel_path")), output)).join(fresh, "path")
    batch = 0 if last is None else last + 1
    catalog.write(same.unionByName(said).withColumn("batch", F.lit(batch).cast("long")), state, "batch")
    if last:  # the version before stays for those who read it now, older ones go
        remove(spark, f"{state}/batch={last - 1}")
    return catalog.read(spark, state, ENTRIES).where(F.col("batch") == batch).drop("batch", "mtime")


def write_index(spark: SparkSession, output: str, state: str | None = None) -> int:
    """index.md and manifest.json of all outputs; nothing is written if there are none. Returns their number."""
    entries = entries_of(spark, output, state)
    n = entries.count()
    if n:
        write_lines(index.index_rows(entries, n), index.INDEX_ORDER, output, "index.md")
        write_lines(index.manifest_rows(entries), index.MANIFEST_ORDER, output, "manifest.json")
    return n


def run(spark: SparkSession, o: Options, files: DataFrame | None = None) -> Report:
    """One run over a tree, or over the given files of it (schema FILES). A file that fails isn't tracked and comes again; the
    index is always rebuilt."""
    files = _written(discover(spark, o.source) if files is None else files, f"{o.work}/files")
    done = read_progress(spark, f"{o.work}/progress")
    todo = progress.pending(files, done)
    discovered, pending = files.count(), todo.count()
    report = Report(discovered, pending, 0, 0, discovered - pending, 0, 0, 0, 0.0)
    report.formats = {r["format"]: r["files"] for r in progress.format_counts(files).orderBy("format").collect()}
    if pending:
        x = _written(extract(with_content(todo.repartition(-(-pending // SLICE)), o.source), o.compat), f"{o.work}/extracted")
        report.failed = x.where("error IS NOT NULL").count()
        drawn_pages = o.raster is not None
        assets, formulas = asset_table(x, drawn_pages), formula_table(x)
        if o.raster is not None:
            pages = page_table(x, drawn_pages)
            regions = formula_regions(formulas, pages)
            wanted = blank_pages(pages).unionByName(regions.drop("formula_idx"))
            drawn = _written(render(todo, o.source, wanted, o.raster), f"{o.work}/drawn")
            assets = assets.unionByName(drawn)
            have = regions.join(drawn.select("rel_path", "ref"), ["rel_path", "ref"], "left_semi").select("rel_path", "formula_idx", F.col("ref").alias("drawn"))
            formulas = formulas.join(have, ["rel_path", "formula_idx"], "left").withColumn("image_ref", F.coalesce("image_ref", "drawn")).drop("drawn")
        assets = _written(assets, f"{o.work}/assets")
        write_files(assets.select("ref", "bytes"), o.work)
        docs = _written(to_markdown(x, drawn_pages).withColumn("chars", F.length("markdown").cast("long")), f"{o.work}/docs_raw")
        write_files(progress.outputs(docs).where("wins").select("out_path", "markdown"), f"{o.work}/raw")

        def step(name: str, after: DataFrame) -> DataFrame:
            """What a step made, written with its length beside the one before it, so nothing is read again to know what it did."""
            began = time.monotonic()
            after = after.withColumn("was", F.col("chars")).withColumn("chars", F.length("markdown").cast("long"))
            after = _written(after, f"{o.work}/docs_{name}")
            facts = after.select("rel_path", F.lit(name).alias("step"), "chars", (F.col("chars") - F.col("was")).alias("delta"))
            catalog.write(facts, f"{o.work}/steps", "step")
            sums = facts.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum("delta"), F.lit(0)), F.count("*")).head()
            report.steps[name], report.seconds[name] = (sums[0], sums[1]), time.monotonic() - began
            log.info("step %d of %d, %s: %d of %d files, %d characters, %+d, %.1f s", len(report.steps), STEPS, name, sums[2], pending, sums[0], sums[1], report.seconds[name])
            return after

        try:
            spelt, c1 = _formulas(docs, formulas, assets, o)
            docs = step("formulas", spelt)
            read, heard, c2 = _ocr(docs, assets, o)
            docs = step("ocr", read)
            docs = step("filtered", sections.filter_content(docs, compat=o.compat))
            told, c3 = _figures(docs, assets, o)
            docs = step("figures", told)
            tidied, c4 = _cleanup(docs, o)
            docs = step("cleanup", tidied)
            report.ocr = metrics.reply_outcomes(heard).head().asDict()
            paid = [c.select("status", "prompt_tokens", "completion_tokens", "cost").where("status <> 'no_key'") for c in (c1, c2, c3, c4)]
        except Exception as e:  # noqa: BLE001  a provider that is down ends the run, not the index
            if "ProviderDown" not in str(e):
                raise
            report.aborted = "the model provider doesn't answer"
            report.failed += 1
        if report.aborted is None:
            final = _written(lint.lint(progress.outputs(docs), compat=o.compat), f"{o.work}/docs")
            write_files(final.where("wins").select("out_path", "markdown"), o.output)
            marked = final.join(files.select("rel_path", "mtime"), "rel_path").select("rel_path", "mtime", F.col("out_path").alias("output"))
            write_progress(marked, f"{o.work}/progress", next_batch(spark, f"{o.work}/progress"))
            totals = lint.lint_totals(final).head()
            report.processed, report.lint_fixed, report.lint_remaining = totals["files"], totals["fixed"], totals["remaining"]
            used = metrics.usage_totals(reduce(DataFrame.unionByName, paid)).head()
            report.calls, report.cost, report.tokens = used["calls"], used["cost"] or 0.0, (used["prompt_tokens"], used["completion_tokens"])
    write_index(spark, o.output, f"{o.work}/entries")
    return report


def lint_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, fixed_count, remaining_failures, fast_mode of all Markdown files below root, which are rewritten if changed."""
    # Written before any file is changed: results must not be worked out from changed files.
    after = keep(lint.lint(read_outputs(spark, root, with_index=True).withColumn("was", F.col("markdown"))))
    write_files(after.where("markdown <> was").select("path", "markdown"), root)
    return after.select("path", "fixed_count", "remaining_failures", "fast_mode")
