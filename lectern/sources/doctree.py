"""Files of known formats in a tree, listing apart from reading.

Spark's own binaryFile source hides names that begin with a dot or underscore and matches endings by case, so names, times and
sizes come from ``tree.listing``. A run lists first, drops what is done, and then reads the rest with ``with_content``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import FORMATS, SKIPPED_DIRS, format_of, path_parts, stem, suffix
from lectern.sources.tree import listing, opened

#: Files that a task of a run reads, about.
SLICE = 64


#: The setting that bounds batches on the way between readers.
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _size(text: str) -> int:
    """Bytes of a setting such as 64MB."""
    number, unit = text.strip().lower().rstrip("b"), 1
    if number[-1:] in "kmgt":
        number, unit = number[:-1], 1 << 10 * ("kmgt".index(number[-1]) + 1)
    return int(number) * unit


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files of known formats below root (schema FILES), in no order. A root that isn't there has none."""
    found = listing(spark, root, tuple(FORMATS), SKIPPED_DIRS)
    out = found.select("rel_path", path_parts("rel_path").alias("parts"), stem("rel_path").alias("stem"), suffix("rel_path").alias("ext"), format_of("rel_path").alias("format"), "mtime", "length")
    return out.where(F.col("format").isNotNull())


#: Bytes of files that one batch holds, beside its last file; and what a cell of a batch can hold at most, so larger files are
#: errors of their own.
BATCH_BYTES, MOST_BYTES = 64 << 20, (1 << 31) - (1 << 20)


def with_content(files: DataFrame, root: str, batch_bytes: int = BATCH_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """files with content, in batches bounded by bytes; a file that can't be read, or is too large, has null content and an error."""
    conf = files.sparkSession.conf
    if _size(conf.get(_BYTES, str((1 << 31) - 2))) > 4 * batch_bytes:  # a smaller setting of the user's own is left alone
        conf.set(_BYTES, str(4 * batch_bytes))

    def read(batches):
        import pyarrow as pa

        def sent(b, begin, content, error):
            columns = [c.slice(begin, len(content)) for c in b.columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], [*b.schema.names, "content", "error"])

        fs, base = opened(root)
        for b in batches:
            content, error, held, begin = [], [], 0, 0
            for k, rel in enumerate(b.column("rel_path").to_pylist()):
                data, said = None, None
                try:
                    with fs.open_input_file(f"{base}/{rel}") as f:
                        if f.size() > most:
                            said = f"larger than {most} bytes"
                        else:
                            data = f.read()
                except OSError as e:
                    said = str(e)
                if held and held + len(data or b"") > batch_bytes:
                    yield sent(b, begin, content, error)
                    content, error, held, begin = [], [], 0, k
                content.append(data)
                error.append(said)
                held += len(data or b"")
            if content:
                yield sent(b, begin, content, error)

    names = [x.split()[0] for x in schemas.FILES.split(", ")]
    return files.select(*names).mapInArrow(read, schemas.FILES + ", content binary, error string")
