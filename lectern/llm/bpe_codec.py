"""BPE encoding and decoding with forced boundaries.

The vocabulary is looked at as words over 512 symbols: a byte inside a word, or the last byte of one. Two symbols that never
stand side by side in any token can't be joined by any merge, so between them there is a certain cut. The end of a word is
such a cut too, as no token goes on after it. A whole text becomes an array of symbols; one table look-up for each pair of
neighbours cuts it into fragments, a few bytes long in most texts. Merges in one fragment never touch another, so each distinct
fragment is encoded by itself, once, and the ids are put together in order.

What comes before the merges is the file's own: its special tokens are found in the raw text, its normaliser runs over what
lies between, and the classes of code points that its word pattern names (letters, numbers, white space) are asked of the
library that will be compared with, once, on the driver. A file with other parts than these is refused.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded as often as they stand, a null
doc_id stays null, an empty table gives no rows, and further columns of any name are left out. A text of any length is one
array; time and memory are linear in it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from lectern.llm.runtime import only, small_batches
from lectern.llm.words import lean

# Fixed values of the file format: the word pattern that the vocabulary was made with, and its mark of a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Symbols of words: bytes, and bytes that end one. In strings of symbols the first is LETTER.
SYMBOLS, LETTER = 512, 0x100
OTHER, LETTERS, NUMBER, SPACE = 0, 1, 2, 3
#: Distinct fragments that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, REMEMBERED_SYMBOLS = 500_000, 64


def byte_of() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTERS, NUMBER, SPACE or OTHER for each code point, by the tables of the tokenizers library."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # no surrogates
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTERS, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (lo, hi) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[codes[lo:hi]] = kind
    return out


class Codec:
    """encode(text) to ids and decode(ids) to text, as the tokenizers library does with the file at path."""

    def __init__(self, path: str, kinds: np.ndarray):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added = held["model"], held["added_tokens"]
        split = [x for x in (held["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if (
            model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or any(model.get(x) for x in ("continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout")) or held["decoder"]
            or [x["pattern"]["Regex"] for x in split] != [PATTERN] or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        ):
            raise ValueError(f"{path} is not a byte-level BPE file with word ends")
        self.kinds, self.normalizer = kinds, Tokenizer.from_file(path).normalizer
        self.special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        vocabulary = model["vocab"]
        self.names = np.full(max([*vocabulary.values(), *(x["id"] for x in added)]) + 1, "", object)
        for word, i in [*vocabulary.items(), *((x["content"], x["id"]) for x in added)]:
            self.names[i] = word
        # The same vocabulary over symbols, and which symbols stand side by side in it.
        byte, symbols = byte_of(), {}
        apart = np.ones((SYMBOLS, SYMBOLS), bool)
        for word in vocabulary:
            if word in self.special:
                continue
            ends = word.endswith(WORD_END)
            s = [byte[c] for c in (word[: -len(WORD_END)] if ends else word)]
            s[-1] += 256 * ends
            apart[s[:-1], s[1:]] = False
            symbols[word] = "".join(chr(LETTER + x) for x in s)
        if sum(len(x) == 1 for x in symbols.values()) != SYMBOLS:
            raise ValueError(f"{path} has no token for some byte")
        self.apart = apart.ravel()
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merge = Tokenizer(models.BPE({symbols[w]: i for w, i in vocabulary.items() if w in symbols}, [(symbols[a], symbols[b]) for a, b in merges]))
        self.held: dict[str, bytes] = {}

    def symbols(self, text: str) -> np.ndarray:
        """The symbols of a normalised text's words, without what lies between them."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kinds[codes]
        before = np.append(np.uint8(SPACE), kind[:-1])
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        at = np.flatnonzero((codes == ord("'")) & (before != OTHER))
        if len(at):  # 's 't 'm 'd and 're 've 'll are words of their own where no other sign comes before
            one, two = (np.append(codes, [0, 0])[at + k] for k in (1, 2))
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[at[short | long] + 1] = False
            nexts = np.concatenate([at[short] + 2, at[long] + 3])
            nexts = nexts[nexts < len(codes)]
            start[nexts] |= kind[nexts] != SPACE
        inside = kind != SPACE
        ends = inside & np.append(start[1:] | ~inside[1:], True)
        data = np.frombuffer(codes[inside].tobytes().decode("utf-32-le").encode(), np.uint8)
        lead = (data & 0xC0) != 0x80
        last = np.append(lead[1:], True) & ends[inside][np.cumsum(lead) - 1]
        return data + np.uint16(256) * last

    def fragments(self, text: str) -> list[str]:
        """Strings of symbols between certain cuts."""
        s = self.symbols(text).astype(np.int64)
        if not len(s):
            return []
        cut = np.append(False, self.apart[s[:-1] * SYMBOLS + s[1:]])
        out = np.full(len(s) + int(cut.sum()), ord(" "), "<u2")
        out[np.arange(len(s)) + np.cumsum(cut)] = s + LETTER
        return out.tobytes().decode("utf-16-le").split(" ")

    def _merged(self, fragment: str) -> bytes:
        got = np.array(self.merge.encode(fragment).ids, "<u4").tobytes()
        if len(fragment) <= REMEMBERED_SYMBOLS:
            if len(self.held) >= REMEMBERED:
                self.held.clear()
            self.held[fragment] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get = self.held.get
        for part in self.parts.split(text or "") if self.parts else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [get(x) or self._merged(x) for x in self.fragments(self.normalizer.normalize_str(part) if self.normalizer else part)]
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Names of the ids with a space between any two, as there is no decoder in the file; unknown ids are left out."""
        at = np.frombuffer(ids or b"", "<u4")
        names = self.names[at[at < len(self.names)]]
        return " ".join(x for x in names.tolist() if x)


_codecs: dict[str, Codec] = {}


def codec(path: str, kinds: np.ndarray) -> Codec:
    """One codec a worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path, kinds)
    return _codecs[path]


def _mapped(df: DataFrame, path: str, source: str, target: str, kind: DataType, how: str) -> DataFrame:
    kinds = df.sparkSession.sparkContext.broadcast(classes())  # a byte for each code point
    arrow = pa.binary() if kind == BinaryType() else pa.string()

    def run(batches):
        lean()
        one = getattr(codec(path, kinds.value), how)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x) for x in b.column(source).to_pylist()], arrow)], [*b.schema.names, target])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(target, kind)]))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every row's text by the tokenizers file at path (on the executors), packed."""
    small_batches(docs.sparkSession)
    return _mapped(only(docs, "doc_id", "text"), path, "text", "ids", BinaryType(), "encode").drop("text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the text of packed ids."""
    small_batches(encoded.sparkSession)
    return _mapped(only(encoded, "doc_id", "ids"), path, "ids", "decoded", StringType(), "decode")
