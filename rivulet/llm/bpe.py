"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is cut at safe boundaries before it is encoded: places that no match of the tokenizer's pattern can span,
so the ids of the parts, end to end, are those of the whole text. A long run of white space is one match by the pattern's
last two alternatives (less its last character, if more follows) and is encoded as one, outside the regular expression,
whose backtracking could not hold it. A long run of letters, numbers or marks alone has no boundary; it reaches the
expression whole, which matches it without backtracking.

Defined results: a null text counts as empty (no ids); repeated rows are encoded each; other columns, null or
clashing with the results' names, are ignored by :func:`encode` apart from those named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Characters of a part at least, before the next safe boundary ends it.
PART_CHARS = 1 << 16
#: Characters of white space from which on a run is encoded by itself.
LONG_RUN = 4096
#: Only where a run begins: else each place of a shorter run would be tried.
_BLANKS = regex.compile(rf"(?<!\s)\s{{{LONG_RUN},}}")
#: Before white space that follows something else, or between a letter and a number: no match spans these.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (base64 token and rank per line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safe(text: str, part: int = PART_CHARS) -> list[str]:
    """Cut a text into parts of ``part`` characters or more, each but the last ending at a safe boundary."""
    out, at = [], 0
    while len(text) - at > part:
        cut = _SAFE.search(text, at + part)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode_text(enc, text: str, part: int = PART_CHARS) -> list[int]:
    out, at = [], 0
    for run in _BLANKS.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += _encode_parts(enc, text[at : run.start()], part)
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + _encode_parts(enc, text[at:], part)


def _encode_parts(enc, text: str, part: int) -> list[int]:
    if len(text) <= part:
        return enc.encode_ordinary(text)
    return [i for x in split_safe(text, part) for i in enc.encode_ordinary(x)]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), part: int = PART_CHARS) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every whole text."""
    from pyspark.sql import types as T

    src = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*[f for f in src.schema.fields if f.name != "__text"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in pieces(batches, "__text"):
            ids = pa.array([encode_text(enc, x or "", part) for x in batch.column("__text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], [*keep, "ids"])

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``: the raw bytes of each row's ids (a null list: none)."""
    from pyspark.sql import types as T

    src = encoded.select(*keep, "ids")
    schema = T.StructType([*[f for f in src.schema.fields if f.name != "ids"], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = pa.array([enc.decode_bytes(x or []) for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], raw], [*keep, "decoded"])

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, part: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, and decoded from the ids, in one pass of a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in pieces(batches):
            counts, ids_digests, decoded_digests = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode_text(enc, text or "", part)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
