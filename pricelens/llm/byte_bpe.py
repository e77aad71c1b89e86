"""Byte-level BPE by a local rank file: texts to token ids and back.

Long texts are cut where the splitting pattern ends a match whatever follows, so no piece depends on the cut and
memory follows the part, not the text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from pricelens.llm.common import append, texts

#: Characters of a text that are encoded at once, unless no safe boundary follows.
PART = 1 << 15

#: Every match of the pattern ends between a character and white space. Python's \S excludes a few more characters
#: than the pattern's, which only makes this stricter.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")

#: White space without end is one match of the pattern but for its last character.
_LONG_SPACE = re.compile(r"[ \n\t\r]{4096,}")


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts cut at safe boundaries. A part can be longer where none follows."""
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text, the same as from encoding it whole.

    A very long run of white space is encoded as the pattern splits it: all but its last character is one match
    (all of it at the end of the text), found here without the pattern's search back through the run."""
    out = []
    for part in parts(text):
        at = 0
        for run in _LONG_SPACE.finditer(part):
            end = run.end()
            after = part[end : end + 1]
            if after.isspace() or (run.start() and part[run.start() - 1].isspace()):
                continue  # a run that goes on with rarer white space is left to the pattern
            last = end - 1 if after else end
            out.append(_ids(enc, part[at : run.start()]))
            out.append(np.array(enc._core_bpe.encode_single_piece(part[run.start() : last].encode()), np.int32))
            at = last
        out.append(_ids(enc, part[at:]))
    return out[0] if len(out) == 1 else np.concatenate(out)


def _ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), np.int32)


def encode(df: DataFrame, rank_file: bytes, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids` array<int>, the text's token ids without special tokens.

    A null or empty text gives an empty array. Repeated rows stay. Other columns stay as they are; one named like
    the new column is replaced. `rank_file` holds the lines of a rank file; it is sent to each task."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        enc = encoding(ranks.value, pattern)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = [encode_text(enc, t) for t in texts(part, text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

        return work

    return append(df, text, [StructField(ids, ArrayType(IntegerType()))], make)


def decode(df: DataFrame, rank_file: bytes, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded` binary, the bytes that the ids stand for.

    Bytes, not text: ids cut from a longer list can end inside a character. Null ids give no bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file)
    size = "_n_ids"
    sized = df.withColumn(size, F.coalesce(ids, F.array().cast("array<int>")))

    def make():
        enc = encoding(ranks.value, pattern)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([enc.decode_bytes(x) for x in part.column(size).to_pylist()], pa.binary())]

        return work

    return _by_ids(sized, size, decoded, make).drop(size)


def encode_and_decode(
    df: DataFrame, rank_file: bytes, pattern: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """`decode(encode(df))` with one Python worker for both: adds `ids` and `decoded`."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file)

    def make():
        enc = encoding(ranks.value, pattern)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = [encode_text(enc, t) for t in texts(part, text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            back = pa.array([enc.decode_bytes(x.tolist()) for x in found], pa.binary())
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), back]

        return work

    return append(df, text, [StructField(ids, ArrayType(IntegerType())), StructField(decoded, BinaryType())], make)


def _by_ids(df: DataFrame, ids: str, decoded: str, make) -> DataFrame:
    """Like common.append, in parts of a bounded number of ids."""
    from pyspark.sql.types import StructType

    kept = [c for c in df.columns if c != decoded]
    schema = StructType([*(df.schema[c] for c in kept), StructField(decoded, BinaryType())])

    def run(batches):
        work = make()
        for batch in batches:
            lengths = np.diff(batch.column(ids).offsets.to_numpy())
            start = total = 0
            cuts = []
            for i, n in enumerate(lengths.tolist()):
                if i > start and total + n > 1 << 19:
                    cuts.append((start, i))
                    start, total = i, 0
                total += n
            cuts.append((start, batch.num_rows))
            for a, b in cuts:
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(part)], names=[*kept, decoded])

    return df.mapInArrow(run, schema)
