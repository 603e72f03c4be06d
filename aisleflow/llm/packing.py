"""Packing by powers of two.

A document's tokens, its end mark included, are cut into pieces of ``seq_len`` and then into the powers of two of which
the rest's length is the sum, largest first. Each piece is a sequence of its own, so no sequence crosses documents and
none holds padding; equal lengths share a bucket, from which batches of one shape are drawn. Nothing is gathered:
the cut is local to a document, and a sequence's number holds its bucket in the low four bits (its log2) above which
stands Spark's unique row number, so numbering needs no shuffle however hot a bucket is. The numbers of a repeated task are
the same: short texts are read and cut in the order of their file, long ones come from groups that Spark sorts by key.

Defined results: null ids count as none, so such a document is its end mark alone; repeated rows are packed each;
other columns go unless named in ``keep``; an empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _arrow, slices


def cut_points(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    out, at = [], 0
    while n - at >= seq_len:
        out.append((at, seq_len))
        at += seq_len
    bit = seq_len >> 1
    while at < n:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", seq_len: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, ids (if asked for), sequence_id, offset, bucket."""
    if seq_len < 1 or seq_len & (seq_len - 1) or seq_len > 1 << 15:
        raise ValueError("seq_len must be a power of two up to 32768")
    schema = T.StructType([df.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def pieces(batches):
        target = _arrow(schema)
        for batch in slices(batches):
            ids, docs = batch.column(batch.schema.get_field_index(ids_col)), batch.column(batch.schema.get_field_index(id_col))
            flat, ends, none = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_null().to_pylist()
            own, start, length, crc, total, parts = [], [], [], [], [], []
            for k in range(len(ids)):
                a = np.append(flat[ends[k] : ends[k + 1]] if not none[k] else flat[:0], end_id).astype("<u4")
                raw = memoryview(a).cast("B")
                for s, n in cut_points(len(a), seq_len):
                    own.append(k), start.append(s), length.append(n), total.append(len(a))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    if with_ids:
                        parts.append(a[s : s + n])
            cols = [docs.take(pa.array(own, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            if with_ids:
                flat_parts = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]).astype(np.int32)), pa.array(flat_parts)))
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    out = df.select(id_col, ids_col).mapInArrow(pieces, schema)
    bucket = F.log2(F.col("length")).cast("int")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id() * 16 + bucket, "offset": F.lit(0).cast("long"), "bucket": bucket})
