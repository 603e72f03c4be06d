"""BPE encoding and decoding with a tokenizers JSON file.

Short texts are encoded where they lie, without a shuffle. A text above ``piece_chars`` is cut in halves, and these in
halves until they fit, wherever the middle falls, inside words too. The pieces are encoded in parallel tasks. Neighbours
are joined as a tree: a window around the join is re-encoded and doubled until its tokens agree with those of both sides,
character by character and id by id, or until it holds the whole unsplit text around the join (white space, which no
token spans under the tokenizers for which ``cuts_at_space`` holds, bounds it); a valid BPE sequence is one whose neighbouring tokens are valid, so the joined one is exact.

Defined results: a null text counts as empty and gives an empty list; a null list decodes as an empty one; columns of
the input stay as they are (an input column with the name of the output is replaced); repeated rows are encoded each.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_CHARS = 65_536
CACHE_WORDS = 100_000

#: Fixed values of the public tokenizer file: its pattern, and the letters for which Python's `re` and lower() give what that pattern and normaliser give.
CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zß-öø-ÿ"
PLAIN = re.compile("[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\x09-\x0d\x200-9{LETTERS}]+")
WORD = re.compile("[^\x09-\x0d\x20]+")
SPACE = re.compile("[\x09-\x0d\x20]")


def _byte_letters() -> list[str]:
    """The visible character by which byte-level BPE writes each byte: printable Latin-1 itself, the others from U+0100 on."""
    shown = {b for b in range(256) if chr(b).isprintable() and chr(b) != " "}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


BYTES = _byte_letters()


class _Ids(dict):
    """Pretoken to its ids as little-endian bytes; emptied when full, so that its memory is bounded."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if self.codec.cuts_at_space and PLAIN.fullmatch(word) and word == word.lower() and PRETOKEN.fullmatch(word):
            found = [t.id for t in self.codec.tokenizer.model.tokenize("".join([BYTES[b] for b in word.encode()]))]
        else:
            found = self.codec.tokenizer.encode(word, add_special_tokens=False).ids
        ids = np.array(found, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    """One tokenizer in a worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.cuts_at_space = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": CLIP_SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.ids = _Ids(self)
        self.tokens = None
        if spec["decoder"] is None:
            self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts_at_space:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        plain = PLAIN.fullmatch(text) and not any(x in text for x in self.added)
        parts = PRETOKEN.findall(text.lower()) if plain else WORD.findall(text)
        return np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), "<u4")

    def encode_at(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(id, first character, end) of each token, counted from ``at``."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join([self.tokens[i] for i in ids.tolist()])

    def cut(self, text: str, size: int) -> list[tuple[int, bool]]:
        """(start, whether it begins inside unsplit text) of each piece: halves, and halves of these, until they fit."""

        def halves(a: int, b: int) -> list[tuple[int, bool]]:
            if b - a <= size:
                return []
            mid = (a + b) // 2
            return [*halves(a, mid), (mid, True), *halves(mid, b)]

        return [(0, False), *halves(0, len(text))]

    def join(self, left: list, right: list, text: str, begin: int, cut: int, end: int, window: int = 64) -> list:
        """Tokens of text[begin:end] from those of its parts before and after ``cut``; positions are absolute, text starts at 0."""
        before, after = {x: k for k, x in enumerate(left)}, {x: k for k, x in enumerate(right)}
        while True:
            a, b = max(begin, cut - window), min(end, cut + window)
            mid = self.encode_at(text[a:b], a)
            i = j = None
            if a == begin:
                i, li = 0, 0
            else:
                for k in range(1, len(mid) - 1):
                    li = before.get(mid[k])
                    if li is not None and before.get(mid[k + 1]) == li + 1 and mid[k + 1][2] < cut:
                        i = k
                        break
            if b == end:
                j, rj = len(mid), len(right)
            else:
                for k in range(len(mid) - 2, 0, -1):
                    rj = after.get(mid[k])
                    if rj is not None and after.get(mid[k - 1]) == rj - 1 and mid[k - 1][1] > cut:
                        j = k
                        break
            if i is not None and j is not None:
                return left[:li] + mid[i:j] + right[rj:]
            window *= 2

    def tree(self, pieces: list[tuple[int, int, list]], text: str) -> list:
        """Join neighbours, then neighbours of these, until one is left. pieces: (begin, end, tokens)."""
        while len(pieces) > 1:
            pieces = [
                (x[0][0], x[1][1], self.join(x[0][2], x[1][2], text, x[0][0], x[1][0], x[1][1])) if len(x) == 2 else x[0]
                for x in (pieces[k : k + 2] for k in range(0, len(pieces), 2))
            ]
        return pieces[0][2]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def slices(batches, rows: int = 128):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """df with ``out_col`` array<int>: the ids of each whole text, without special tokens added."""
    df = df.drop(out_col) if out_col in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def whole(batches):
        c = codec(tokenizer_path)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield _with(batch, out_col, _lists([c.encode(t or "") for t in texts]))
        c.ids.clear()  # the worker goes on to other tasks, and keeps what its modules hold

    is_long = F.coalesce(F.length(F.col(text_col)) > piece_chars, F.lit(False))
    short = df.where(~is_long).mapInArrow(whole, schema)

    key, piece = "_row_key", "_piece"
    longs = df.where(is_long).withColumn(key, F.monotonically_increasing_id())
    cut_schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("inner", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("row", df.schema)])

    def cut(batches):
        c = codec(tokenizer_path)
        for batch in slices(batches, 8):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            rows = batch.drop_columns([key]).to_pylist()
            out = []
            for k, t, row in zip(keys, texts, rows, strict=True):
                starts = c.cut(t, piece_chars)
                for n, (a, inner) in enumerate(starts):
                    b = starts[n + 1][0] if n + 1 < len(starts) else len(t)
                    out.append({key: k, "piece": n, "start": a, "inner": inner, "text": t[a:b], "row": row | {text_col: None} if n == 0 else None})
            yield pa.RecordBatch.from_pylist(out, _arrow(cut_schema))

    enc_schema = T.StructType([*cut_schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])

    def each(batches):
        c = codec(tokenizer_path)
        for batch in slices(batches, 8):
            ids, a, b = [], [], []
            for t, start in zip(batch["text"].to_pylist(), batch["start"].to_pylist(), strict=True):
                if c.cuts_at_space and SPACE.search(t):
                    head, tail = _edges(t)
                    mid = c.encode(t[head:tail])
                    x, y = c.encode_at(t[:head], start), c.encode_at(t[tail:], start + tail)
                    ids.append(np.concatenate([[i for i, _, _ in x], mid, [i for i, _, _ in y]]).astype(np.int32))
                    a.append(np.array([p for _, p, _ in x] + [-1] * len(mid) + [p for _, p, _ in y], np.int32))
                    b.append(np.array([p for _, _, p in x] + [-1] * len(mid) + [p for _, _, p in y], np.int32))
                else:
                    x = c.encode_at(t, start)
                    ids.append(np.array([i for i, _, _ in x], np.int32)), a.append(np.array([p for _, p, _ in x], np.int32)), b.append(np.array([p for _, _, p in x], np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids), _lists(a), _lists(b)], [*batch.schema.names, "ids", "a", "b"])

    def rejoin(pdf):
        c = codec(tokenizer_path)
        pdf = pdf.sort_values("piece")
        row = next(r for r in pdf["row"] if r is not None)
        row = row.asDict() if hasattr(row, "asDict") else dict(row)
        text, starts = "".join(pdf["text"]), pdf["start"].tolist()
        out, open_run = [], []

        def close():
            if open_run:
                out.append(np.array([i for i, _, _ in c.tree(open_run, text)], np.int32))
                open_run.clear()

        for n, (inner, ids, a, b) in enumerate(zip(pdf["inner"], pdf["ids"], pdf["a"], pdf["b"], strict=True)):
            begin, end = starts[n], starts[n + 1] if n + 1 < len(starts) else len(text)
            toks = list(zip([int(x) for x in ids], [int(x) for x in a], [int(x) for x in b], strict=True))
            # where the piece holds white space, only its parts before the first and after the last one touch a join
            blank = [k for k, x in enumerate(toks) if x[1] < 0]
            spaced = c.cuts_at_space and SPACE.search(text, begin, end)
            if not inner:
                close()
            if spaced:
                head, tail = _edges(text[begin:end])
                first, last = (blank[0], blank[-1] + 1) if blank else ((k := sum(x[1] < begin + head for x in toks)), k)
                if first:
                    open_run.append((begin, begin + head, toks[:first]))
                elif open_run and head:
                    open_run.append((begin, begin + head, []))
                close()
                out.append(np.array([x[0] for x in toks[first:last]], np.int32))
                open_run.append((begin + tail, end, toks[last:]))
            else:
                open_run.append((begin, end, toks))
        close()
        row[text_col] = text
        row[out_col] = np.concatenate(out).tolist() if out else []
        import pandas as pd

        return pd.DataFrame({"row": [row]})

    joined = (
        longs.mapInArrow(cut, cut_schema)
        .repartition(F.col(key), F.col("piece"))
        .mapInArrow(each, enc_schema)
        .groupBy(key)
        .applyInPandas(rejoin, T.StructType([T.StructField("row", schema)]))
        .select("row.*")
    )
    return short.unionByName(joined)


def _edges(text: str) -> tuple[int, int]:
    """Where the unsplit text at the start of a piece ends, and where that at its end begins."""
    head = SPACE.search(text).start()
    tail = len(text)
    while tail > 0 and text[tail - 1] not in "\t\n\x0b\x0c\r ":
        tail -= 1
    return head, tail


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with ``out_col`` string: what the tokenizer's decode gives for each list, special tokens kept."""
    df = df.drop(out_col) if out_col in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def texts(batches):
        c = codec(tokenizer_path)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            none = ids.is_null().to_pylist()
            out = ["" if none[k] else c.decode(flat[ends[k] : ends[k + 1]]) for k in range(len(ids))]
            yield _with(batch, out_col, pa.array(out, pa.string()))

    return df.mapInArrow(texts, schema)
