"""Near-duplicate groups by MinHash.

1. Each text gives its set of distinct word shingles, BANDS x ROWS universal hash minima, and a hash for each band. Equal
   word sequences collapse to the smallest doc_id first, however many copies there are; the rest works on these nodes.
2. Each band's bucket links its members to its smallest node (a star, never all pairs). Components of these links are
   families: any two nodes that share a bucket lie in one family.
3. A family's members are compared in blocks: signatures first (five standard deviations below the threshold pass), then
   the full sets of 64-bit shingle hashes, skipping pairs that are already linked. Only true links that join two groups
   leave a task. A family larger than a block is dealt out as pairs of blocks over many tasks; no cap drops a pair.
4. Components of the true links by large-star and small-star give the groups; the smallest doc_id is kept.

Two texts of similarity 0.75 share no bucket with a chance of (1 - 0.75^5)^40 = 2e-5, less above it.

Defined results: a text that is null or has no word has n_shingles 0 and is its own component; fewer words than a
shingle count as one shingle; rows with one doc_id are one node (linked with whatever any of them is linked with);
a row with a null doc_id has its n_shingles, takes no part in links, has a null component and is kept; columns of the
input that aren't outputs are left to a join by id; an empty table gives an empty result. Sets are of 64-bit hashes of shingles, whole sets
when links are confirmed: two different shingles of two texts have one hash with a chance of 2^-64 each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import materialise
from .components import connected

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}
ROWS, BANDS = 5, 40
BLOCK_DOCS, BLOCK_BYTES = 512, 16 << 20
MARK_BITS = 1 << 23
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def words(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def shingles(tokens: list[str], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    if not tokens:
        return np.empty(0, np.uint64)
    n = max(1, len(tokens) - size + 1)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    h = np.full(n, len(tokens) if len(tokens) < size else size, np.uint64)
    for k in range(min(size, len(tokens))):
        h = (h ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of ROWS x BANDS functions a*x + b of the mixed hashes."""
    x = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        part = x[None, k : k + 2048] * _A[:, None]
        part += _B[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(1), out=out)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for row in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = (h ^ row) * np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _sketch(text_col: str, size: int):
    import xxhash

    def each(batches):
        for batch in slices(batches):
            n, key, bands = [], [], []
            for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                tokens = words(t)
                s = shingles(tokens, size)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest("\n".join(tokens)) if len(s) else None)
                bands.append(_bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "key", "bands"])

    return each


def _sets(text_col: str, size: int):
    def each(batches):
        for batch in slices(batches):
            found = [shingles(words(t), size) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["family"], pa.array([x.tobytes() for x in found], pa.binary())], ["node", "family", "hashes"])

    return each


def _compare(threshold: float):
    """Links (u, v) that join the members of one or two blocks: both blocks' own pairs when they are one, else the pairs across."""

    def each(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["block", "node"]).reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        sigs = np.stack([signature(s) for s in sets])
        nodes, own = pdf["node"].tolist(), pdf["block"].to_numpy()
        across = own[0] != own[-1]
        sizes = np.array([len(s) for s in sets])
        least = threshold - 5 * (threshold * (1 - threshold) / sigs.shape[1]) ** 0.5
        group = np.arange(len(nodes))
        out = []
        for i in range(len(nodes)):
            if across and own[i] == own[-1]:
                break
            rest = slice(i + 1, None)
            ok = (group[rest] != group[i]) & (np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9)
            if across:
                ok &= own[rest] != own[i]
            rows = np.flatnonzero(ok) + i + 1
            if len(rows):
                rows = rows[(sigs[rows] == sigs[i]).mean(1) >= least]
            for j in rows:
                if group[j] == group[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= round(100 * threshold) * (sizes[i] + sizes[j] - both):
                    group[group == group[j]] = group[i]
                    out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return each


def _marked(slim: DataFrame, families: DataFrame) -> DataFrame:
    """The rows of slim whose doc_id may be a node of families: a bitmap of MARK_BITS hash slots (1 MB, whatever the
    input's size) is sent out, so that the texts of the many lone documents aren't shuffled only to find no family. Full
    slots let rows through, never stop one; the join that follows is exact."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS)) + 1
    marks = families.select(slot("node").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    at = slim.withColumn("bucket", F.bitmap_bucket_number(slot("doc_id"))).withColumn("pos", F.bitmap_bit_position(slot("doc_id")))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(pos div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("pos % 8").cast("int")
    return at.join(F.broadcast(marks), "bucket").where(F.floor(byte / F.pow(F.lit(2), hit)).cast("int") % 2 == 1).select("doc_id", "text")


def _solve(df: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketches (doc_id, n, key) of all rows, and the component of each key."""
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialise(slim.mapInArrow(_sketch("text", size), "doc_id long, n long, key binary, bands array<long>"), "neardup-sketch")
    with_words = sketch.where("n > 0 AND doc_id IS NOT NULL")

    copies = materialise(with_words.groupBy("key").agg(F.min("doc_id").alias("node")), "neardup-copies")
    firsts = with_words.select(F.col("doc_id").alias("node"), "key", "bands").join(copies, ["node", "key"], "left_semi")
    buckets = firsts.select("node", F.explode("bands").alias("band")).repartition("band")
    hubs = buckets.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub")
    stars = buckets.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    families = materialise(connected(stars, "neardup-family").select("node", F.col("component").alias("family")), "neardup-families")

    # the full sets of family members alone are read again from their texts
    texts = _marked(slim, families).join(families, F.col("doc_id") == F.col("node")).select("node", "family", "text")
    sets = texts.mapInArrow(_sets("text", size), "node long, family long, hashes binary").where(F.length("hashes") > 0).dropDuplicates(["node", "hashes"])
    sets = materialise(sets, "neardup-sets")
    weight = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.length("hashes")) / BLOCK_BYTES)).cast("int")
    placed = sets.join(sets.groupBy("family").agg(weight.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("node", "hashes"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "hashes")
    links = dealt.groupBy("family", "lo", "hi").applyInPandas(_compare(threshold), "u long, v long")

    # an id whose rows have different texts is one node: it links the nodes of all of them
    shared = with_words.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    bridges = with_words.select("doc_id", "key").join(shared, "doc_id", "left_semi").join(copies, "key").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    linked = connected(links.unionByName(bridges), "neardup-links")
    return sketch, copies.join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.75) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, kept."""
    sketch, named = _solve(df, id_col, text_col, size, threshold)
    # a null key joins with nothing; rows without an id must not take the component of their text
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sketch.join(named, "key", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of df that stand for their group, with the columns of df; repeated rows of a kept id stay once, rows without id stay."""
    kept = groups(df, id_col, text_col, size, threshold).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_kept")).distinct()
    unnamed = df.where(F.col(id_col).isNull())
    own = df.join(kept, F.col(id_col).cast("long") == F.col("_kept"), "left_semi")
    # ids are few times repeated; where they are, the row of the smallest text stays, whatever the order of the rows
    again = materialise(own.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_again")), "neardup-repeated")
    if again.isEmpty():
        return own.unionByName(unnamed)
    whole = F.struct(F.col(text_col), *[F.col(c) for c in df.columns if c != text_col])
    repeated = own.join(again, F.col(id_col) == F.col("_again"), "left_semi").groupBy(id_col).agg(F.min(whole).alias("_r")).select("_r.*").select(*df.columns)
    return own.join(again, F.col(id_col) == F.col("_again"), "left_anti").unionByName(repeated).unionByName(unnamed)
