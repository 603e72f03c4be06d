"""Near-duplicate groups by SimHash, with candidates from covering locality-sensitive hashing.

1. A text's fingerprint has bit k set if more than half the 64-bit hashes of its word shingles (repeats included) have it.
   Equal fingerprints collapse to the smallest doc_id first, however many copies there are.
2. Masks: each of the 64 bits is given one of the 2^(radius+1) - 1 non-zero vectors of radius + 1 bits, and mask v holds the
   bits whose vector has an odd product with v. The vectors of radius bits always leave a v with which all their products
   are even, so two fingerprints that differ in at most radius bits are equal under one of the masks at least: no pair
   within the radius can be missed. With radius 2 there are seven masks of 36 or 37 bits.
3. Fingerprints that are equal under a mask share a bucket. A bucket of two is checked as it is counted, one of at most
   BUCKET members pair by pair. The members of larger ones are not paired: each is sent once to itself and to the 64
   fingerprints one bit away, and all that meet at one of these places (65 at most) lie within two bits of each other; for
   a radius of two that finds every link again, exactly, in work linear in the members. (Of larger radii only
   BUCKET-bounded pairs are supported, so ``groups`` takes a radius of 0, 1 or 2.)
4. Links are confirmed by counting the differing bits; large-star and small-star give the groups.

Defined results: a text that is null or has no word has the fingerprint zero, which is linked like any other; fewer words
than a shingle count as one shingle; rows with one doc_id are one node, linked with whatever any of them is linked with; a
row with a null doc_id has its fingerprint, takes no part in links and has a null component; other columns of the input are
left to a join by id; an empty table gives an empty result. Words are split at the six ASCII blanks alone and A-Z alone are
lower-cased, in the texts' UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialise
from .components import connected

BITS, BUCKET = 64, 48
#: Shingles whose bits are counted at once.
_CHUNK = 8192


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - size + 1)
    spans = zip(starts[:n].tolist(), ends[len(tokens) - n :].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in spans), "<u8", n)
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        part = hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def masks(radius: int) -> list[int]:
    """The masks of bits under one of which any two fingerprints within the radius are equal, as unsigned numbers."""
    vectors = 2 ** (radius + 1) - 1
    given = [k % vectors + 1 for k in range(BITS)]
    return [sum(1 << k for k in range(BITS) if (given[k] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) for each row, fp being the fingerprint's bits as a signed long."""

    def each(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, size) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fp long")


def links(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between nodes of prints (node, fp), fp being distinct, such that any two within the radius are joined
    by links; each link is of two fingerprints within the radius. Buckets of more than ``bucket`` are not compared in pairs."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    me = F.struct("fp", "node").alias("e")
    under = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)])
    spread = prints.select(me, F.posexplode(under).alias("mask", "key"))
    met = spread.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi")).where("n > 1")
    met = materialise(met, "simhash-buckets")
    two = met.where(near(F.col("lo.fp"), F.col("hi.fp"))).select(F.col("lo.node").alias("u"), F.col("hi.node").alias("v"))

    # the members of the buckets of three or more, a hot bucket's being marked
    more = spread.join(met.where("n > 2").select("mask", "key", (F.col("n") > bucket).alias("hot")), ["mask", "key"])
    few = more.where("NOT hot").groupBy("mask", "key").agg(F.collect_list("e").alias("es"))
    after = lambda i: F.slice("es", i + 2, F.size("es"))
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.filter(after(i), lambda b: near(a["fp"], b["fp"])), lambda b: F.struct(a["node"].alias("u"), b["node"].alias("v")))))
    small = few.select(F.explode(pairs).alias("p")).select("p.u", "p.v")

    places = F.array(F.col("e.fp"), *[F.col("e.fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(BITS)])
    met_at = more.where("hot").select("e").distinct().select("e", F.explode(places).alias("place")).groupBy("place").agg(F.collect_list("e").alias("es")).where("size(es) > 1")
    first = F.array_min("es")
    # two that meet at a place a bit away from both lie within two bits; for a smaller radius they are counted again
    at = met_at.select(first.alias("a"), F.explode("es").alias("b")) if radius == 2 else met_at.select(F.explode("es").alias("a"), "es").select("a", F.explode("es").alias("b"))
    large = at.where((F.col("a.node") != F.col("b.node")) & near(F.col("a.fp"), F.col("b.fp"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return two.unionByName(small).unionByName(large)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable)."""
    prints = materialise(fingerprints(df, id_col, text_col, size), "simhash-prints")
    named = prints.where("doc_id IS NOT NULL")
    nodes = materialise(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # an id whose rows have different texts is one node: it joins the nodes of all of them
    shared = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    bridges = named.join(shared, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    joined = connected(links(nodes, radius, bucket).unionByName(bridges), "simhash-links")
    of = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # a row without an id must not take the component of its text
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return prints.join(of, "fp", "left").select(F.col("doc_id").alias(id_col), digits.alias("fingerprint"), component.alias("component_id"))
