"""MinHash signatures, band buckets and candidates."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gavilla.functions import text as T
from gavilla.operators.keys import HOT_SLOTS, attach, spread
from gavilla.session import materialise

# Elements of one (permutation, gram) block held while a signature is computed.
BLOCK_GRAMS = 8192
# Code points whose grams are told apart together.
CHUNK = 1 << 21
# Of a text's grams so many are expected among those that are looked at for a permutation; texts of fewer grams than FEW
# have all looked at.
EXPECTED, FEW = 12, 64
# What a gram never holds, as a dot of a regular expression.
LINE_ENDS = "\n\r\x85\u2028\u2029"

# A bucket of fewer entries is never cut.
LEAST_PART = 1000


def coefficients(num_perm: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of h -> (a * h + b) mod PRIME per permutation."""
    rng = random.Random(seed)
    return [(rng.randrange(1, T.PRIME), rng.randrange(T.PRIME)) for _ in range(num_perm)]


def _hash(gram: str) -> int:
    """The same number as ``functions.text.gram_hash``."""
    return int.from_bytes(hashlib.sha1(gram.encode()).digest()[:4], "big") % T.PRIME


def _chunk_grams(texts: list[str], n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, gram, text): the hash of each distinct gram, and the distinct pairs of gram and text in order.

    One sort of all places by the longest gram that begins there puts the shorter ones in order as well.
    """
    pad = "\0" * n_max
    whole = "".join(t + pad for t in texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + n_max)
    starts = np.cumsum(lengths + n_max) - (lengths + n_max)
    inside = np.arange(len(points)) - starts[owner] < lengths[owner]
    # Texts below the least length give their characters instead.
    short = lengths < n_min
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    seen[[ord(c) for c in LINE_ENDS]] = False
    places = np.where(seen, np.cumsum(seen, dtype=np.int32), np.int32(0))
    base = int(seen.sum()) + 1
    codes = np.where(inside & ~short[owner], places[points], np.int32(0))
    at = np.flatnonzero(codes)
    codes = np.concatenate([codes, np.zeros(n_max, dtype=codes.dtype)])
    key, most = codes[at].astype(np.int64), base
    for j in range(1, n_max):
        if most > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
            most = len(at)
        key, most = key * base + codes[at + j], most * base
    at = at[np.argsort(key)]
    fresh, good = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    fresh[:1] = True
    hashes, grams, owners, made = [], [], [], 0
    for n in range(1, n_max + 1):
        last = codes[at + n - 1]
        fresh[1:] |= last[1:] != last[:-1]
        good &= last != 0
        if n < n_min or not good.any():
            continue
        hashes += [_hash(whole[i : i + n]) for i in at[fresh & good].tolist()]
        gram = np.cumsum((fresh & good)[good]) - 1
        pairs = np.sort(gram * len(texts) + owner[at[good]])
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        grams.append(pairs // len(texts) + made)
        owners.append(pairs % len(texts))
        made = len(hashes)
    for i in np.flatnonzero(short):
        own = sorted(set(texts[i])) or [""]
        hashes += map(_hash, own)
        grams.append(np.arange(made, made + len(own)))
        owners.append(np.full(len(own), i))
        made = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    return np.array(hashes, dtype=np.uint64), np.concatenate([none, *grams]), np.concatenate([none, *owners])


def _signature_udf(num_perm: int, seed: int, n_min: int, n_max: int):
    pairs = np.array(coefficients(num_perm, seed), dtype=np.uint64)
    mult, add = pairs[:, :1], pairs[:, 1:]
    prime, shift, block = np.uint64(T.PRIME), np.uint64(31), BLOCK_GRAMS

    def permute(hashes: np.ndarray, of: slice = slice(None)) -> np.ndarray:
        # Two folds of the high bits reduce modulo 2^31 - 1 without a division.
        out = mult[of] * hashes[None, :] + add[of]
        out = (out & prime) + (out >> shift)
        out = (out & prime) + (out >> shift)
        out[out == prime] = 0
        return out

    def all_minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Minima of runs of ``sizes`` hashes, ``block`` of them at a time."""
        ends = np.cumsum(sizes)
        low = np.full((num_perm, len(sizes)), prime, dtype=np.uint64)
        for start in range(0, len(hashes), block):
            part = permute(hashes[start : start + block])
            first, last = np.searchsorted(ends, [start, start + part.shape[1] - 1], side="right")
            rows = np.arange(first, last + 1)
            rows = rows[sizes[rows] > 0]
            begins = np.maximum(ends[rows] - sizes[rows] - start, 0)
            low[:, rows] = np.minimum(low[:, rows], np.minimum.reduceat(part, begins, axis=1))
        return low

    def minima(texts: list[str]) -> np.ndarray:
        """(num_perm, texts). A minimum of a text with many grams is among the grams with small values, so each distinct gram is
        permuted once and only the texts of those are visited; texts that held none of them are done in full."""
        hashes, gram, owner = _chunk_grams(texts, n_min, n_max)
        sizes = np.bincount(owner, minlength=len(texts))
        low = np.full((num_perm, len(texts)), prime, dtype=np.uint64)
        level = np.where(sizes < FEW, -1, np.log2(np.maximum(sizes, 1)).astype(np.int64) // 2)
        groups = []
        for step in np.unique(level[level >= 0]).tolist():
            mine = level[owner] == step
            ends = np.concatenate([[0], np.cumsum(np.bincount(gram[mine], minlength=len(hashes)))])
            groups.append((np.uint64(min(T.PRIME, EXPECTED * T.PRIME // 4**step)), ends, owner[mine]))
        for p in range(num_perm if groups else 0):
            value = permute(hashes, slice(p, p + 1))[0]
            for limit, ends, members in groups:
                small = np.flatnonzero(value < limit)
                begin, count = ends[small], ends[small + 1] - ends[small]
                before = np.cumsum(count) - count
                spots = np.arange(count.sum()) + np.repeat(begin - before, count)
                np.minimum.at(low[p], members[spots], np.repeat(value[small], count))
        left = (low == prime).any(0)
        if left.any():
            mine = np.flatnonzero(left[owner])
            mine = mine[np.argsort(owner[mine], kind="stable")]
            low[:, left] = all_minima(hashes[gram[mine]], sizes[left])
        return low

    @F.arrow_udf("array<bigint>")
    def signature(column: pa.Array) -> pa.Array:
        """Signatures of a batch, about CHUNK code points at a time."""
        texts = [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
        low = np.full((len(texts), num_perm), prime, dtype=np.uint64)
        rows, held = [], 0
        for i, text in enumerate(texts):
            if text is not None:
                rows.append(i)
                held += len(text) + n_max
            if rows and (held >= CHUNK or i == len(texts) - 1):
                low[rows] = minima([texts[r] for r in rows]).T
                rows, held = [], 0
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * num_perm)
        return pa.ListArray.from_arrays(offsets, pa.array(low.reshape(-1).astype(np.int64)))

    return signature


def signatures(df: DataFrame, num_perm: int = 128, n_min: int = 3, n_max: int = 5, seed: int = 1) -> DataFrame:
    """(id, sig) from (id, comentario_clean); one narrow pass over the texts.

    Grams are told apart and hashed in Arrow batches, each once for a chunk of texts, as exploding them would move a
    signature-wide aggregate through a shuffle.
    """
    df = spread(df.select("id", "comentario_clean"))
    return df.select("id", _signature_udf(num_perm, seed, n_min, n_max)("comentario_clean").alias("sig"))


def buckets(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, bucket, id): the bucket is the whole slice of the signature, not a digest of it."""

    def entry(band: Column) -> Column:
        key = F.array_join(F.slice("sig", band * rows + 1, rows), ",")
        return F.struct(band.alias("band"), key.alias("bucket"))

    return sigs.select("id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), entry))).select(
        "band", "bucket", "id"
    )


def bucket_sizes(entries: DataFrame) -> DataFrame:
    """(band, bucket, hub, n): the smallest id and the member count of each bucket."""
    return entries.groupBy("band", "bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n"))


def star_edges(entries: DataFrame) -> DataFrame:
    """(id, hub): each bucket member linked to the smallest id of the bucket.

    The edges span the same components as all pairs of each bucket, but their number is linear in the
    bucket entries however large a bucket grows.
    """
    entries = materialise(entries, "buckets")
    hubs = materialise(bucket_sizes(entries).where("n > 1"), "hubs")
    total = hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = attach(entries, hubs, ["band", "bucket"], total)
    return linked.where("id <> hub").select("id", "hub").distinct()


def bucket_collisions(entries: DataFrame) -> DataFrame:
    """One row: ordered (member, other member, band) collisions, summed from the bucket sizes alone."""
    n = F.col("n")
    return bucket_sizes(entries).agg(
        F.count_if(n > 1).alias("shared_buckets"),
        F.coalesce(F.sum(n * (n - 1)), F.lit(0)).alias("ordered_collisions"),
        F.max("n").alias("largest_bucket"),
    )


def query_candidates(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """(probe_id, id): indexed ids sharing a bucket with each probe entry (band, bucket, id).

    A bucket above total / HOT_SLOTS entries is cut into parts of that many, by a hash of the id, and its probes
    go to each of them: every match is found, and no task holds a whole bucket however many rows share it.
    """
    asked = materialise(probes.withColumnRenamed("id", "probe_id"), "probes")
    # Only buckets that are asked for matter.
    entries = materialise(entries.join(asked.select("band", "bucket").distinct(), ["band", "bucket"], "left_semi"), "probed")
    limit = max(entries.count() // HOT_SLOTS, LEAST_PART)
    hot = materialise(bucket_sizes(entries).where(F.col("n") > limit).select("band", "bucket", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot")
    hot = F.broadcast(hot)  # fewer than HOT_SLOTS rows
    spot = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = entries.join(hot, ["band", "bucket"], "left").select("band", "bucket", spot.alias("part"), "id")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    sent = asked.join(hot, ["band", "bucket"], "left").select("band", "bucket", every.alias("part"), "probe_id")
    return sent.join(dealt, ["band", "bucket", "part"]).select("probe_id", "id").distinct()


def estimated_jaccard(left: Column, right: Column) -> Column:
    """Share of equal signature positions."""
    same = F.zip_with(left, right, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.size(left)
