"""SimHash near copies by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into parts, correlated bits together. If the allowed differences of the parts add up to
T - parts + 1, two fingerprints that differ in at most T bits agree within what is allowed in at least one part, so it is
enough to probe each part with its own allowance and to verify what meets. The allowances are unequal: dynamic programming
picks those with the least estimated cost of probes and candidates, from the bits' frequencies over all fingerprints.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import free_name, strings
from gavilla.operators.components import connected_components
from gavilla.operators.keys import attach
from gavilla.session import materialise

BITS = 64
WORD = re.compile(rb"[^ \t-\r]+")
# Members of a bucket that meet in one task; a larger bucket is cut into blocks and every two blocks meet.
BLOCK = 4096
# Cost of a candidate pair against that of a probe row, from timings of the two.
PAIR_COST = 0.002


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 for a text without words."""
    words = WORD.findall((text or "").encode("utf-8").lower())  # of bytes: A-Z only
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with ``out``, the fingerprint as a signed 64-bit integer. Narrow: each text stays in its task."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, shingle) for t in strings(texts)], dtype=np.uint64)
        return pa.array(found.view(np.int64), pa.int64())

    return docs.withColumn(out, of(F.col(text).cast("string")))


# -- parts and allowances -------------------------------------------------------------------------


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j; over all rows, 64 x 64 sums per task."""

    def count(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(fp), 65536):
                bits = np.unpackbits(fp[at : at + 65536], axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            total += len(fp)
        if total:
            cells = np.append(both.ravel(), total).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"])

    cells = np.zeros(BITS * BITS + 1)
    for row in fps.select("fp").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[row.cell] = row.n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of nearly equal size, each bit beside those that it correlates with most."""
    mean = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tied = np.abs(both / max(total, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _meeting(mean: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated chance that two fingerprints differ in at most 0..most bits of a part."""
    chance = np.zeros(len(group) + 1)
    chance[0] = 1
    for b in group:
        differ = 2 * mean[b] * (1 - mean[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance)[: most + 1]


def allot(total: int, both: np.ndarray, max_bits: int, parts: int) -> tuple[float, list[tuple[list[int], int]]]:
    """Least estimated cost per fingerprint, and (bits, allowance) of each part; -1 leaves a part unused."""
    groups = group_bits(total, both, parts)
    mean = np.diag(both) / max(total, 1)
    # best[s]: least cost of the parts so far with allowances that sum to s - parts so far.
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        meeting = _meeting(mean, group, max_bits)
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for allowed in range(-1, max_bits + 1):
                own = 0.0
                if allowed >= 0:
                    own = sum(comb(len(group), e) for e in range(allowed + 1)) + PAIR_COST * total * meeting[allowed]
                at = spent + allowed
                if at not in grown or cost + own < grown[at][0]:
                    grown[at] = (cost + own, [*chosen, allowed])
        best = grown
    cost, chosen = best[max_bits - parts + 1]
    return cost, list(zip(groups, chosen))


def plan(fps: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """The cheapest partition into 1 to max_bits + 3 parts with its allowances."""
    total, both = bit_moments(fps)
    return min((allot(total, both, max_bits, parts) for parts in range(1, max_bits + 4)), key=lambda x: x[0])[1]


# -- probing and verifying --------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): each fingerprint in its own bucket of each part, and in those of allowed differences.

    Of two fingerprints only the one with the smaller key visits the other, so a pair meets once in a part.
    """
    rows = []
    for k, (bits, allowed) in enumerate(parts):
        if allowed < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        flips = [_signed(sum(1 << b for b in c)) for e in range(1, allowed + 1) for c in combinations(bits, e)]
        keys = F.array(own)
        if flips:
            moved = F.transform(F.lit(flips), lambda x: own.bitwiseXOR(x))
            keys = F.concat(keys, F.filter(moved, lambda x: x > own))
        rows.append(F.transform(keys, lambda key, k=k: F.struct(F.lit(k).alias("part"), key.alias("key"))))
    return fps.select("fp", F.inline(F.concat(*rows))).select("part", "key", "fp")


def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what ``max_bits`` differing bits connect among some fingerprints; fewer links than fingerprints."""
    a, b = [], []
    rest = np.unique(fp)
    queue: list[np.ndarray] = []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ at) <= max_bits
        if near.any():
            found = rest[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found)
            rest = rest[~near]
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _verified(max_bits: int):
    """Reads rows sorted by bucket and returns the verified links of each bucket."""

    def run(batches):
        held = None  # rows of the bucket that the batch before ended in
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            fp = np.asarray(batch.column(3)).astype(np.int64).view(np.uint64)
            if held is not None:
                keys, fp = np.concatenate([held[0], keys]), np.concatenate([held[1], fp])
            if not len(fp):
                continue
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            held = keys[cut:], fp[cut:]
            yield from _links(fp[:cut], np.concatenate([[0], edges]))
        if held is not None and len(held[1]):
            yield from _links(held[1], np.array([0, len(held[1])]))

    def _links(fp, bounds):
        sizes = np.diff(bounds)
        a, b = [], []
        # Buckets of two to eight: all at once, one distance between neighbours after the other.
        small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        for lag in range(1, 8):
            near = small[lag:] & (bucket[lag:] == bucket[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= max_bits)
            near &= fp[lag:] != fp[:-lag]
            a.append(fp[:-lag][near])
            b.append(fp[lag:][near])
        for k in np.flatnonzero(sizes > 8):
            found = forest(fp[bounds[k] : bounds[k + 1]], max_bits)
            a.append(found[0])
            b.append(found[1])
        left, right = np.concatenate(a).astype(np.uint64), np.concatenate(b).astype(np.uint64)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within ``max_bits`` of each other.

    ``fps`` holds distinct non-null values ``fp`` and is read more than once. In each bucket only spanning links come
    out, at most one per member, never all pairs. A bucket above ``block`` members is cut into blocks by hash, and every
    two blocks meet in a task of their own; copies of one fingerprint are one member, so near copies of one text can fill
    a bucket only with as many values as lie within a few bits.
    """
    rows = probes(fps, plan(fps, max_bits))
    hot = materialise(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot-buckets")
    cells = rows.withColumn("cell", F.lit(0).cast("bigint"))
    if not hot.isEmpty():
        tagged = rows.join(hot, ["part", "key"], "left")
        blocks = F.ceil(F.col("n") / block).cast("bigint")
        mine = F.pmod(F.xxhash64("fp"), blocks)
        pairs = F.transform(
            F.sequence(F.lit(0).cast("bigint"), blocks - 1),
            lambda other: F.least(mine, other) * blocks + F.greatest(mine, other) + 1,
        )
        where = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)
        cells = tagged.select("part", "key", F.explode(where).alias("cell"), "fp")
    cells = cells.select("part", "key", "cell", "fp")
    dealt = cells.repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    return dealt.mapInArrow(_verified(max_bits), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of at most ``max_bits`` differing bits. Texts
    without words, null ones too, have fingerprint 0 and are linked like any other. Repeated rows come out repeated. A
    null doc_id never stands for a group: component_id is null only where no row of the group has an id. An empty table
    gives an empty one.
    """
    marked = materialise(fingerprints(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "fingerprints")
    groups = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fp")
    edges = materialise(links(groups.select("fp"), max_bits), "fp-links")
    named = groups.withColumn("component_id", F.col("rep"))
    if not edges.isEmpty():
        roots = materialise(connected_components(edges).withColumnRenamed("id", "fp"), "fp-roots")
        placed = materialise(groups.join(roots, "fp"), "fp-placed")
        least = materialise(
            placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "fp-least"
        )
        found = attach(placed, least, ["root"], placed.count(), "members").select("fp", F.col("component_id").alias("found"), F.lit(True).alias("linked"))
        named = groups.join(found, "fp", "left").withColumn(
            "component_id", F.when(F.col("linked"), F.col("found")).otherwise(F.col("rep"))
        )
    labels = materialise(named.select("fp", "component_id", "n"), "fp-labels")
    return attach(marked, labels, ["fp"], marked.count(), "n").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id.

    Of rows that repeat this doc_id one stays. Rows without a doc_id cannot be told apart and all stay.
    """
    near = near_copies(docs, max_bits, shingle)
    keep, one = free_name(docs, "_keep"), free_name(docs, "_one")
    kept = near.where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Ids that come more than once are few; only their rows are grouped.
    again = materialise(docs.groupBy("doc_id").agg(F.count("*").alias(one)).where(F.col(one) > 1).select(F.col("doc_id").alias(keep)), "repeated-ids")
    stay = docs.join(kept, F.col("doc_id") == F.col(keep), "left_semi")
    if not again.isEmpty():
        twice = stay.join(again, F.col("doc_id") == F.col(keep), "left_semi").groupBy(F.col("doc_id").alias(keep)).agg(F.min(first).alias(one))
        stay = stay.join(again, F.col("doc_id") == F.col(keep), "left_anti").unionByName(twice.select(f"{one}.*"))
    return stay.unionByName(docs.where("doc_id IS NULL"))
