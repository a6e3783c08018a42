"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A token sequence is the one that merging by rank gives exactly if every pair of neighbours is compatible, that is, if
merging the bytes of the two tokens on their own gives back just these two. So the encoder walks over a piece once,
takes the longest token at each place, and steps to a shorter one, or back, whenever the new pair is not compatible.
Pairs repeat a great deal, so their compatibility is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import free_name, per_process, strings

# Entries of a memory of matches and of pairs; a fuller one is put aside and then dropped. Results do not depend on them.
REMEMBERED, PAIRS = 150_000, 100_000
# Characters of the longest match that is remembered, and bytes that are encoded or decoded at a time.
LONGEST, ENCODED, DECODED = 48, 1 << 23, 1 << 21
# Marks that are neither letter, number nor white space, nor begin a contraction.
MARKS = ".,;:!?"

NEVER = 1 << 40

# Split patterns in which a space binds to the word, number or mark after it.
SPACE_STARTS = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern)
        # A single space between two other characters always starts a match of these patterns, so a text may be cut there.
        self.cut = pattern in SPACE_STARTS
        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        # Bytes as Latin-1 characters, which the automaton can hold. A token that merging does not give back from
        # its own bytes can only ever be a whole piece, so it stays out.
        self.matcher = ahocorasick.Automaton()
        halves = {token: self._merge(token, 2) for token in self.ranks}
        usable = {token for token, parts in halves.items() if len(parts) <= 2}
        for token in usable:
            self.matcher.add_word(token.decode("latin-1"), self.ranks[token])
        self.matcher.make_automaton()
        # For each token the next shorter one that starts the same way; -1 if there is none.
        shorter = {
            self.ranks[token]: next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), -1)
            for token in usable
        }
        # Edges of a token as merging builds it up from a byte, as (bytes, rank): at its right end and at its left end.
        self.right_edge, self.left_edge = {}, {}
        for token in sorted(usable, key=len):
            own, rank, parts = (token, self.ranks[token]), self.ranks[token], halves[token]
            two = len(parts) == 2
            self.right_edge[rank] = [*self.right_edge[self.ranks[parts[1]]], own] if two else [own]
            self.left_edge[rank] = [*self.left_edge[self.ranks[parts[0]]], own] if two else [own]
        # Whether parts always rank before what they form, as in any trained table; then merges happen in order of rank.
        self.ordered = all(self.ranks[part] < self.ranks[token] for token in usable if len(token) > 1 for part in halves[token])
        top = max(self.bytes_of, default=-1)
        self.sizes = [len(self.bytes_of.get(rank, b"")) for rank in range(top + 1)]
        self.shorter = [shorter.get(rank, -1) for rank in range(top + 1)]
        self.pairs, self.older_pairs = {}, {}
        self.pieces, self.older_pieces = {}, {}
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(17)]
        # A word of letters is one match of these patterns; characters that Python and the patterns do not agree on.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.unsure = frozenset(regex.findall(r"\p{L}", every)) ^ frozenset(filter(str.isalpha, every)) if self.cut else frozenset()
        # Bytes of each rank by its place; null where there is none.
        table = [self.bytes_of.get(rank) for rank in range(max(self.bytes_of, default=-1) + 1)]
        self.table = pa.array(table, pa.large_binary())

    def _merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Merging by rank, the plain way, until ``least`` parts are left or none can merge; only run on single tokens or two."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether nothing merges across the place where two tokens meet, while both are built up from bytes."""
        if not self.ordered:
            return self._merge(self.bytes_of[left] + self.bytes_of[right]) == [self.bytes_of[left], self.bytes_of[right]]
        a, b, i, j = self.right_edge[left], self.left_edge[right], 0, 0
        while True:
            across = self.ranks.get(a[i][0] + b[j][0], NEVER)
            grow_a = a[i + 1][1] if i + 1 < len(a) else NEVER
            grow_b = b[j + 1][1] if j + 1 < len(b) else NEVER
            # The lowest rank merges first, and of equal ones the leftmost.
            if across < grow_a and across <= grow_b:
                return False
            if grow_a == grow_b == NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def _compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.older_pairs.get((left, right))
            if known is None:
                known = self._stay_apart(left, right)
            if len(self.pairs) >= PAIRS:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars, end = piece.decode("latin-1"), len(piece)
        longest, shorter, sizes, pairs = self.matcher.iter_long, self.shorter, self.sizes, self.pairs
        # Often the longest tokens fit as they come; else the walk goes on at the first that does not.
        ids = [token for _, token in longest(chars)]
        for i, pair in enumerate(zip(ids, ids[1:]), 1):
            fits = pairs.get(pair)
            if not fits and (fits is not None or not self._compatible(*pair)):
                break
        else:
            return ids
        dead = set()  # places from which no way leads to the end
        token = shorter[ids[i]]
        del ids[i:]
        at = sum(map(sizes.__getitem__, ids))
        while True:
            last = ids[-1] if ids else -1
            while token >= 0:
                if at + sizes[token] not in dead:
                    fits = True if last < 0 else pairs.get((last, token))
                    if fits or (fits is None and self._compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                if at == end:
                    return ids
                token = next(longest(chars, at))[1]
            else:
                # No token fits here after the one before, and only that one can lead here: go back past it.
                dead.add(at)
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one match, remembered if it is short."""
        packed = self.pieces.get(piece)
        if packed is None:
            packed = self.older_pieces.get(piece)
            if packed is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                packed = self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.older_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = packed
        return packed

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split.findall(text)))

    def _lettered(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or self.unsure.isdisjoint(word))

    def _word(self, word: str) -> bytes | None:
        """Ids of a word and the space before it; None if it begins or ends with white space, which binds otherwise."""
        if self._lettered(word):
            return self._piece(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        # Letters and then marks are two matches, and the first is a word that comes without them too.
        core = word.rstrip(MARKS)
        if self._lettered(core) and len(core) < len(word):
            return self._piece(" " + core) + self._piece(word[len(core) :])
        return self._pieces(" " + word)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; empty for a null or empty text."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """``encode`` of each.

        Where ``cut`` holds, texts are split at spaces, each distinct word is encoded once and the words' ids are gathered. A text
        with a word that begins or ends with white space, which binds otherwise, is encoded as a whole.
        """
        if not self.cut:
            return pa.array([self._pieces(text or "") for text in strings(texts)], pa.large_binary())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        starts, words = split.offsets.to_numpy(), split.values.dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        firsts, distinct = starts[:-1], words.dictionary.to_pylist()
        packed = [self._word(word) for word in distinct]
        # The first word of a text has no space before it.
        odd = np.fromiter((ids is None for ids in packed), bool, len(packed))
        whole = np.logical_or.reduceat(odd[at], firsts) if len(firsts) else np.zeros(0, bool)
        heads = [
            self._pieces(texts[i].as_py() if uncut else distinct[first])
            for i, (uncut, first) in enumerate(zip(whole.tolist(), at[firsts].tolist()))
        ]
        at[np.repeat(whole, np.diff(starts))] = len(packed)
        at[firsts] = len(packed) + 1 + np.arange(len(firsts))
        ids = pa.array([*(ids or b"" for ids in packed), b"", *heads], pa.large_binary())
        return joined(ids.take(pa.array(at)), starts)

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))

    def decode_all(self, packed: pa.Array) -> pa.Array:
        """``decode`` of each."""
        packed = pc.fill_null(packed.cast(pa.large_binary()), b"")
        ends = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + packed.offset + 1)[packed.offset :]
        ids = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy().view("<u4")
        return joined(self.table.take(pa.array(ids)), (ends - ends[0]) // 4)


def joined(parts: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of ``parts``, from each of ``ends`` to the next, put together."""
    at = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1)[ends]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), parts.buffers()[2]])


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows of at most about ``most`` bytes, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, before + most, side="right")), start + 1)
        yield texts.slice(start, end - start)
        start = end


def codec(path: str, pattern: str) -> Codec:
    return per_process(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: token ids as packed little-endian unsigned 32-bit integers.

    Each row is encoded on its own: no shuffle, and memory is bounded by a few texts. A null text gives empty ids;
    repeated rows give repeated results; a column already named ``out`` is replaced. The result is that of merging by
    rank over each match of ``pattern``, without special tokens.
    """

    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        coder = codec(path, pattern)
        parts = [coder.encode_all(part).cast(pa.binary()) for part in slices(texts, ENCODED)]
        return pa.chunked_array(parts, pa.binary()).combine_chunks()

    return docs.withColumn(out, ids_of(F.col(text).cast("string")))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the bytes that the packed ``ids`` stand for (a token may end inside a character)."""

    @F.arrow_udf("binary")
    def bytes_of(packed: pa.Array) -> pa.Array:
        coder = codec(path, pattern)
        return pa.chunked_array([coder.decode_all(part).cast(pa.binary()) for part in slices(packed, DECODED)], pa.binary()).combine_chunks()

    return encoded.withColumn(out, bytes_of(F.col(ids)))


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _digests(path: str, pattern: str, with_ids: bool):
    """Column function: DIGESTS of a text's round trip, and its packed ``ids`` if asked for.

    One function does both ways, as Spark would evaluate an encoder twice: for its ids and again inside the decoder's call.
    """
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary()} if with_ids else {})

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
    def digests(texts: pa.Array) -> pa.Array:
        coder, columns = codec(path, pattern), {name: [] for name in fields}
        for part in slices(texts, ENCODED):
            packed = coder.encode_all(part)
            sizes = pc.divide(pc.binary_length(packed), 4)
            columns["n_tokens"].append(sizes.cast(pa.int64()))
            columns["ids_sha256"].append(hashes(packed))
            columns["decoded_sha256"] += [hashes(coder.decode_all(few)) for few in slices(packed, DECODED)]
            if with_ids:
                columns["ids"].append(packed.cast(pa.binary()))
        whole = [pa.chunked_array(columns[name], kind).combine_chunks() for name, kind in fields.items()]
        return pa.StructArray.from_arrays(whole, names=list(fields))

    return digests


def hashes(values: pa.Array) -> pa.Array:
    """Lowercase SHA-256 hex of each."""
    return pa.array([hashlib.sha256(value.as_buffer()).hexdigest() for value in values], pa.string())


def with_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with their packed ``ids`` and, of a round trip through them, n_tokens, ids_sha256 and decoded_sha256.

    Columns that already have such a name are replaced.
    """
    trip = free_name(docs, "_trip")
    coded = docs.withColumn(trip, _digests(path, pattern, True)(F.col("text").cast("string")))
    return coded.withColumns({name: F.col(f"{trip}.{name}") for name in ["ids", *DIGESTS]}).drop(trip)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    trip = _digests(path, pattern, False)(F.col("text").cast("string"))
    return docs.select("doc_id", trip.alias("trip")).select("doc_id", *(F.col(f"trip.{name}") for name in DIGESTS))
