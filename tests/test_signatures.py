"""Signatures against the plain definition, and each distinct gram hashed and permuted once for a chunk of texts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from gavilla.functions import text as T
from gavilla.operators import minhash as M


def plain(text, pairs):
    grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} if len(text) >= 3 else set(text) or {""}
    grams = [g for g in grams if len(text) < 3 or not set(g) & set(M.LINE_ENDS)]
    hashes = [int(hashlib.sha1(g.encode()).hexdigest()[:8], 16) % T.PRIME for g in grams]
    return [min(((a * h + b) % T.PRIME for h in hashes), default=T.PRIME) for a, b in pairs]


def odd_texts():
    rng = random.Random(4)
    wide = [chr(c) for c in range(0x4E00, 0x9000)]
    texts = ["", "a", "ab", "abc", "\n", "a\nbc", "a\nbcdef gh", "\0\0\0\0", "x\0y\0z", "\U0001f600x\U0001f601y", "é" * 40]
    texts += ["".join(rng.choices("abcd e", k=n)) for n in (50, 500, 5000)]
    # So many letters that five of them do not fit in one number.
    return texts + ["".join(rng.choices(wide, k=n)) for n in (90, 9000)]


def test_signatures_of_odd_texts(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id bigint, comentario_clean string")
    found = {r["id"]: r["sig"] for r in M.signatures(df, 16).collect()}
    pairs = M.coefficients(16)
    assert found.pop(-1) == [T.PRIME] * 16
    assert found == {i: plain(t, pairs) for i, t in enumerate(texts)}
    # The column expression tells the same grams apart.
    grams = df.where("id >= 0").select("id", F.transform(T.gram_set(F.col("comentario_clean")), T.gram_hash).alias("h")).collect()
    for row in grams:
        hashes, gram, owner = M._chunk_grams([texts[row["id"]]], 3, 5)
        assert sorted(hashes.tolist()) == sorted(row["h"]) and len(gram) == len(owner) == len(hashes)


def test_a_gram_is_hashed_once_for_a_chunk(monkeypatch):
    asked = []
    monkeypatch.setattr(M, "_hash", lambda gram: asked.append(gram) or len(asked))
    hashes, gram, owner = M._chunk_grams(["hola hola", "hola", "la h"] * 20, 3, 5)
    assert len(asked) == len(set(asked)) == len(hashes)
    assert len(set(zip(gram.tolist(), owner.tolist()))) == len(gram) and np.all(np.diff(gram) >= 0)
