"""Whitening, language identification and the prefix trie beside plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavilla.llm import catalog, language, oracles, trie, whitening
from tests.compare import connect, differences

# -- whitening ---------------------------------------------------------------------------------------


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.RandomState(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize(
    "v",
    [symmetric(np.linspace(3, 1, 40)), symmetric([5] * 6 + [5 - 1e-9] * 6 + [1e-8] * 6 + [0] * 6), symmetric(np.logspace(0, -14, 30)),
     np.eye(5), np.zeros((4, 4)), np.diag([3.0, 3, 1, 1, 0]), np.array([[2.0]])],
)
def test_spectral_components(v):
    values, vectors = whitening.spectral_components(v)
    norm = np.linalg.norm(v) or 1
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-14 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-13 * norm


def test_polar_factor():
    a = symmetric([4, 1, 1e-9, -1e-6, -2])
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-14 and np.abs(u - u.T).max() < 1e-14
    assert np.linalg.eigvalsh(u @ a).min() > 0


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "mine") for i, v in rows], "vec_id bigint, embedding array<float>, label int, whitened string")


def test_whitening_equals_a_plain_one(spark):
    r = np.random.RandomState(1)
    x = (r.normal(size=(90, 12)) * np.linspace(2, 0.5, 12)).astype(np.float32)
    x[40:70] = x[40]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(100, None), (101, [1.0] * 11 + [None]), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, []), (105, [1.0, 2.0]),
           (106, [3e38] * 12), (None, x[3].tolist()), (5, x[5].tolist())]
    found = whitening.whitened_rows(embeddings(spark, rows + odd)).toPandas()
    kept = [v for _, v in rows] + [x[3].tolist(), x[5].tolist()]
    whole = np.floor(1024 * np.array(kept, float)).astype(np.int64) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    assert set(found.n) == {n} and len(found) == 8 * n and set(found.component) == set(range(1, 9))
    deviation = dict(zip(range(90), ((n * whole - sums) ** 2).sum(axis=1)))
    one = found[found.vec_id < 90]
    assert (one.deviation == one.vec_id.map(deviation)).all()
    centred = whole - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    wanted = centred @ vectors / np.sqrt(values)
    got = found[found.vec_id.isin(range(90)) & (found.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened")
    assert np.abs(np.abs(got.to_numpy()) - np.abs(wanted[[i for i in range(90) if i != 5]])).max() < 1e-9
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, values / np.trace(v), rtol=1e-12)
    assert set(found.identity_error) == {found.identity_error[0]} and found.identity_error[0] < 1e-10


def test_whitening_of_few_equal_and_large_vectors(spark):
    assert whitening.whitened_rows(embeddings(spark, [])).count() == 0
    assert whitening.whitened_rows(embeddings(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whitened_rows(embeddings(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(same) == 15 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, 0.0, 0.0, 0.0)}
    # Two rows span one component; the others have no variance.
    two = whitening.whitened_rows(embeddings(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])])).orderBy("vec_id", "component").collect()
    assert [abs(round(r.whitened, 9)) for r in two] == [1, 0, 1, 0] and two[0].explained == pytest.approx(1)
    assert [r.deviation for r in two] == [3072**2 + 4096**2] * 4
    # An exact deviation that does not fit 64 bits is null.
    wide = whitening.whitened_rows(embeddings(spark, [(1, [0.0]), (2, [4e6]), (3, [1e7])])).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in wide) and any(r.deviation is None for r in wide)


# -- language ----------------------------------------------------------------------------------------

SAID = {
    "en": "the quick brown fox jumps over the lazy dog and would not say whether it had thought that through",
    "de": "der schnelle braune fuchs springt über den faulen hund und wollte nicht sagen ob er das durchdacht hatte",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et ne voulait pas dire où il était allé",
}


def talk(n, seed=0):
    r = np.random.RandomState(seed)
    return [(i, " ".join(r.choice(SAID[lang].split(), r.randint(3, 30))), lang) for i, lang in enumerate(r.choice(list(SAID), n, p=[0.6, 0.3, 0.1]))]


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = f" {' '.join(words)} "
    return [line[i : i + k] for k in range(1, 5) for i in range(len(line) - k + 1) if line[i : i + k] != " "]


@pytest.mark.parametrize("text", ["Straße, ABC def 12 x!", "a", "漢字 und 😀 kana", "one", " x  y\n\tz "])
def test_gram_counts_are_those_of_the_plain_text(text):
    at, counts = language.gram_counts(text)
    grams = plain_grams(text)
    assert counts.sum() == len(grams) and len(at) <= len(set(grams))
    singles = {g: language.gram_counts(g)[0] for g in set(grams) if len(g) == 1}
    assert all(set(s) <= set(at) or g == " " for g, s in singles.items() if f" {g} " in f" {text.lower()} ")


def test_blocks_of_a_long_text_do_not_show(monkeypatch):
    text = "Straße und Ähre, abc def 12 xyz   \n" * 400
    whole = language.gram_counts(text)
    for block in (1, 2, 37, 4096):
        monkeypatch.setattr(language, "BLOCK", block)
        cut = language.gram_counts(text)
        assert all(np.array_equal(x, y) for x, y in zip(whole, cut)), block


def test_learner_follows_the_ftrl_formula():
    """Step by step, coordinate by coordinate, over two rows that share a slot."""
    model = language.Multinomial(2, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    rows = [({3: 0.6, 9: 0.8}, 1), ({3: 1.0}, 0), ({9: 0.5, 11: 0.5}, 1)] * 3
    z, n = {}, {}
    for row, label in rows:
        model.learn(np.array(list(row)), np.array(list(row.values())), label)
        w = {}
        for i in row:
            for c in (0, 1):
                zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
                w[i, c] = 0.0 if abs(zi) <= 0.1 else -(zi - np.sign(zi) * 0.1) / ((1.0 + ni**0.5) / 0.5 + 0.2)
        e = [np.exp(sum(x * w[i, c] for i, x in row.items())) for c in (0, 1)]
        for i, x in row.items():
            for c in (0, 1):
                g = x * (e[c] / sum(e) - (c == label))
                before = n.get((i, c), 0.0)
                n[i, c] = before + g * g
                z[i, c] = z.get((i, c), 0.0) + g - (n[i, c] ** 0.5 - before**0.5) / 0.5 * w[i, c]
    assert all(abs(model.z[k] - v) < 1e-12 for k, v in z.items()) and all(abs(model.n[k] - v) < 1e-12 for k, v in n.items())


def test_document_frequencies_and_temperature(spark):
    rows = talk(40) + [(900, None, "en"), (901, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    n, df = language.document_frequencies(docs.repartition(7))
    wanted = np.zeros(language.SLOTS, int)
    for _, text, _ in rows:
        wanted[language.gram_counts(text)[0]] += 1
    assert n == len(rows) and np.array_equal(df, wanted)
    weights = np.zeros((language.SLOTS + 1, 2))
    weights[5] = [4.0, 0.0]
    # Right three times out of four: the best temperature makes sigmoid(4 / t) three quarters.
    seen = spark.createDataFrame([(int(i % 4 == 0), [5], [1.0]) for i in range(80)], "label int, at array<int>, x array<float>")
    assert language.temperature(seen, weights) == pytest.approx(4 / np.log(3), rel=0.03)
    assert language.temperature(seen.limit(0), weights) == 1.0


def test_held_out_texts_are_told_apart(spark):
    rows = talk(400)
    lies = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "fr"), (1003, SAID["de"] * 9000, None), (None, SAID["en"], "en"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(*row, 1.5, "mine") for row in lies + odd], "doc_id bigint, text string, lang string, score double, lang_pred string")
    found = language.identify(docs).toPandas()
    assert len(found) == 406 and "xx" not in set(found.lang_pred)
    truth = {i: lang for i, _, lang in rows}
    own = found[found.doc_id < 400]
    held = own[own.held_out]
    assert set(held.doc_id) == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97
    by_id = found.set_index("doc_id")
    assert [(by_id.lang_pred[i], by_id.score[i]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id.lang_pred[1003] == "de" and found.score.between(0, 1).all() and by_id.loc[1].drop_duplicates().shape[0] == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert {tuple(r) for r in language.identify(docs).collect()} == {(1, False, "und", 0.0), (2, False, "und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


# -- trie --------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest())
    turns = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        ends = ",".join(str(c) for c in sorted(c for c in members if built[c] == seq))
        leaves = sum(not any(t[: len(s)] == s and len(t) == len(s) + 1 for t in nodes) for s in below)
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "mine") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, n_convs string")


def many_talks():
    r = np.random.RandomState(5)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(205, 215), -3, -150, 9_000_000_000]:
        for t in range(r.randint(1, 9)):
            rows.append((c, t, ["user", "assistant", None][r.randint(3)], ["a", "bb", "", None, "cç😀"][r.randint(5)]))
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(7, None, "system", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "lost"), (400, 0, "user", "x" * 100_000)]
    return rows + [(500, t, "user", str(t)) for t in range(300)]  # much longer than all others


@pytest.mark.parametrize("small", [trie.SMALL, 16])
def test_trie_equals_a_plain_one(spark, small):
    """A hot conversation and copies; with ``small`` 16 the tour is ranked over several levels of stations."""
    rows = many_talks()
    found = trie.prefix_trie(conversations(spark, rows), small=small).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_one(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    assert trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(1, 0, None, None)]
    assert sorted((tuple(r) for r in trie.prefix_trie(conversations(spark, rows)).collect()), key=str) == plain_trie(rows)


def test_list_ranks_of_a_shuffled_chain(spark):
    n, r = 3000, np.random.RandomState(0)
    ids = r.permutation(n)
    arcs = spark.createDataFrame([(int(a), int(b) if b is not None else None, 1) for a, b in zip(ids, [*ids[1:], None])], "arc bigint, to bigint, hops bigint")
    found = {x.arc: x["rank"] for x in trie.list_rank(arcs.repartition(5), small=40).collect()}
    assert found == {int(a): n - i for i, a in enumerate(ids)}


def test_running_sums_wrap_below_the_modulus(spark):
    r = np.random.RandomState(0)
    x = r.randint(0, 1 << 60, 500, dtype=np.int64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "k bigint, v bigint").repartition(6)
    found = [row["sum_v"] for row in trie.running_sums(df, ["k"], ["v"], 1 << 60).orderBy("k").collect()]
    assert found == [sum(map(int, x[: i + 1])) % (1 << 60) for i in range(500)]


def test_trie_equals_sql(spark, sf):
    found = catalog.op13_prefix_trie(spark, sf).toPandas()
    assert differences(found, connect(sf).execute(oracles.ORACLES["op13_prefix_trie"]).df()) == ""
