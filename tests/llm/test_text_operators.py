"""Quality, tokens, licences and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from gavilla.llm import catalog, licences, quality, tokens, toxicity
from tests.llm.frames import LONG, PROSE, TEXTS, base_counts, documents

PATH = public_tokenizers.path(catalog.RANKS)


@pytest.fixture(scope="module")
def codec():
    return tokens.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_codec_equals_library_on_odd_texts(codec, library):
    rng = random.Random(5)
    letters = "  \x1c\x85  aeiou thresing'sdtßéèü0123😀漢字\n\t.,!aaaa"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert ids(codec.encode(text)) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)).decode() == text
    for text in (LONG, "a" * 50_000, "\n" * 3000, " " * 3000):
        assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_batches_equal_library(codec, library):
    """Nulls, empty texts, texts that are taken whole and parts of a batch, all in one array."""
    rng = random.Random(9)
    words = ["the", "thres", "ingly,", "x\ny", "\n", "", "it's", "12.5", "été", "\u00a0z", "a" * 60, "(ok)...", "\x85"]
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(3000)), " ".join(words * 3000)]
    wanted = [library.encode_ordinary(text or "") for text in texts]
    for size in (1 << 30, 2000, 1):
        array = pa.array(["before", *texts]).slice(1)
        found = [packed.as_py() for part in tokens.slices(array, size) for packed in codec.encode_all(part)]
        assert [ids(packed) for packed in found] == wanted
    assert len(codec.encode_all(pa.array([], pa.string()))) == 0
    back = codec.decode_all(codec.encode_all(pa.array(texts)).slice(2))
    assert [value.as_py().decode() for value in back] == [text or "" for text in texts[2:]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_codec_equals_library(codec, library, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_codec_without_ordered_ranks_or_cut(codec):
    """A table whose parts do not always rank before what they form is merged the plain way."""
    import base64
    import tempfile

    table = [bytes([c]) for c in range(256)] + [b"abc", b"ab", b"bc", b"cab", b"abcab"]
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as file:
        file.writelines(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(table))
        file.flush()
        own = tokens.Codec(file.name, r"\S+|\s+")
    ref = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(table)}, special_tokens={})
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
        assert ids(own.encode(text)) == ref.encode_ordinary(text)


def test_token_query(spark, sf, library):
    found = catalog.op4_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(found) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        wanted = np.array(library.encode_ordinary(text), dtype="<u4")
        row = found.loc[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(wanted), hashlib.sha256(wanted.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_tokens_on_awkward_rows(spark):
    docs = documents(spark)
    found = tokens.with_digests(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(found.columns) == sorted({*docs.columns, "ids", *tokens.DIGESTS})
    rows = found.collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert row.n_tokens == len(row.ids) // 4
    assert tokens.token_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


# -- quality ----------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", "#x", "é"]), max_size=60).map(" ".join))
def test_base_counts(text):
    assert tuple(quality.statistics(text)[0]) == base_counts(text)


def test_forest_scores_equal_recursion():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 4)).astype(np.float32)
    forest = quality.Forest(rows, trees=20, sample=64)

    def walk(tree, node, row):
        f = forest.feature[tree, node]
        return forest.path[tree, node] if f < 0 else walk(tree, 2 * node + 1 + int(row[f] > forest.split[tree, node]), row)

    paths = np.array([[walk(t, 0, row) for t in range(20)] for row in rows[:40]])
    expected = 2.0 ** (-paths.mean(axis=1) / quality._expected(64))
    assert np.allclose(forest.score(rows[:40]), expected)


def test_quality_query(spark, sf):
    found = catalog.op1_quality_rules(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(found) == len(docs)
    for row in found.itertuples():
        counts = base_counts(docs[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (row.kept and row.base_failed)
    both = found[~found.base_failed].merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.95
    assert both[both.quality == 0].kept.mean() < 0.2


def test_quality_on_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 0), (None, 1, 1), (2, None, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.verdicts(docs, known).collect()
        assert len(rows) == len(TEXTS)
        assert all(not r.kept for r in rows if r.n_words < 20)
        kept = quality.keep_good(docs, known)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.kept for r in rows)
    assert quality.verdicts(docs.limit(0), labels).count() == 0


def test_long_texts_of_few_words_stand_out():
    rate = lambda words: quality.statistics(" ".join(words))[1][-1]
    rng = random.Random(4)
    few = [f"w{i}" for i in range(210)]
    assert rate(few) == 1
    assert rate(rng.choices(few, k=20_000)) < 0.15
    assert rate(rng.choices(few, k=200_000)) < rate(rng.choices(few, k=20_000)) < rate(rng.choices(few, k=2000)) < 0.4
    assert rate([f"w{i}" for i in range(20_000)]) == 1
    # Nor do very long words or very many marks end at a bound.
    sizes = [quality.statistics("x" * n + " y")[1][0] for n in (10, 100, 1000, 100_000)]
    marks = [quality.statistics("#" * n + " y")[1] for n in (10, 100, 1000, 100_000)]
    assert sizes == sorted(set(sizes)) and all(a[i] < b[i] for a, b in zip(marks, marks[1:]) for i in (1, 3))


def test_forest_with_values_a_rounding_apart():
    """A split may round to the largest value and leave a side empty."""
    low = np.float32(1.0)
    rows = np.array([[low], [np.nextafter(low, np.float32(2))]] * 50, dtype=np.float32)
    scores = quality.Forest(rows, trees=200).score(rows)
    assert np.isfinite(scores).all()


# -- licences -----------------------------------------------------------------------------------------


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licences.PHRASES.items():
        size = len(phrase.split())
        places += [(i, label) for i in range(len(words) - size + 1) if words[i : i + size] == phrase.split()]
    return len(words), sorted(places)


def test_licence_query(spark, sf):
    found = catalog.op8_license_scan(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(found) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        row, (n_words, places) = found.loc[doc_id], plain_base(text)
        assert (row.n_words, row.n_base) == (n_words, len(places))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert {label for _, label in places} <= set(row["labels"].split(","))
        if places:
            assert (row.first_word, row.last_word) == (places[0][0], places[-1][0])


def test_licence_rules():
    scanner = licences.Scanner()
    assert len(scanner.rules) > 200
    labels = lambda text: [label for *_, label, _ in scanner.detect(text.lower())]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3.0"]
    assert labels("licensed under the GNU Affero General Public License, version 3") == ["agpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0. Some files: MIT License") == ["cc-by-nc-4.0", "mit"]
    assert labels("the committee will submit a plan") == []
    for identifier in ("MIT", "ISC", "BSL-1.0", "EUPL-1.2", "CC-BY-SA-4.0"):
        assert labels(f"// SPDX-License-Identifier: {identifier}\nint x;") == [identifier.lower()]
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH x") == ["mit", "apache-2.0", "gpl-2.0"]
    assert labels("License: MIT") == labels("Licensed under MIT.") == labels("license = 'MIT'") == ["mit"]
    assert labels("License: MIT-0") == ["mit-0"]
    assert labels("GPL, LGPL; AGPL") == ["gpl", "lgpl", "agpl"]
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    assert labels(grant) == ["mit"]
    # A name ends where its word ends.
    assert labels("released under the GPL 20 years ago") == ["gpl"]
    assert labels("licensed under cc0ver, or under the apache-20 scheme; license: mitten, licensed under mit.example") == []
    # Long expressions and long runs of tags are read in one pass.
    assert len(scanner.detect("spdx-license-identifier: " + "zzz or " * 50_000 + "mit " + "spdx-license-identifier: q or " * 20_000)) == 1
    # Nothing that stays lies inside another of higher priority, as checked over all pairs.
    found = scanner.detect(("licensed under the mit license. cc by-nc-sa 4.0, gpl v2, lgpl 2.1 " * 20).lower())
    for a, b, _, s in found:
        assert not any((c, d) != (a, b) and c <= a and b <= d and t >= s for c, d, _, t in found)


def spelled(parts, rng):
    """A random text that a parsed pattern matches, its blanks as line breaks."""
    text = ""
    for kind, value in parts:
        kind = str(kind)
        if kind == "LITERAL":
            text += chr(value)
        elif kind == "IN":
            name, chosen = rng.choice(value)
            text += chr(chosen) if str(name) == "LITERAL" else {"CATEGORY_SPACE": "\n", "CATEGORY_DIGIT": "4"}.get(str(chosen), "x")
        elif kind == "BRANCH":
            text += spelled(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            text += spelled(value[-1], rng)
        elif kind == "MAX_REPEAT":
            text += "".join(spelled(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
        else:
            assert kind == "ASSERT_NOT"
    return text


def test_licence_gates_lose_nothing():
    """Every rule's spellings, wrapped at each blank, open their own gate; wrapped mentions are found."""
    import random

    rng = random.Random(3)
    scanner = licences.Scanner()
    for k, rule in enumerate(scanner.rules):
        parsed = re._parser.parse(rule.pattern.pattern)
        for _ in range(30):
            text = spelled(parsed, rng)
            assert rule.pattern.search(text), (rule, text)
            assert k in scanner.ready(f"as is.\n {text} "), (rule, text)
    labels = lambda text: [label for *_, label, _ in scanner.detect(text.lower())]
    assert labels("the GNU General\nPublic License version 3") == ["gpl-3.0"]
    assert labels("all\nrights  reserved") == ["all-rights-reserved"]
    assert labels("licensed under ODbL") == ["odbl-1.0"]
    assert labels("the X Consortium\n * License".replace(" *", "")) == ["x11"]
    assert labels("Do What The Fun You Want To Public License") == ["wtfpl"]


def test_licences_on_awkward_rows(spark):
    docs = documents(spark)
    rows = licences.licence_labels(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {(r.n_base, r.base_labels, r.labels) for r in rows if r.doc_id == 14} == {(1, "mit", "mit")}
    assert all(r.score == 0 and r["labels"] == "" and r.first_word is None for r in rows if r.doc_id in (3, 4, 5))
    assert licences.licence_labels(docs.limit(0)).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------


def toxic_frame(spark, n=900):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(5, 80))], i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "foul"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_frame(spark)
    found = toxicity.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.3)).all() and found.score.between(0, 1).all()
    unseen = found[found.held_out]
    assert (unseen.predicted == unseen.toxic).mean() > 0.98
    # Labels of held-out rows are never read: turned round, they change nothing.
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, turned).toPandas().set_index("doc_id").score
    assert np.allclose(again[found.doc_id], found.score)


def plain_ftrl(rows, passes=2, alpha=2.0, beta=1.0, l1=3.0, l2=1.0):
    """Weights by slot, one coordinate at a time; slot 0 is the intercept, free of L1."""
    z, n = {}, {}

    def weight(i):
        at = z.get(i, 0.0)
        if i and abs(at) <= l1:
            return 0.0
        shrunk = at - (l1 if at > 0 else -l1) if i else at
        return -shrunk / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(passes):
        for features, label in rows:
            now = {i: weight(i) for i in {0, *features}}
            error = 1 / (1 + math.exp(-sum(now.values()))) - label
            for i, w in now.items():
                rate = ((n.get(i, 0.0) + error**2) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + error - rate * w
                n[i] = n.get(i, 0.0) + error**2
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_weights_equal_plain_ftrl(spark):
    """The learned weights against those of a learner that goes coordinate by coordinate."""
    from pyspark.sql import functions as F

    docs, labels = toxic_frame(spark, 300)
    found = {r.slot: r.weight for r in toxicity.fit(docs, labels).collect()}
    spot = F.xxhash64("doc_id", F.lit("order"))
    known = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = sorted(known.select(spot.alias("spot"), F.pmod(spot, F.lit(2)).alias("shard"), "toxic", "text").collect())
    hashes = toxicity.Words()
    slots = lambda text: set(toxicity.slots(text, hashes).tolist())
    models = [plain_ftrl([(slots(r.text), r.toxic) for r in rows if r.shard == shard]) for shard in (0, 1)]
    wanted = {i: sum(m.get(i, 0.0) for m in models) / 2 for i in {*models[0], *models[1]}}
    assert set(found) == set(wanted) and len(wanted) > 5
    assert all(abs(found[i] - wanted[i]) < 1e-6 for i in wanted)


def test_toxicity_on_awkward_rows(spark):
    docs = documents(spark)
    _, labels = toxic_frame(spark, 20)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int"))
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert all(r.score == 0 for r in toxicity.score(docs, labels.limit(0)).collect())
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.keep_civil(docs, labels.limit(0)).columns == docs.columns
