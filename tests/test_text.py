import re

import numpy as np
from pyspark.sql import functions as F

from gavilla.functions import text as T
from gavilla.functions.banding import choose_bands
from gavilla.operators import keys as K, prepare as P
from gavilla.sources import files

EDGES = [
    "  A B  ", "a 　b", "a\x1cb", "\x1f12\x1f", "a\u0085b", "İstanbul", "ΟΔΟΣ", "ẞß",
    "\U0001f600", "\U0001f600\U0001f601", "a​b", None, "NA", "", "1", "12", "12 34", "١٢٣", "²3", "a", "ab", "   ",
]


def python_clean(text):
    return "" if text is None else re.sub(r"\s+", " ", text.lower().strip())


def test_clean_and_valid_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, comentario string")
    rows = P.clean_texts(df).withColumn("ok", T.is_valid(F.col("comentario_clean"))).orderBy("i").collect()
    for row, text in zip(rows, EDGES):
        wanted = python_clean(text)
        assert row["comentario_clean"] == wanted, repr(text)
        assert row["ok"] == (len(wanted) >= 2 and not re.fullmatch(r"\d+", wanted)), repr(text)


def test_grams(spark):
    texts = ["hola", "ab", "aaaa", "\U0001f600x\U0001f601y", "a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = {r["c"]: set(r["g"]) for r in df.select("c", T.gram_set(F.col("c")).alias("g")).collect()}
    for t in texts:
        wanted = {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)} or set(t)
        assert got[t] == wanted
    assert {r["g"] for r in df.where("c = 'hola'").select(F.explode(T.gram_set(F.col("c"), 3, 3)).alias("g")).collect()} == {"hol", "ola"}


def test_word_grams_stay_inside_words(spark):
    text = "no es facil"
    df = spark.createDataFrame([(text,)], "c string")
    wanted = []
    for word in text.split():
        padded = f" {word} "
        wanted += [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
    assert sorted(df.select(T.word_grams(F.col("c")).alias("g")).first()["g"]) == sorted(wanted)


def test_band_choice():
    found = {(t, n): choose_bands(t, n) for t, n in [(0.3, 128), (0.2, 128), (0.4, 128), (0.3, 64), (0.5, 128)]}
    assert found == {(0.3, 128): (37, 3), (0.2, 128): (28, 2), (0.4, 128): (32, 4), (0.3, 64): (21, 3), (0.5, 128): (25, 5)}


def test_numbers_follow_the_key_in_many_partitions(spark):
    df = spark.range(5000).select((F.xxhash64("id")).alias("k")).repartition(7)
    rows = K.number_rows(df, ["k"]).orderBy("k").collect()
    assert [r["id"] for r in rows] == list(range(5000))


def test_attach_gives_the_same_rows_with_hot_groups(spark):
    members = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("k"))
    groups = members.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    plain = members.join(groups.drop("n"), "k")
    hot = K.attach(members, groups, ["k"], 3000)
    columns = sorted(plain.columns)
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, hot.select(columns).collect()))


def test_csv_keeps_quotes_breaks_and_order(spark, tmp_path):
    path = tmp_path / "texts.csv"
    path.write_text('otro,comentario,mas\n1,"a, ""b""",x\n2,"two\nlines",y\n3,,z\n4,NA,w\n5,  pad ,v\n', encoding="utf-8")
    rows = files.read_csv_texts(spark, str(path)).orderBy(*files.POSITION).collect()
    assert [r["comentario"] for r in rows] == ['a, "b"', "two\nlines", "", "NA", "  pad "]
    assert files.read_csv_texts(spark, str(path)).count() == 5
    loaded = P.load_and_clean(files.read_csv_texts(spark, str(path)), files.POSITION).orderBy("id").collect()
    assert [(r["id"], r["comentario_clean"]) for r in loaded] == [(0, 'a, "b"'), (1, "two lines"), (2, "na"), (3, "pad")]


def test_terms_are_counted_by_id_whatever_a_task_reads_at_once(spark, monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from gavilla.operators import tfidf as TF

    rng = np.random.RandomState(2)
    letters = list("ab  \u00e9\U0001d11ez\u2028\n")
    texts = ["".join(rng.choice(letters, rng.choice([0, 1, 4, 30]))) for _ in range(40)] + [None, None, "ab  ab", " "]
    # Ids repeat and are null, and one has a third of the rows.
    ids = [None if i % 9 == 0 else 5 if i % 3 == 0 else i // 2 for i in range(len(texts))]
    wanted = Counter()
    for i, text in zip(ids, texts):
        for n in (3, 4, 5) if text is not None else ():
            wanted.update((i, m) for m in re.findall(f"(?=([^\n\r\x85\u2028\u2029][^ ]{{{n - 2}}}[^\n\r\x85\u2028\u2029])).", f" {text} "))
    df = spark.createDataFrame(list(zip(ids, texts)), "id bigint, comentario_clean string")
    found = TF.term_counts(df).collect()
    assert len(found) == len(wanted) and {(r["id"], r["term"]): r["tf"] for r in found} == wanted
    # In pieces of a few bytes, an id goes on from one to the next.
    order = sorted(range(len(ids)), key=lambda j: (ids[j] is not None, ids[j] or 0))
    batch = pa.RecordBatch.from_arrays([pa.array([ids[j] for j in order], pa.int64()), pa.array([texts[j] for j in order])], names=["id", "text"])
    called, given = [], TF._grams_of_words
    monkeypatch.setattr(TF, "_grams_of_words", lambda words: called.append(len(words)) or given(words))
    for chunk in (1, 50, 1 << 21):
        monkeypatch.setattr(TF, "CHUNK", chunk)
        pieces = [row for part in TF._count_terms([batch.slice(0, 7), batch.slice(7)]) for row in part.to_pylist()]
        assert len(pieces) == len(wanted) and {(r["id"], r["term"]): r["tf"] for r in pieces} == wanted
    # A word that comes again is cut into grams once for a piece.
    called.clear()
    many = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["word " * 500, "word other " * 500])], names=["id", "text"])
    assert sum(part.num_rows for part in TF._count_terms([many])) == 9 + 21 and called == [3]
