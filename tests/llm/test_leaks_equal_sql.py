"""The SQL of benchmark leaks beside the engine, on texts that the given tables do not hold."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gavilla.llm import decontaminate, oracles
from tests.compare import differences
from tests.llm.frames import PROSE
from tests.llm.test_group_operators import QUESTION

duckdb = pytest.importorskip("duckdb")
WORDS = " ".join(f"word{chr(97 + i)} stands here" for i in range(20))


def texts():
    changed = QUESTION.replace("Alice", "Carol").replace("Smith", "Jones").replace("Bob", "Dan").replace("12", "77").replace("3.5", "9")
    sacks = f"There were 40 sacks and again 40 sacks; {WORDS}"
    docs = [
        (1, "x y. " + QUESTION + " z"), (2, changed), (3, changed.replace("so Carol", "so Erin")), (4, None), (5, ""), (6, PROSE), (2, changed),
        (7, QUESTION.replace(" ", "\n  ")), (8, sacks.replace("again 40", "again 41")), (9, sacks), (None, QUESTION), (10, QUESTION + " " + changed),
        (11, QUESTION + "\n" + QUESTION + "\n" + changed), (12, "word " * 400 + QUESTION), (13, "\t" + sacks.replace("; ", ";\r\n\r\n")), (14, (sacks + " ") * 12),
        (15, "say one two three four five now"),
    ]
    return docs, [(1, QUESTION), (2, sacks), (3, "one two three four five"), (4, None), (None, PROSE), (1, QUESTION), (5, "too short")]


def test_leaks_equal_sql(spark, tmp_path):
    """Wrapped, partly changed and repeated texts; two alignments of one item in one text; ties."""
    docs, items = texts()
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        table = pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    found = decontaminate.matches(*[spark.read.parquet(str(tmp_path / f"{name}.parquet")) for name in ("documents", "benchmark")]).toPandas()
    assert differences(found, con.execute(oracles.LEAKS).df()) == ""
    leaks = set(zip(found.doc_id, found.item_id))
    assert {(1, 1), (2, 1), (7, 1), (8, 2), (9, 2), (10, 1), (11, 1), (12, 1), (13, 2), (14, 2), (15, 3)} <= leaks and not {d for d, _ in leaks} & {4, 5, 6}
