"""Running sums and carried values over sorted rows, however long one run of rows is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from gavilla.session import materialise


def scan(df: DataFrame, keys: list[str], run: str | None = None, sums: tuple = (), carried: tuple = (), highest: tuple = ()) -> DataFrame:
    """``df`` in the order of its unique ``keys``, within each run of equal ``run`` (a bigint, the first key; None: one run).

    Adds ``sum_<c>``, the sum of c up to and with the row, ``last_<c>``, the last c that is not null up to and with the row,
    and ``high_<c>``, the greatest c of the rows before. Rows are sorted into range partitions, each works on its own, and one
    row per partition tells the later ones what to add: no task sees more than its range, whatever a run holds.
    """
    names = df.columns
    extra = [*(f"sum_{c}" for c in sums), *(f"last_{c}" for c in carried), *(f"high_{c}" for c in highest)]
    kind = {f.name: f.dataType for f in df.schema.fields}
    fields = [StructField(name, kind[c]) for name, c in zip(extra, [*sums, *carried, *highest])]
    placed = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys)
    marks = [StructField("_part", IntegerType()), StructField("_row", LongType()), StructField("_first", BooleanType())]
    schema = StructType([*df.schema.fields, *fields, *marks])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, in_head, last_run = 0, True, None
        total, last, high = dict.fromkeys(sums, 0), dict.fromkeys(carried), dict.fromkeys(highest, -np.inf)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            named = dict(zip(batch.schema.names, batch.columns))
            runs = named[run].to_numpy(zero_copy_only=False) if run else np.zeros(n, np.int64)
            goes_on = row > 0 and runs[0] == last_run
            cuts = np.flatnonzero(runs[1:] != runs[:-1]) + 1
            pieces = list(zip([0, *cuts], [*cuts, n]))
            # The run at the head of the partition may have begun in an earlier one.
            in_head = in_head and (row == 0 or goes_on)
            head = np.zeros(n, bool)
            head[: pieces[0][1]] = in_head
            in_head = in_head and len(pieces) == 1
            out = []
            for c in sums:
                x = named[c].to_numpy(zero_copy_only=False)
                upto = np.cumsum(x)
                starts = np.array([s for s, _ in pieces])
                base = upto[starts] - x[starts]
                base[0] = -total[c] if goes_on else 0
                summed = upto - np.repeat(base, np.diff([*starts, n]))
                total[c] = summed[-1]
                out.append(pa.array(summed))
            for c in carried:
                filled = [pc.fill_null_forward(named[c].slice(s, e - s)) for s, e in pieces]
                if goes_on and last[c] is not None:
                    filled[0] = pc.fill_null(filled[0], last[c])
                joined = pa.concat_arrays(filled)
                last[c] = joined[-1] if joined[-1].is_valid else None
                out.append(joined)
            for c in highest:
                x = named[c].to_numpy(zero_copy_only=False).astype(float)
                x = np.where(np.isnan(x), -np.inf, x)
                before = np.empty(n)
                for i, (s, e) in enumerate(pieces):
                    lead = high[c] if i == 0 and goes_on else -np.inf
                    best = np.maximum.accumulate(np.append(lead, x[s:e]))
                    before[s:e], high[c] = best[:-1], best[-1]
                out.append(pa.array([None if b == -np.inf else int(b) for b in before], pa.int64()))
            last_run = runs[-1]
            marks = [named["_part"], pa.array(np.arange(row, row + n)), pa.array(head)]
            row += n
            own = [named[c] for c in names]
            yield pa.RecordBatch.from_arrays([*own, *out, *marks], names=[*names, *extra, "_part", "_row", "_first"])

    done = materialise(placed.mapInArrow(work, schema), "scan")
    # One row a partition: its runs at both ends, and what the last one has come to.
    at_end = lambda c: F.max_by(c, "_row").alias(c)
    tail_run, head_run = (F.max_by(run, "_row"), F.min_by(run, "_row")) if run else (F.lit(0), F.lit(0))
    top = [F.max(F.struct("_row", F.greatest(F.coalesce(f"high_{c}", F.col(c)), F.coalesce(c, F.col(f"high_{c}"))).alias("x")))["x"].alias(f"high_{c}") for c in highest]
    ends = done.groupBy("_part").agg(
        *[at_end(f"sum_{c}") for c in sums], *[at_end(f"last_{c}") for c in carried], *top, tail_run.alias("_tail"), head_run.alias("_head")
    )
    # Partitions in order, those that end in a run before those that begin in it.
    values = [F.col(c) for c in extra]
    nothing = [F.lit(None).alias(c) for c in extra]
    told = ends.select("_part", F.col("_tail").alias("_run"), F.lit(True).alias("_tells"), *values)
    asks = ends.select("_part", F.col("_head").alias("_run"), F.lit(False).alias("_tells"), *nothing)
    before = Window.partitionBy("_run").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    start = told.unionByName(asks).select(
        "_part", "_tells",
        *[F.sum(f"sum_{c}").over(before).cast(kind[c]).alias(f"_sum_{c}") for c in sums],
        *[F.max(f"high_{c}").over(before).alias(f"_high_{c}") for c in highest],
        *[F.max(F.when(F.col(f"last_{c}").isNotNull(), F.struct(F.col("_part").alias("p"), F.col(f"last_{c}").alias("x")))).over(before)["x"].alias(f"_last_{c}") for c in carried],
    )
    shifted = done.join(F.broadcast(start.where("NOT _tells").drop("_tells")), "_part")
    mine = F.col("_first")
    return shifted.withColumns(
        {f"sum_{c}": F.when(mine, F.col(f"sum_{c}") + F.coalesce(f"_sum_{c}", F.lit(0).cast(kind[c]))).otherwise(F.col(f"sum_{c}")) for c in sums}
        | {f"last_{c}": F.coalesce(f"last_{c}", F.when(mine, F.col(f"_last_{c}"))) for c in carried}
        | {f"high_{c}": F.when(mine, F.greatest(f"high_{c}", f"_high_{c}")).otherwise(F.col(f"high_{c}")) for c in highest}
    ).select(*names, *extra)
