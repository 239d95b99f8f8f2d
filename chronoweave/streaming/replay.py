"""The daily replay as a stream: one day a trigger, found people carried as state for each arm and budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "arm string, k int, day timestamp, inspected int, found int"
STATE = "people string"


def daily_volume(events: DataFrame, late: str = "28 days") -> DataFrame:
    """day, n of a stream with column t; a day is final once the watermark (labels mature that late) has passed it."""
    return events.withWatermark("t", late).groupBy(F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")


def replay_stream(pool: DataFrame, scores: tuple[str, ...], ks: tuple[int, ...], caught: DataFrame | None = None) -> DataFrame:
    """Inspections and finds by arm, budget and day; pool: day, identity, row_ix, hidden, scores, days arriving in order, whole.

    caught (identity, caught_time; a table) takes out rows of people who were officially caught strictly before the day.  A
    stream cannot rank a day before the state is known, so an arm's rows of a trigger meet in one group, each with only the
    columns that the step reads; days are cut to their budget inside it, and the state holds the people found, one a line.
    """
    if caught is not None:
        known = caught.select(F.col("identity").alias("caught_identity"), "caught_time")
        joined = pool.join(known, F.col("identity") == F.col("caught_identity"), "left")
        pool = joined.where(F.col("caught_time").isNull() | (F.col("caught_time") >= F.col("day"))).select(*pool.columns)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k"), F.col(a).alias("s")) for a in scores for k in ks])).alias("x")
    rows = pool.select("day", "identity", "row_ix", "hidden", cells).select("day", "identity", "row_ix", "hidden", "x.*")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = set(state.get[0].split("\n")) - {""} if state.exists else set()
        every = pd.concat(list(parts))
        out = []
        for day, day_rows in every.groupby("day", sort=True):
            left = day_rows[~day_rows["identity"].isin(gone)].sort_values(["s", "row_ix"], ascending=[False, True], kind="stable").head(int(key[1]))
            found = set(left.loc[left["hidden"], "identity"])
            gone |= found
            out.append((key[0], int(key[1]), day, len(left), len(found)))
        state.update(("\n".join(sorted(gone)),))
        yield pd.DataFrame(out, columns=["arm", "k", "day", "inspected", "found"])

    return rows.groupBy("arm", "k").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
