"""The split paths for very large groups give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows_of
from vigilseq.operators import ordered, sessions
from vigilseq.sources import staging


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_positions_do_not_depend_on_the_pieces(skewed, pieces):
    w = Window.partitionBy("session_id").orderBy("ts", "tiebreak")
    wanted = skewed.select("session_id", "tiebreak", (F.row_number().over(w) - 1).cast("bigint"))
    found = sessions.with_position(skewed, pieces).select("session_id", "tiebreak", "pos")
    assert rows_of(found) == rows_of(wanted)


def test_totals_and_sums_of_a_hot_group(skewed):
    arguments = (["session_id"], ["ts", "tiebreak"], {"before": F.col("label")}, {"n": F.count(F.lit(1))})
    plain = ordered.running_totals(skewed, *arguments)
    split = ordered.running_totals(skewed, *arguments, pieces=9)
    names = ["session_id", "tiebreak", "before", "n"]
    assert rows_of(plain.select(names)) == rows_of(split.select(names))


def test_global_order_is_split_too(skewed):
    arguments = ([], [F.desc("tiebreak")], {"at": F.lit(1)})
    plain = ordered.running_totals(skewed, *arguments).select("tiebreak", "at")
    split = ordered.running_totals(skewed, *arguments, pieces=5).select("tiebreak", "at")
    assert rows_of(plain) == rows_of(split)


def test_null_keys_form_a_group(skewed):
    keyed = skewed.withColumn("session_id", F.when(F.col("session_id") != "hot", F.col("session_id")))
    plain = sessions.with_position(keyed).select("tiebreak", "pos")
    split = sessions.with_position(keyed, 9).select("tiebreak", "pos")
    assert rows_of(plain) == rows_of(split)


@pytest.mark.parametrize("chunk_rows", [7, 64, 65_536])
def test_look_back_crosses_chunk_edges(skewed, chunk_rows):
    w = Window.partitionBy("session_id").orderBy("pos")
    numbered = sessions.with_position(skewed)
    wanted = numbered.select("tiebreak", F.lag("event", 1).over(w), F.lag("event", 3).over(w))
    found = sessions.with_previous(numbered, 3, chunk_rows).select("tiebreak", "prev1", "prev3")
    key = lambda rows: sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0])
    assert key(found) == key(wanted)


def test_look_back_must_fit_a_chunk(skewed):
    with pytest.raises(ValueError):
        sessions.with_previous(sessions.with_position(skewed), 3, chunk_rows=3)


def test_sliding_windows_cross_chunk_edges(skewed):
    numbered = sessions.with_position(skewed)
    plain = sessions.sliding_windows(numbered, 20, 5)
    cut = sessions.sliding_windows(numbered, 20, 5, chunk_rows=23)
    assert rows_of(plain) == rows_of(cut)
    assert plain.filter("session_id = 'hot'").count() == len(range(0, 381, 5))


@pytest.mark.parametrize("pieces", [1, 9])
def test_quantiles_match_numpy(spark, pieces):
    rng = np.random.default_rng(1)
    values = [("a", float(v)) for v in rng.integers(0, 40, 333)] + [("b", float(v)) for v in rng.normal(size=50)]
    df = spark.createDataFrame(values, "g string, v double")
    qs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q99": 0.99, "q100": 1.0}
    for row in ordered.quantiles(df, "v", qs, ["g"], pieces).collect():
        group = [v for g, v in values if g == row["g"]]
        for name, q in qs.items():
            assert row[name] == pytest.approx(np.quantile(group, q))


@pytest.mark.parametrize("pieces", [1, 9, 300])
def test_sessions_with_previous_events(skewed, pieces):
    names = ["session_id", "tiebreak", "pos", "session_label", "n_events", "prev1", "prev2"]
    wanted = sessions.with_previous(sessions.sessionize(skewed), 2).select(names)
    found = sessions.sessionize_with_previous(skewed, 2, pieces).select(names)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_building_starts_no_count_job(spark, skewed):
    """The only jobs are the sampling and the writing of the ranged rows; no group is counted or collected."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "running totals")
    ordered.running_totals(skewed, ["session_id"], ["ts", "tiebreak"], {"at": F.lit(1)}, pieces=6)
    jobs = len(tracker.getJobIdsForGroup("building"))
    spark.sparkContext.setJobGroup("writing", "ranged rows")
    staging.stage(skewed.repartitionByRange(6, "session_id", "ts", "tiebreak"))
    assert jobs == len(tracker.getJobIdsForGroup("writing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_staged_tables_go_to_the_named_folder(spark, skewed):
    named = spark.conf.get("spark.checkpoint.dir")
    staged = staging.stage(skewed)
    assert all(named in f for f in staged.inputFiles())
    assert rows_of(staged) == rows_of(skewed)


def test_small_tables_are_ordered_at_once_with_the_same_result(spark, skewed, tmp_path):
    """A table that the optimizer knows to be small is not ranged; its rows are those of the ranged path."""
    path = str(tmp_path / "log")
    skewed.write.parquet(path)
    small = spark.read.parquet(path)
    assert ordered.estimated_bytes(small) < ordered.SMALL_BYTES < ordered.estimated_bytes(skewed)
    arguments = (["session_id"], ["ts", "tiebreak"], {"at": F.lit(1), "errors": F.col("label")}, {"n": F.count(F.lit(1))}, ("event", 3))
    at_once = ordered.running_totals(small, *arguments, small_bytes=ordered.SMALL_BYTES)
    assert "_piece" not in at_once._jdf.queryExecution().toString()
    ranged = ordered.running_totals(small, *arguments, pieces=7)
    assert rows_of(at_once.select(ranged.columns)) == rows_of(ranged)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_summaries_are_ordered_either_way(spark, skewed, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SMALL_ROWS", limit)
    counts = skewed.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    found = ordered.running_totals(counts, [], ["event"], {"before": F.col("n")}, {"all": F.sum("n")}, summary=True)
    total, wanted = 0, []
    for event, n in rows_of(counts):
        wanted.append((event, n, total, 600))
        total += n
    assert rows_of(found) == wanted
