import pytest
from pyspark.sql import functions as F

from vigilseq.operators import templates
from vigilseq.sources import tables


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def mined(spark, texts, **more):
    return {r["template"]: r["cnt"] for r in templates.mine_templates(lines(spark, texts), **more).collect()}


def test_places_with_many_values_are_open(spark):
    texts = [f"instance {i} launched on node{i % 2}" for i in range(30)] + ["instance stopped", "instance  stopped "]
    assert mined(spark, texts, max_values=5) == {"instance <*> launched on node0": 15, "instance <*> launched on node1": 15, "instance stopped": 2}


def test_frequent_tokens_stay_beside_many_others(spark):
    """Two kinds of line share length and first token; the ids of one kind do not open the words of the other."""
    texts = [f"INFO user u{i} logged in" for i in range(40)] + [f"INFO job started on n{i % 2}" for i in range(20)]
    found = mined(spark, texts, max_values=6, share=0.1)
    assert found == {"INFO user <*> logged in": 40, "INFO job started on n0": 10, "INFO job started on n1": 10}


def test_near_templates_are_merged_until_nothing_changes(spark):
    texts = [f"state {a} by {b} now" for a in ("up", "down", "lost") for b in ("amy", "bob", "eve")]
    assert mined(spark, texts, variants=4) == {t: 1 for t in texts}
    assert mined(spark, texts, variants=3) == {"state <*> by <*> now": 9}


def test_result_does_not_depend_on_order_or_partitions(spark):
    texts = [f"proc p{i % 17} used {i % 5} of {i} units" for i in range(200)] + ["proc ended"] * 3
    one = mined(spark, texts, max_values=4)
    other = templates.mine_templates(lines(spark, texts[::-1]).repartition(7), max_values=4, broadcast_rows=0)
    assert one == {r["template"]: r["cnt"] for r in other.collect()}
    ids = {r["template"]: r["event"] for r in other.collect()}
    assert ids == {r["template"]: r["event"] for r in templates.mine_templates(lines(spark, texts * 2), max_values=4).collect()}


def test_nothing_to_mine(spark):
    assert mined(spark, []) == {} and mined(spark, [None, "", " \t "]) == {}


@pytest.mark.parametrize("limit", [0, 1000])
def test_unseen_lines_match_the_narrowest_template(spark, limit):
    known = lines(spark, ["a <*> c", "a b <*>", "<*> <*> c", "x <*>"]).withColumnRenamed("line", "template")
    rows = lines(spark, ["a b c", "a q c", "q q c", "a b z", "x 1", "x 1", "y 1", "a", None, ""])
    found = templates.match_templates(rows, known, broadcast_rows=limit).collect()
    got = sorted((r["line"] or "", r["template"] or "", r["known"]) for r in found)
    assert got == [
        ("", "", False), ("", "", False), ("a", "a", False), ("a b c", "a <*> c", True), ("a b z", "a b <*>", True), ("a q c", "a <*> c", True),
        ("q q c", "<*> <*> c", True), ("x 1", "x <*>", True), ("x 1", "x <*>", True), ("y 1", "y 1", False),
    ]


def test_extension_keeps_known_ids(spark):
    first = templates.mine_templates(lines(spark, [f"task t{i} done" for i in range(9)]), max_values=4)
    more = [f"task t{i} done" for i in range(100, 104)] + [f"disk d{i} is full" for i in range(9)]
    found = templates.extend_templates(first, lines(spark, more), max_values=4)
    assert {(r["template"], r["cnt"], r["n_open"]) for r in found.collect()} == {("task <*> done", 13, 1), ("disk <*> is full", 9, 1)}
    assert {r["event"] for r in first.collect()} <= {r["event"] for r in found.collect()}


def test_events_take_learned_templates(spark):
    raw = spark.createDataFrame([(i, f"blk_{i % 3} put by u{i}") for i in range(12)], "tiebreak bigint, line string")
    raw = raw.withColumn("ts", F.timestamp_seconds("tiebreak"))
    labels = spark.createDataFrame([(f"blk_{i}", 0) for i in range(3)], "session_id string, label int")
    known = templates.mine_templates(raw, max_values=5)
    log = tables.events_from_raw(raw, labels, r"blk_[0-9]+", rules=[], templates=known)
    assert {r["template"] for r in log.collect()} == {"<*> put by <*>"} or {r["template"] for r in log.collect()} == {r["template"] for r in known.collect()}
    assert log.count() == 12
