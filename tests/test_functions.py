import math

import pytest
from pyspark.sql import functions as F

from vigilseq.functions import numeric as num
from vigilseq.functions import text as txt


def values(spark, column, inputs, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


LONG = "nova.compute: " + "x" * 200


@pytest.mark.parametrize(
    "raw, label",
    [
        (None, "Desconhecido"),
        ('  "Failure while booting', "Failure!!!"),
        ("boot failed Traceback (most recent call last): File", "boot failed"),
        ("None File x Traceback (most recent call last): y", "None File x"),
        ("a None None b None File c", "a None None b"),
        ("first\nsecond", "first"),
        ("  padded  ", "padded"),
        (LONG, LONG[: 12 + 60] + "..."),
        ("y" * 130, "y" * 120 + "..."),
        (":" + "z" * 130, (":" + "z" * 130)[:120] + "..."),
        ("w" * 110 + ":" + "w" * 30, "w" * 110 + ":" + "w" * 9 + "..."),
        ("short\n" + "t" * 130, "short..."),
        ("", ""),
    ],
)
def test_short_label_os(spark, raw, label):
    assert values(spark, txt.short_label_os, [raw], "string") == [label]


def test_short_label_hdfs(spark):
    found = values(spark, txt.short_label_hdfs, [None, " ab ", "x" * 100, "x" * 101], "string")
    assert found == ["Desconhecido", "ab", "x" * 100, "x" * 100 + "..."]


def test_bands_at_the_cut_edges(spark):
    edges = [-1.0, 0.0, 0.5, 1.0, 10.0, 60.0, 480.0, 481.0, 1440.0, 1441.0, None]
    names = num.OPENSTACK_BANDS
    wanted = [names[i] for i in (6, 5, 4, 4, 3, 2, 1, 1, 1, 0)] + [None]
    assert values(spark, num.band, edges, "double") == wanted
    hdfs = values(spark, lambda c: num.band(c, num.HDFS_CUTS, num.HDFS_BANDS), edges, "double")
    assert hdfs[6:8] == [num.HDFS_BANDS[1], num.HDFS_BANDS[0]]


def test_bins(spark):
    found = values(spark, lambda c: num.bucketize(c, num.LEAD_EDGES), [-0.1, 0.0, 1.0, 59.9, 600.0, 1e9, None], "double")
    assert found == [None, "0-1", "1-5", "30-60", "600+", "600+", None]


def test_strict_edges(spark):
    assert values(spark, lambda c: num.edges_below(c, [1, 2, 3], strict=True), [1.0, 1.5, 3.0, 4.0], "double") == [0, 1, 2, 3]


def test_duration_text(spark):
    found = values(spark, num.duration_text, [None, 0.5, -0.5, 59.94, 90.0, 1440.0, 1.44e6 * 1440], "double")
    assert found == ["—", "30.0 seg", "-30.0 seg", "59.9 min", "1.5 h", "1.0 dias", "1440000.0 dias"]


def test_perplexity(spark):
    found = values(spark, num.perplexity, [0.0, 1.0, 20.0, None], "double")
    assert found[:2] == [1.0, pytest.approx(math.e)] and found[2] == math.inf and found[3] is None


def test_mask_and_id(spark):
    line = "Receiving block blk_-160899 src: /10.250.19.102:54106 size 67108864 id 0x1f"
    [masked] = values(spark, txt.mask_template, [line], "string")
    assert masked == "Receiving block <*> src: /<*> size <*> id <*>"
    [uuid] = values(spark, txt.mask_template, ["req 3f2504e0-4f89-41d3-9a0c-0305e82c3301 at /var/log/nova"], "string")
    assert uuid == "req <*> at <*>"


def test_categories_take_the_first_rule(spark):
    texts = ["SocketTimeoutException in writeBlock", "java.io.EOFException", "BlockMap updated", "some error", "fine", None]
    found = values(spark, lambda c: txt.categorize(c, txt.HDFS_RULES), texts, "string")
    assert found == ["SocketTimeoutException", "EOFException", "NameSystem/BlockMap", "Other Exception", "Other", "Other"]


def test_description_and_hash(spark):
    text = "a" * 49 + "é" + "b"
    assert values(spark, txt.short_desc, [text], "string") == ["a" * 49 + "é..."]
    one, two = values(spark, txt.pattern_hash, [text, text + "c"], "string")
    assert one == two and len(one) == 8
