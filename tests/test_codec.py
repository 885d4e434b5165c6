import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.errors import ProtocolError
from tidelog.functions.codec import canonical_json, canonical_text, decode, encode_ack, encode_delivery, encode_message, parse_strict, record_size
from tidelog.functions.validity import missing_keys, suback_granted, valid_id, valid_topic

GOOD = '{"event_id":"msg_7f","payload":{"b":"kPa","y":[0,false,null]},"topic":"site/press/4","version":1}'
BAD = {
    "{oops}": "not_json", "oops": "not_json", "[]": "not_object", '{"version":1}': "missing_key",
    '{"version":1,"event_id":"a","event_id":"b","topic":"t","payload":1}': "duplicate_key",
    GOOD.replace('"version":1', '"version":1,"ok":true'): "extra_key",
    GOOD.replace("msg_7f", "no good"): "id", GOOD.replace("msg_7f", "x" * 129): "id", GOOD.replace('"msg_7f"', "null"): "id", GOOD.replace("msg_7f", "a\\n"): "id",
    GOOD.replace('"version":1', '"version":2'): "version", GOOD.replace('"version":1', '"version":true'): "version",
    GOOD.replace('"version":1', '"version":1.0'): "version", GOOD.replace('"version":1', '"version":"1"'): "version",
    GOOD.replace("site/press/4", ""): "topic", GOOD.replace("site/press/4", "site/+/x"): "topic", GOOD.replace("site/press/4", "site/#"): "topic",
    GOOD.replace("site/press/4", "a\\u0000b"): "topic", GOOD.replace("[0,false,null]", "NaN"): "not_finite", GOOD.replace("[0,false,null]", "1e400"): "not_finite",
    GOOD.replace("[0,false,null]", "Infinity"): "not_finite", GOOD.replace("[0,false,null]", '"\\ud800"'): "payload", GOOD + " x": "not_json",
}
SAME = [
    GOOD, GOOD.replace(",", ", "), GOOD.replace('"y"', '"ü"'), '{"version":1,"topic":"t","payload":null,"event_id":"a"}',
    '{"event_id":"a","payload":{"topic":"x","version":1},"topic":"t","version":1}', '{"event_id":"a","payload":"\\"q\\\\\\u001f","topic":"t","version":1}',
    '{"event_id":"a","payload":123456789012345678901234567890,"topic":"t","version":1}', '{"event_id":"a","payload":[1.0,-0.0,1e16,1.5E-7],"topic":"t","version":1}',
    '{"event_id":"a","payload":{"ﬁ":1,"\U0001f600":2},"topic":"t","version":1}', '{"event_id":"a","payload":"it\'s","topic":"it\'s","version":1}',
]


def decoded(spark, texts, kind="message"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["d"] for r in rows.select("i", decode(F.col("t"), kind).alias("d")).orderBy("i").collect()]


def test_every_bad_text_has_its_class(spark):
    got = decoded(spark, list(BAD) + [None])
    assert [d["error"] for d in got] == [*BAD.values(), "null"]
    assert not any(d["ok"] or d["message_id"] for d in got)


def test_good_texts_decode_to_canonical_payloads(spark):
    for text, d in zip(SAME, decoded(spark, SAME)):
        value = json.loads(text)
        assert d["ok"] and d["message_id"] == value["event_id"] and d["topic"] == value["topic"]
        assert d["payload_json"] == json.dumps(value["payload"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_deliveries_and_acks(spark):
    assert decoded(spark, ['{"event_id":"twin","payload":[7,8],"version":1}'], "delivery")[0]["payload_json"] == "[7,8]"
    got = decoded(spark, ['{"event_id":"done-1","version":1}', '{"version": 1, "event_id": "done-1"}', '{"version":1,"event_id":"done-1","ok":true}', '{"version":1,"event_id":"no good"}', '{"version":1}'], "ack")
    assert [d["error"] for d in got] == [None, None, "extra_key", "id", "missing_key"] and got[1]["message_id"] == "done-1"


def test_bytes_that_are_not_utf8(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff"),), (bytearray(GOOD.encode()),)], "t binary")
    got = [r["d"]["error"] for r in rows.select(decode(F.col("t")).alias("d")).collect()]
    assert got == ["not_utf8", None]


def test_encoding_round_trips(spark):
    row = spark.range(1).select(
        encode_message(F.lit("msg_7f"), F.lit("site/press/4"), canonical_json(F.lit('{"y":[0,false,null], "b":"kPa"}'))).alias("m"),
        encode_delivery(F.lit("twin"), F.lit("[7,8]")).alias("d"), encode_ack(F.lit("done-1")).alias("a"),
    ).withColumn("n", record_size(F.col("m"))).first()
    assert row["m"] == GOOD and row["d"] == '{"event_id":"twin","payload":[7,8],"version":1}' and row["a"] == '{"event_id":"done-1","version":1}'
    assert row["n"] == len(GOOD) + 12


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**25), 10**25) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@given(st.lists(json_values, min_size=1, max_size=60))
@settings(max_examples=6, deadline=None)
def test_canonical_text_is_byte_exact(spark, values):
    def spaced(v):
        return json.dumps(v, ensure_ascii=False, separators=(" , ", " : "))

    good = [v for v in values if "\\ud" not in json.dumps(v) or json.dumps(v, ensure_ascii=False).isprintable()]
    texts = [spaced(v) for v in good]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(canonical_json(F.col("t"))).collect()]
    assert got == [canonical_text(v) for v in good]


def test_strict_parsing_of_canonical_json(spark):
    bad = ["NaN", "[1] x", "{'a':1}", '{"a":1,"a":2}', "01", "", "1e400", "[1,]"]
    rows = spark.createDataFrame([(t,) for t in bad], "t string")
    assert [r[0] for r in rows.select(canonical_json(F.col("t"))).collect()] == [None] * len(bad)
    with pytest.raises(ProtocolError):
        parse_strict("[" * 100_000)
    with pytest.raises(ProtocolError):
        canonical_text({"a": {1, 2}})


def test_one_and_one_point_zero_are_different_content():
    assert len({canonical_text(1), canonical_text(1.0), canonical_text(True)}) == 3


def test_validity(spark):
    ids = {"a": True, "A_-9": True, "x" * 128: True, "x" * 129: False, "": False, "a\n": False, "a b": False, None: False}
    topics = {"a/b": True, "": False, "a/+": False, "#": False, "a\0": False, "é" * 32767: True, "é" * 32768: False, None: False}
    for values, rule in ((ids, valid_id), (topics, valid_topic)):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        assert [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()] == list(values.values())
    codes = spark.createDataFrame([([0, 1],), ([128],), ([2, 135],), ([],), (None,), ([None],)], "c array<int>")
    assert [r[0] for r in codes.select(suback_granted(F.col("c"))).collect()] == [True, False, False, False, False, False]
    keys = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "h array<string>, w array<string>")
    assert keys.select(missing_keys(F.col("h"), F.col("w"))).first()[0] == "c,d"
