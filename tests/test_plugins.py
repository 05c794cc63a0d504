"""What the caller brings along: lookups, clients, kinds of documents."""

import pytest

from quotary.operators import plugins


def test_each_address_is_looked_up_once(spark):
    views = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), ("b", 3, None), (None, 4, None)], "ip string, n int, city string")

    def lookup(addresses):
        assert len(addresses) == len(set(addresses)) and None not in addresses
        return [{"city": a.upper(), "country": "z", "hosting": True} if a == "a" else None for a in addresses]

    want = {(1, "A", True), (2, "A", True), (3, None, None), (4, None, None)}
    assert {(r["n"], r["city"], r["hosting"]) for r in plugins.placed(views, "ip", lookup).collect()} == want
    table = spark.createDataFrame([("a", "A", "z", True), ("a", "A", "z", True), ("c", "C", "z", False)], "ip string, city string, country string, hosting boolean")
    assert {(r["n"], r["city"], r["hosting"]) for r in plugins.placed(views, "ip", table).collect()} == want


def test_a_client_that_fails_is_said_to(spark):
    def client():
        def call(text):
            if text == "bad":
                raise RuntimeError("refused")
            return text[::-1], 0.5

        return call

    got = plugins.answered(spark.createDataFrame([("abc",), ("abc",), ("bad",), (None,)], "t string"), "t", "m", client).collect()
    assert sorted((r["state"], r["answer"], r["cost"]) for r in got) == [("done", "cba", 0.5), ("failed", None, 0.0)]


def test_kinds_that_are_not_registered_are_the_default(spark):
    kinds = spark.createDataFrame([("weekly", "a weekly talk", True), ("feast", "a feast's talk", False)], "kind string, framing string, two_parts boolean")
    docs = spark.createDataFrame([(1, "feast"), (2, "other"), (3, None)], "id int, kind string")
    assert {(r["id"], r["framing"], r["two_parts"]) for r in plugins.with_kind(docs, kinds, "kind", "weekly").collect()} == {(1, "a feast's talk", False), (2, "a weekly talk", True), (3, "a weekly talk", True)}
    with pytest.raises(ValueError):
        plugins.with_kind(docs, kinds, "kind", "none")
