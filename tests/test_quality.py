import pytest
from pyspark.sql import functions as F
from support import SMALL, rows

from lapsewise import sources
from lapsewise.operators import quality
from lapsewise.session import work_path


def test_conform_flags_what_does_not_cast(spark):
    raw = spark.createDataFrame(
        [("1", "2.50", "x"), ("x", "3", None), (None, "1e9", "y")], "a string, b string, c string"
    )
    mapping = {
        "id": sources.Target("a", "bigint"),
        "amount": sources.Target("b", "decimal(5,2)"),
        "name": sources.Target("c", "string"),
    }
    got = [(i, None if a is None else float(a), n, bad) for i, a, n, bad in rows(sources.conform(raw, mapping))]
    assert sorted(got, key=repr) == sorted(
        [(1, 2.5, "x", ""), (None, 3.0, None, "id"), (None, None, "y", "amount")], key=repr
    )


def test_text_sources_keep_corrupt_rows(spark):
    folder = work_path(spark, "bad")
    spark.createDataFrame([("r_regionkey,r_name",), ("1,A",), ("x,B",)], "v string").coalesce(1).write.text(
        f"{folder}/region.csv"
    )
    got = sources.load(spark, folder, "region", "csv").cache()
    assert rows(got.where(f"{sources.CORRUPT} is null"), "r_regionkey", "r_name") == [(1, "A")]
    assert rows(got.where(f"{sources.CORRUPT} is not null"), sources.CORRUPT) == [("x,B",)]
    spark.createDataFrame([('{"r_regionkey": 1, "r_name": "A"}',), ("{broken",)], "v string").write.text(
        f"{folder}/region.json"
    )
    got = sources.load(spark, folder, "region", "json").cache()
    assert rows(got.where(f"{sources.CORRUPT} is null"), "r_regionkey", "r_name") == [(1, "A")]
    assert got.where(f"{sources.CORRUPT} is not null").count() == 1
    with pytest.raises(ValueError):
        sources.load(spark, folder, "region", "xls")


def test_rules_and_keys(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (3, 200)], "id bigint, v int")
    rules = {"positive": "v > 0", "small": "v < 100"}
    broken = quality.validate(df, "t", "id", rules)
    assert rows(broken) == [("t", "positive", "2"), ("t", "positive", "3"), ("t", "small", "3"), ("t", "small", "3")]
    assert rows(quality.violation_counts(broken)) == [("t", "positive", 2), ("t", "small", 2)]
    assert rows(quality.key_check(df, ["id"])) == [(3, 2)]


def test_null_key_is_no_violation_but_quarantined(spark):
    orders = spark.createDataFrame([(None, 1), (7, 2), (8, 3)], "customer_id bigint, order_id bigint")
    people = spark.createDataFrame([(7,)], "customer_id bigint")
    assert rows(quality.fk_check(orders, "customer_id", people, "customer_id")) == [(8, 1)]
    assert rows(quality.handle_missing(orders, people, "quarantine"), "order_id") == [(1,), (3,)]
    with pytest.raises(ValueError):
        quality.handle_missing(orders, people, "guess")


def test_save_replaces_only_the_partitions_given(spark):
    path = work_path(spark, "parts")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    sources.save(df, path, ("p",))
    sources.save(spark.createDataFrame([("b", 3)], "p string, v int"), path, ("p",))
    assert rows(spark.read.parquet(path), "p", "v") == [("a", 1), ("b", 3)]


def test_purchases_are_exact_cents(spark):
    raw = sources.load(spark, SMALL, "orders")
    got = sources.purchases(spark, SMALL)
    want = raw.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).first()[0]
    assert int(want) == got.agg(F.sum("cents")).first()[0]


def test_values_that_do_not_fit_are_set_aside(spark):
    folder = work_path(spark, "misfits")
    df = sources.load(spark, SMALL, "orders").limit(20)
    big = F.when(F.col("o_orderkey") == df.first()["o_orderkey"], F.lit(1e30)).otherwise(F.col("o_totalprice"))
    df.withColumn("o_totalprice", big).write.parquet(f"{folder}/orders.parquet")
    kept = sources.purchases(spark, folder)
    assert kept.count() == 20 and kept.where("cents is null").count() == 1  # the amount is lost, not the order
    flagged = sources.taken_over(spark, folder, "orders", flags=True).where("bad_fields <> ''")
    assert rows(flagged, "bad_fields") == [("cents",)]
    bad = sources.set_aside(spark, folder, "orders").collect()
    assert [(r["table"], r["bad_fields"]) for r in bad] == [("orders", "cents")] and "1.0E30" in bad[0]["row"]


def test_only_a_key_that_does_not_fit_costs_the_row(spark, monkeypatch):
    folder = work_path(spark, "misfits")
    df = sources.load(spark, SMALL, "customer").limit(5)
    first = df.first()["c_custkey"]
    df.withColumn("c_acctbal", F.when(F.col("c_custkey") == first, F.lit(1e30)).otherwise(F.col("c_acctbal"))).write.parquet(
        f"{folder}/customer.parquet"
    )
    assert rows(sources.customers(spark, folder).where("balance is null"), "customer_id") == [(first,)]
    broken = {**sources.CUSTOMER, "customer_id": sources.Target(f"if(c_custkey = {first}, 'x', cast(c_custkey as string))", "bigint")}
    monkeypatch.setitem(sources.MAPPINGS, "customer", broken)
    assert sources.customers(spark, folder).count() == 4
    assert sources.set_aside(spark, folder, "customer").count() == 1


def test_unreadable_rows_are_kept_with_a_mark(spark):
    folder = work_path(spark, "broken")
    spark.createDataFrame([('{"p_partkey": 1, "p_size": 3}',), ('{"p_partkey": ',)], "value string").write.text(f"{folder}/part.json")
    got = sources.load(spark, folder, "part", "json")
    assert rows(got, "p_partkey", F.col(sources.CORRUPT).isNotNull()) == [(1, False), (None, True)]


def test_rules_on_paths_of_documents(spark):
    docs = spark.createDataFrame(
        [
            (1, '{"a": {"b": [1, 5]}, "t": "x"}'), (2, '{"a": {"b": [1, "five"]}}'), (3, '{"a": '), (4, None), (5, '{"a": null, "t": null}'),
            (6, '[1]'), (7, '{"a": {"b": [1, 50]}, "t": "q"}'), (None, '{}'), (8, ''),
        ],
        "id bigint, doc string",
    ).withColumn("_key", F.lit(0)).withColumn("value", F.lit(5))
    rules = {
        "small": quality.PathRule("$.a.b[1]", "int", "value < 10"),
        "tag": quality.PathRule("$.t", "string", "value = 'x'", required=False),
    }
    got = quality.validate_json(docs, "docs", "id", "doc", rules)
    assert rows(got, "rule", "key") == sorted(
        [("small", k) for k in ("2", "4", "5", "6", "7", None)] + [("tag", "7"), ("not_json", "3"), ("not_json", "8")], key=repr
    )
    assert not rows(quality.validate_json(docs.limit(0), "docs", "id", "doc", rules))
