import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tripledger.operators import conform as cf
from tripledger.sources import contracts


def raw():
    return contracts.raw_schema()


def test_contract_has_21_nullable_columns():
    assert len(raw().fields) == 21
    assert all(f.nullable for f in raw().fields)
    assert raw().names[0] == "VendorID" and raw().names[-2:] == ["date_reference", "insertion_date"]


def test_diff_is_case_sensitive(spark):
    df = spark.createDataFrame([(1, 2)], ["vendorid", "unknown_column"])
    diff = cf.schema_diff(df, raw())
    assert "VendorID" in diff.missing and "airport_fee" in diff.missing
    assert diff.extra == {"vendorid", "unknown_column"}


def test_names_are_matched_regardless_of_case(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], ["vendorid", "Airport_Fee", "other"])
    assert cf.normalize_names(df, raw()).columns == ["VendorID", "airport_fee", "other"]


def test_clashing_names_are_an_error(spark):
    df = spark.createDataFrame([(1, 2)], ["vendorid", "VendorID"])
    with pytest.raises(cf.SchemaError, match="vendorid"):
        cf.conform(df, raw())


def test_missing_columns_become_typed_nulls(spark):
    out = cf.add_missing(spark.createDataFrame([(1,)], "VendorID bigint"), raw())
    assert set(out.columns) == set(raw().names)
    assert dict(out.dtypes)["airport_fee"] == "double" and out.first()["airport_fee"] is None


def test_reorder_drops_what_is_not_declared(spark):
    schema = StructType([StructField("col1", StringType()), StructField("col2", LongType())])
    df = spark.createDataFrame([(1, "A", 0)], ["col2", "col1", "col3"])
    assert cf.reorder(df, schema).columns == ["col1", "col2"]


def test_bad_values_become_null_or_raise(spark):
    df = spark.createDataFrame([("7",), ("abc",), (None,)], "VendorID string")
    assert [r.VendorID for r in cf.cast_to(df, raw()).collect()] == [7, None, None]
    with pytest.raises(PySparkException):
        cf.cast_to(df, raw(), on_error="raise").collect()


def test_conform_is_one_projection_with_contract_order_and_types(spark):
    names = "total_amount float, unknown string, vendorid int, passenger_count long"
    df = spark.createDataFrame([(2.0, "x", 1, 3)], names)
    out = cf.conform(df, raw())
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in raw()]
    row = out.first()
    assert (row.VendorID, row.passenger_count, row.total_amount, row.airport_fee) == (1, 3.0, 2.0, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_extras_can_fail(spark):
    df = spark.createDataFrame([(1, 2)], ["VendorID", "unknown_column"])
    with pytest.raises(cf.SchemaError, match="unknown_column"):
        cf.conform(df, raw(), extras="fail")


def test_quoted_names(spark):
    df = spark.createDataFrame([(1, 2)], ["VendorID", "a.b`c"])
    assert cf.conform(df, raw()).first().VendorID == 1
    assert cf.normalize_names(df, raw()).columns == ["VendorID", "a.b`c"]
    assert {r.column_name: r.state for r in cf.schema_report(df, raw()).collect()}["a.b`c"] == "extra"


def test_empty_input_is_an_error(spark):
    empty = spark.createDataFrame([], "VendorID bigint")
    with pytest.raises(cf.EmptyInputError):
        cf.require_rows(empty)
    one = spark.createDataFrame([(1,)], "VendorID bigint")
    assert cf.require_rows(one) is one


def test_values_that_do_not_fit_can_be_flagged(spark):
    df = spark.createDataFrame([("7", "1.5"), ("abc", None), (None, "x")], "vendorid string, total_amount string")
    flags = {"VendorID": "bad_vendor", "total_amount": "bad_amount", "airport_fee": "bad_fee"}
    out = cf.conform(df, raw(), on_error="flag", flags=flags)
    assert out.columns == raw().names + list(flags.values())
    rows = [(r.VendorID, r.total_amount, r.bad_vendor, r.bad_amount, r.bad_fee) for r in out.collect()]
    assert rows == [(7, 1.5, 0, 0, 0), (None, None, 1, 0, 0), (None, None, 0, 1, 0)]
    with pytest.raises(ValueError, match="flags"):
        cf.conform(df, raw(), on_error="flag")
