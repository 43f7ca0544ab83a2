import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
