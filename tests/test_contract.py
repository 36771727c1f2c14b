"""Driver-contract guards (no Spark needed)."""

import re


def test_every_query_has_an_oracle_and_a_plain_name():
    import __spark_entry__ as E

    own = {k for k in E.queries() if k != "pipeline" and not re.match(r"op\d+_", k)}
    ors = E.oracle_sql()
    assert own <= set(ors) <= set(E.queries())
    for name in own:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
        assert ors[name].strip(), name


def test_scale_conf_sizes_partitions_from_input():
    from tessera.session import scale_conf

    small = scale_conf(1 << 30)
    big = scale_conf(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
