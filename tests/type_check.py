"""Compare Spark result types with DuckDB oracle result types (sf0.001)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT", "smallint": "SMALLINT"}


def main():
    from oracle_check import duck
    from tillsight.session import build_session
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    spark = build_session("local[4]", shuffle_partitions=4)
    con = duck(sf)
    q, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(sql):
        st = dict(q[name](spark, sf).dtypes)
        rel = con.sql(sql[name])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = [(c, st[c], dt.get(c)) for c in st if SPARK_TO_DUCK.get(st[c], st[c]) != dt.get(c)]
        if diffs:
            bad += 1
            print(f"{name:32s} {diffs}")
    print("type mismatches:", bad)


if __name__ == "__main__":
    main()
