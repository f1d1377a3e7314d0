"""Compare a Spark result with its checking SQL: columns, row count and values."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(spark_df, con, sql):
    """Empty string when both agree, else a short description."""
    got, want = spark_df.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    cols = sorted(got.columns)

    def keyed(pdf):
        rows = pdf[cols].astype(object).where(pdf[cols].notna(), None)
        return sorted((tuple(map(str, r)) for r in rows.itertuples(index=False)))

    for a, b in zip(keyed(got), keyed(want)):
        if a != b:
            return f"first difference:\n  {a}\n  {b}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in cols}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "object" not in k and "str" not in k}
    return f"types {odd}" if odd else ""
