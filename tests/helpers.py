"""What tests share."""

import pandas as pd

SF = "/root/testdata/sf0.001"


def same_rows(spark_df, duck_df) -> None:
    """Rows equal in any order, columns by name, null equal to null."""
    left = spark_df.toPandas()
    cols = sorted(duck_df.columns)
    assert sorted(left.columns) == cols

    def norm(frame):
        out = []
        for row in frame[cols].itertuples(index=False):
            out.append(tuple("null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in row))
        return sorted(out)

    a, b = norm(left), norm(duck_df)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
