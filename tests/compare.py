from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def same(a, b):
    """Equal rows in any order, by column name; the first differences otherwise."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for col in cols:
        equal = (a[col] == b[col]) | (a[col].isna() & b[col].isna())
        assert equal.all(), (col, a[~equal].head(3).to_dict(), b[~equal].head(3).to_dict())
