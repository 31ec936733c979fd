"""What tests of the catalogue operators share."""

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows of a pandas frame as sorted text, columns by name."""
    df = df[sorted(df.columns)]
    text = lambda v: "null" if v is None or v != v or str(v) == "<NA>" else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))
