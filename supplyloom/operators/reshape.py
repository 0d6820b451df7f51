"""Wide to long, long to wide, and column-level reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _unpivot(df, ids, measures, variable, value, as_text):
    if as_text:
        df = df.select(
            *[F.col(f"`{c}`") for c in ids],
            *[F.col(f"`{c}`").cast("string").alias(c) for c in measures],
        )
    return df.unpivot(
        [f"`{c}`" for c in ids], [f"`{c}`" for c in measures], variable, value
    )


def unpivot_years(
    df: DataFrame,
    n_ids: int,
    first_measure: int,
    years: Sequence[str] | None = None,
    variable: str = "year",
    value: str = "tonnes",
    as_text: bool = False,
) -> DataFrame:
    """Wide year columns to long rows, by position.

    The first ``n_ids`` columns identify the row, columns from ``first_measure``
    (0-based) are measures and anything between is dropped.  ``years`` limits the
    measures before the rows are multiplied, so unwanted columns are never read.
    """
    cols = df.columns
    measures = cols[first_measure:]
    if years is not None:
        wanted = {str(y) for y in years}
        measures = [c for c in measures if c in wanted]
    if not measures:
        raise ValueError("no measure column to unpivot")
    return _unpivot(df, cols[:n_ids], measures, variable, value, as_text)


def unpivot_rest(
    df: DataFrame, ids: Sequence[str], variable: str = "variable", value: str = "value"
) -> DataFrame:
    """Wide to long: every column not named as an id is a measure."""
    return _unpivot(df, list(ids), [c for c in df.columns if c not in ids], variable, value, False)


def unpivot_named(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    variable: str = "element",
    value: str = "tonnes",
) -> DataFrame:
    """Wide to long on the named measures only; missing measures give no row."""
    return _unpivot(df, list(ids), list(measures), variable, value, False).dropna(subset=[value])


def pivot_checked(
    df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], measure: str
) -> DataFrame:
    """Long to wide with one column per listed value.

    A second row for the same (ids, key) raises instead of being picked
    silently.  The value list is explicit, so no discovery job runs and all
    cells come from one aggregation with map-side partial results.
    """

    def cell(v: str) -> Column:
        hit = F.when(F.col(key) == v, F.col(measure))
        rows = F.count(F.when(F.col(key) == v, F.lit(1)))
        return (
            F.when(rows > 1, F.raise_error(F.lit(f"duplicate rows for {key}={v}")))
            .otherwise(F.max(hit))
            .alias(v)
        )

    return df.groupBy(*ids).agg(*[cell(v) for v in values])


def balance_pivot(
    df: DataFrame, ids: Sequence[str], elements: Sequence[str], key="element", measure="tonnes"
) -> DataFrame:
    """Balance elements (production, imports, exports) to columns."""
    return pivot_checked(df, ids, key, elements, measure)


def flow_pivot(
    df: DataFrame,
    ids: Sequence[str],
    flows: Sequence[str],
    dropped: str,
    zero_filled: str,
    key: str = "Trade_flow",
    measure: str = "tonnes",
) -> DataFrame:
    """Trade flows to columns without the dropped flow; one column is zero-filled."""
    wide = pivot_checked(df.filter(F.col(key) != dropped), ids, key, flows, measure)
    return wide.fillna(0, subset=[zero_filled])


def sector_pivot(
    df: DataFrame,
    sectors: Sequence[str],
    ids: Sequence[str] = ("iso3c", "nutrient"),
    key: str = "production_sector",
    measure: str = "nut_supply",
    residual: Sequence[str] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """Sector rows to columns, missing cells 0.

    ``residual`` columns stay part of the row key, which gives the sparse form
    with one row per sector when such a column varies by sector.  Rows whose
    ``required`` sectors are missing are dropped before the zero fill.
    """
    wide = pivot_checked(df, [*ids, *residual], key, sectors, measure)
    if required:
        wide = wide.dropna(subset=list(required))
    return wide.fillna(0, subset=[*residual, *sectors])


def token_split(
    df: DataFrame, col: str, names: Sequence[str], pattern: str,
    strip: Mapping[str, str] | None = None,
) -> DataFrame:
    """Split text into named columns: missing tokens null, surplus tokens dropped.

    ``strip`` removes a character from the tokens it names.
    """
    parts = F.split(F.col(col), pattern)
    tokens = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    for name, char in (strip or {}).items():
        tokens[name] = F.replace(tokens[name], F.lit(char), F.lit(""))
    return df.withColumns(tokens)


def column_range(
    df: DataFrame,
    first: str,
    last: str,
    lead: Sequence[str] = (),
    drop: Sequence[str] = (),
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """``lead`` columns, then the span first..last, minus ``drop``, renamed."""
    cols = df.columns
    span = cols[cols.index(first) : cols.index(last) + 1]
    kept = [c for c in [*lead, *[c for c in span if c not in lead]] if c not in drop]
    names = rename or {}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in kept])


def param_column(df: DataFrame, column: str, ids: Sequence[str], name: str = "pop") -> DataFrame:
    """Project the column chosen by the caller under a fixed name."""
    return df.select(*ids, F.col(column).alias(name))
