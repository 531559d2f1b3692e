"""Comparing Spark rows with those of SQL."""

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def oracle_rows(sf_dir: str, statement: str):
    import duckdb

    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.sql(statement)
    return found.columns, found.fetchall()


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns by name; numbers to six places."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def show(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        try:
            return f"{float(v):.6f}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return [columns[k] for k in order], sorted(tuple(show(r[k]) for k in order) for r in rows)
