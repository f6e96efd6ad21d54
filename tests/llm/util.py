import duckdb
import pyarrow as pa


def duck(sql: str, **tables: pa.Table) -> list[tuple]:
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.sql(sql).fetchall()


def table(df) -> pa.Table:
    return df.toArrow()
