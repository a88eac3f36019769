"""Sinks of tables: CSV, JSON lines, Markdown, HTML, quad and logic files, SQLite."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def csv(df: DataFrame, path: str) -> None:
    """All fields quoted, no header."""
    df.write.option("header", False).option("quoteAll", True).option("emptyValue", "").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def records(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, json: the rows of each table as one list of records, non-ASCII kept."""
    rows = F.array_sort(F.collect_list(F.struct(c(order).alias("__o"), F.struct(*[x for x in df.columns if x not in keys]).alias("r"))))
    return df.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda x: x["r"])).alias("json"))


def _lines(df: DataFrame, keys: list[str], order: str, columns: list[str], cell, row):
    text = row(F.array(*[cell(F.coalesce(c(x).cast("string"), F.lit(""))) for x in columns]))
    rows = F.array_sort(F.collect_list(F.struct(c(order).alias("o"), text.alias("t"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["t"]).alias("rows"))


def markdown(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, markdown: each table with a head of its column names."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    t = _lines(df, keys, order, columns, lambda v: F.replace(v, F.lit("|"), F.lit("\\|")), lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |")))
    return t.select(*keys, F.concat(F.lit(head), F.array_join("rows", "\n")).alias("markdown"))


def html(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, html: each table."""
    t = _lines(df, keys, order, columns, lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>")), lambda a: F.concat(F.lit("<tr>"), F.array_join(a, ""), F.lit("</tr>")))
    return t.select(*keys, F.concat(F.lit("<table>"), F.array_join("rows", ""), F.lit("</table>")).alias("html"))


def quad_lines(df: DataFrame) -> DataFrame:
    """file, boxes, logic: the lines of the quad and logic files from file, pos, quad, axis; logic is truncated to integers."""
    q = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat_ws(",", F.get("quad", i * 2).cast("string"), F.get("quad", i * 2 + 1).cast("string"))), ";")
    a = F.array_join(F.transform("axis", lambda v: v.cast("int").cast("string")), ",")
    rows = F.array_sort(F.collect_list(F.struct("pos", q.alias("q"), a.alias("a"))))
    return df.groupBy("file").agg(F.array_join(F.transform(rows, lambda x: x["q"]), "\n").alias("boxes"), F.array_join(F.transform(rows, lambda x: x["a"]), "\n").alias("logic"))


def sqlite(df: DataFrame, path: str, table: str, chunk: int = 10_000) -> int:
    """Replace ``table`` of a SQLite file on the driver with the rows of ``df``, which stream in by partition."""
    names = ", ".join(f'"{x}"' for x in df.columns)
    with sqlite3.connect(path) as db:
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({names})')
        n, rows = 0, []
        for r in df.toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == chunk:
                db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', rows)
                n, rows = n + len(rows), []
        db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', rows)
    return n + len(rows)
