"""A register of queries: each with its Spark form and, where SQL can say the same, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB's form of functions.text.fold() for letters that decompose to one base letter.
def sql_fold(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[''’`´\-_/(),.]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_unescape(x: str) -> str:
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{character}')"
    return x


def sql_clean(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\n\\s*\\n+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_strip(x: str) -> str:
    return f"trim({sql_unescape(f'regexp_replace({x}, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ' || chr(9) || chr(10) || chr(13))"
