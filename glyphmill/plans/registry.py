"""Register of named queries: a function of a session and a folder, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Unicode white space for the SQL's expressions; its own trim() takes other characters.
SPACE = r"[\t-\r \x85\p{Z}]+"


def whole_trim(sql: str) -> str:
    """``sql`` with every trim(x) taking all Unicode white space."""
    at = 0
    while (start := sql.find("trim(", at)) >= 0:
        depth, end = 1, start + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = whole_trim(sql[start + 5 : end - 1])
        made = f"regexp_replace({inner}, '^{SPACE}|{SPACE}$', '', 'g')"
        sql = sql[:start] + made + sql[end:]
        at = start + len(made)
    return sql


Query = Callable[[SparkSession, str], DataFrame]


class Register:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = whole_trim(sql)
            return query

        return add
