"""The chunks of the documents in DuckDB's SQL, each computed from the one before it."""

from __future__ import annotations

from gleaner.queries.ingest import DOCS


def _continues(p: str) -> str:
    """SQL: whether the byte at a place belongs to the character before it."""
    return f"hex(b[{p} + 1 : {p} + 1]) BETWEEN '80' AND 'BF'"


def _whole(at: str) -> str:
    return f"({at} - CASE WHEN {at} <= 0 OR {at} >= n OR NOT {_continues(at)} THEN 0 WHEN NOT {_continues(f'({at} - 1)')} THEN 1 WHEN NOT {_continues(f'({at} - 2)')} THEN 2 ELSE 3 END)"


def _snapped(at: str, low: str, high: str, rows: str) -> str:
    """SQL of rows with ``c``, the line start nearest to a place and within 64 bytes of it, or the place."""
    before = f"coalesce(r IS NULL OR {at} - l <= r - {at}, FALSE)"
    near = f"CASE WHEN {before} AND l > {low} AND l < {high} THEN l WHEN NOT {before} AND r > {low} AND r < {high} THEN r ELSE {at} END"
    sides = f"list_max(list_filter(br, lambda x: x <= {at} AND x > {at} - 64)) AS l, list_min(list_filter(br, lambda x: x > {at} AND x <= least(n, {at} + 64))) AS r"
    return f"SELECT * EXCLUDE (l, r), {near} AS c FROM (SELECT *, {sides} FROM ({rows}))"


def _chunks_sql(source: str = DOCS) -> str:
    """Recursive SQL of the chunks of ``(wal_entry_id, source_path, content)``, each from the one before it."""
    end = lambda rows: f"SELECT * EXCLUDE (c), CASE WHEN s + 512 >= n THEN n ELSE {_whole('c')} END AS e FROM ({_snapped('(s + 512)', 's', '(n + 1)', rows)})"
    again = _snapped("(e - 256)", "-1", "e", "SELECT id, ch.k, ch.s, ch.e, n, b, br FROM ch JOIN d USING (id) WHERE e < n")
    after = f"SELECT id, k + 1 AS k, CASE WHEN g > s THEN g ELSE e END AS s, n, b, br FROM (SELECT *, CASE WHEN e - 256 <= 0 THEN 0 ELSE {_whole('c')} END AS g FROM ({again}))"
    return f"""d AS MATERIALIZED (SELECT wal_entry_id AS id, source_path, encode(content) AS b, strlen(content) AS n, list_transform(range(1, len(ls)), lambda i: list_sum(ls[1:i])) AS br
  FROM (SELECT *, list_transform(string_split(content, chr(10)), lambda x: strlen(x) + 1) AS ls FROM {source})),
ch AS (SELECT id, k, s, e FROM ({end("SELECT id, 0 AS k, 0 AS s, n, b, br FROM d WHERE n > 0")}) UNION ALL SELECT id, k, s, e FROM ({end(after)})),
cx AS (SELECT id AS wal_entry_id, source_path, CAST(k AS INTEGER) AS chunk_id, CAST(s AS BIGINT) AS byte_start, CAST(e AS BIGINT) AS byte_end, CAST(1 + len(list_filter(br, lambda x: x <= s)) AS INTEGER) AS l1,
  CAST(1 + len(list_filter(br, lambda x: x <= e)) AS INTEGER) AS l2, decode(b[s + 1 : e]) AS text FROM ch JOIN d USING (id))"""
