"""The registered queries at the smallest driver tables: columns, row counts, and SQL where there is some."""

import os

import duckdb
import pytest

from lumenframe.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")

FIRST_COLUMNS = {
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["page_id", "host", "path", "rule", "verdict"],
    "op4": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8": ["page_id", "url", "text", "n_chars"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["query_id", "rank", "vec_id", "score"],
    "op12": ["item_id", "rank", "doc_id", "score"],
    "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op10": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_registered(spark, name):
    df = Q.queries()[name](spark, SF)
    n = df.count()
    op = name.split("_")[0]
    assert set(FIRST_COLUMNS.get(op, [])) <= set(df.columns)
    pages, docs, vectors, items = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("pages", "documents", "embeddings", "benchmark"))
    if op in ("op3", "op8"):
        assert n == pages
    elif op in ("op11", "op12", "op13"):
        assert n == {"op11": 20 * -(-vectors // 20), "op12": 20 * items, "op13": vectors}[op]
    elif op not in ("op1", "op10"):
        assert n == docs
    else:
        assert n >= docs if op == "op10" else n > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    df = Q.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.sql(Q.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert sorted(r.fetchall()) == sorted(tuple(x[c] for c in r.columns) for x in df.collect())


WORD = r"[^\x20\x09-\x0D]+"
#: What the contracts of operators without an SQL form for all columns fix, as SQL.
FIXED = {
    "op2_source_mix": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r0 AS (SELECT *, false AS full0 FROM s),
r1 AS (SELECT *, full0 OR (SELECT sum(n) FROM r0) * w / (SELECT sum(w) FROM r0) > 3 * n AS full1 FROM r0),
r2 AS (SELECT *, full1 OR ((SELECT sum(n) FROM s) - (SELECT coalesce(sum(3 * n), 0) FROM r1 WHERE full1)) * w / (SELECT sum(w) FROM r1 WHERE NOT full1) > 3 * n AS full2 FROM r1),
r3 AS (SELECT *, full2 OR ((SELECT sum(n) FROM s) - (SELECT coalesce(sum(3 * n), 0) FROM r2 WHERE full2)) * w / (SELECT sum(w) FROM r2 WHERE NOT full2) > 3 * n AS full3 FROM r2),
t AS (SELECT source, n, CASE WHEN full3 THEN 3 * n ELSE ((SELECT sum(n) FROM s) - (SELECT coalesce(sum(3 * n), 0) FROM r3 WHERE full3)) * w / (SELECT sum(w) FROM r3 WHERE NOT full3) END::DOUBLE AS target FROM r3)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "op3_url_templates": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
rules(host, path) AS (VALUES ('com', '/en/'), ('example.com', '/en/7'), ('net', '/de/'), ('example.net', '/de/8'), ('org', '/es/')),
fit AS (SELECT page_id, arg_max(r.host || r.path, len(r.host || r.path)) AS rule FROM h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, fit.rule FROM h LEFT JOIN fit USING (page_id)""",
    "op7_secret_scan": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex FROM documents""",
}


@pytest.mark.parametrize("name", sorted(FIXED))
def test_fixed_columns(spark, name):
    """Columns that a contract fixes, on tables of 1,000 documents and 250 pages."""
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(FIXED[name])
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in r.columns) for x in Q.queries()[name](spark, sf).collect()), key=repr) == want
