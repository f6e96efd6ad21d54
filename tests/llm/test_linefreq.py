import re

from lumenframe.llm import linefreq as L

from .util import duck, table

BOILER = "All rights reserved by the owner of this page 2024"
BODY = [" ".join(chr(97 + i) * 2 + chr(97 + k % 26) + "x" * (k // 26) for k in range(30)) for i in range(8)]
LOOP = "a b c d e f g h i j " * 6
ROWS = [
    (0, None, "h"),
    (1, "", "h"),
    (2, BODY[0] + "\n" + BOILER, "h"),
    (3, BODY[1] + "\n" + BOILER.replace("2024", "1999").upper() + "\n" + BODY[1], "h"),
    (4, BODY[2] + "\n  " + BOILER.replace(" ", "\t"), "h"),
    (5, BODY[3] + "\n" + BOILER, None),
    (6, (BOILER + "\n") * 4, "h"),
    (6, (BOILER + "\n") * 4, "h"),
    (7, (BOILER + "\n") * 4, "h"),
    (8, LOOP, "g"),
    (9, "# $ % *\n" + BODY[4] + " & | < >\n\n \n" + BODY[4], "g"),
    (10, BODY[5] + "é ß " * 30, "g"),
    (11, BODY[0] + "\n" + BOILER + " longer", "h"),
    (12, "one two three four five six seven eight nine " * 3 + BODY[6], "g"),
    (13, "x " * 50_000, "g"),
    (14, BOILER + "\n" + BODY[7].split(" ", 1)[0] + " tail\n" + BOILER.lower(), "h"),
]
SCHEMA = "doc_id long, text string, source string, kept string, __line string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA)


def judged(rows):
    """Every row as a list whose nulls sort."""
    return sorted((tuple(r) for r in rows), key=repr)


def test_matches_sql_at_small_limits(spark):
    docs = frame(spark, [*ROWS, (None, BODY[0] + "\n" + BOILER, "h"), (None, "", None)])
    for limit, share, words in ((2, 0.6, 5), (4, 0.6, 5), (1, 0.9, 40), (100, 0.3, 5)):
        got = judged(L.quality(docs, line_limit=limit, min_left_share=share, min_left_words=words).collect())
        assert got == judged(duck(L.oracle(limit, share, words), documents=table(docs)))


def norm(line):
    return " ".join(re.sub("[0-9]", "0", line.lower()).split())


def test_documents_against_brute_force(spark):
    docs = frame(spark, ROWS)
    holders = {}
    for i, text, host in ROWS:
        for line in (text or "").split("\n"):
            holders.setdefault((host, norm(line)), set()).add(i)
    for limit in (2, 5, 6):
        want = sorted((i, sum(len(x.split()) for x in (t or "").split("\n") if len(holders[h, norm(x)]) > limit and norm(x))) for i, t, h in ROWS)
        assert sorted((r.doc_id, r.removed_words) for r in L.quality(docs, line_limit=limit).collect()) == want
    assert any(n for _, n in want) is False  # six documents of the host hold the line, so none is above six
    copies = frame(spark, [(k, BODY[0], "h") for k in range(5)])
    assert not any(r.kept for r in L.quality(copies, line_limit=4).collect())
    assert all(r.kept for r in L.quality(copies, line_limit=5).collect())
    assert all(r.kept for r in L.quality(copies, line_limit=4, count_copies=False).collect())


def test_repeated_rows_and_filter(spark):
    docs = frame(spark, ROWS)
    rows = L.quality(docs, line_limit=2, count_copies=False).collect()
    assert len(rows) == len(ROWS)
    removed = {r.doc_id: r.removed_words for r in rows}
    assert removed[2] == 0 and removed[3] == 10 and removed[6] == 40  # the smallest id keeps the line
    for copies in (False, True):
        rows = L.quality(docs, line_limit=2, count_copies=copies).collect()
        twice = [tuple(r) for r in rows if r.doc_id == 6]
        assert len(twice) == 2 and twice[0] == twice[1]
        out = L.quality_filtered(docs, line_limit=2, count_copies=copies)
        assert out.columns == docs.columns
        texts = {r.doc_id: r.text for r in out.collect()}
        assert sorted(texts) == sorted(r.doc_id for r in rows if r.kept)
        assert texts[2] == (BODY[0] if copies else ROWS[2][1]) and texts[4] == BODY[2]


def test_filter_looks_lines_up_where_texts_are(spark, monkeypatch):
    many = [(20 + k, f"{BODY[k % 8]} {k}\n" + "\n".join(f"{w} line of many" for w in BODY[k % 3].split()[:9]) + f"\n\n {BOILER}\n{BOILER}", "h" if k % 2 else None) for k in range(30)]
    docs = frame(spark, [*ROWS, *many, (None, BODY[0] + "\n" + BOILER, "h")])
    for copies in (False, True):
        out = L.quality_filtered(docs, line_limit=2, count_copies=copies)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "from_json" not in plan  # the lines are a constant, read once
        found = judged(out.collect())
        with monkeypatch.context() as m:
            m.setattr(L, "LOOKUP_LINES", 0)
            joined = L.quality_filtered(docs, line_limit=2, count_copies=copies)
            assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
            assert found == judged(joined.collect())
        rows = L.quality(docs, line_limit=2, count_copies=copies).filter("kept").collect()
        text = {(i, t) for i, t, _ in [*ROWS, *many]}
        cut = {r.doc_id: r.removed_words for r in rows if r.doc_id is not None}
        assert sorted(r[0] for r in found if r[0] is not None) == sorted(r.doc_id for r in rows if r.doc_id is not None)
        assert all(len(t.split()) - cut[i] == len(r[1].split()) for r in found for i, t in text if i == r[0])


def test_empty_table(spark):
    assert L.quality(frame(spark, ROWS).limit(0)).collect() == []
