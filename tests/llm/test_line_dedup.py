from oracle import rows_of, sql_rows

from tidemark.llm.line_dedup import ORACLES, dedup_lines, op6_line_dedup


def brute(rows, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = [
        (1, "Shared line here\nown one\n"), (2, " \tshared LINE here\r\nÉTÉ shared too"), (3, "été shared too\nshared line here"), (3, "shared line here"),
        (4, None), (5, ""), (None, "Shared line here"), (6, "\n\nShared line here\x0b\nShared line here"), (7, "ÉTÉ shared too"), (8, "x" * 5000 + "\nShared line here"),
    ]
    for min_docs in (1, 2, 3, 5, 9):
        docs = spark.createDataFrame([(*r, "a", 7, "i", "d") for r in rows], "doc_id long, text string, h1 string, n_lines long, __id string, __dropped string")
        got = dedup_lines(docs, min_chars=10, min_docs=min_docs)
        assert {"h1", "n_lines", "__id", "__dropped"} <= set(got.columns) and {(r["__id"], r["__dropped"]) for r in got.collect()} == {("i", "d")}
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows, 10, min_docs)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = op6_line_dedup(spark, d)
    assert rows_of(got) == sql_rows(ORACLES["op6_line_dedup"], d)
    assert got.where("n_dropped > 0").count() > 0
