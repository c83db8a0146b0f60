import re

from lattica.llm.line_dedup import drop_repeated_lines

BLANK = " \t\n\x0b\x0c\r"


def brute(docs, least=2):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(BLANK))
    seen = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                seen.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(seen.get(key(x), ())) < least or min(seen[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    same, high = "The same line here.", "ÉTÉ ÉTÉ ÉTÉ"
    docs = [(1, f"{same}\n\n short\n{same}"), (2, f" the SAME line here.\x0b\nother words of 2"), (2, f"other words of 2\n{same}"), (2, f"other words of 2\n{same}"), (3, None), (4, ""), (5, same), (None, same), (6, f"{high}\nété été été"), (7, high), (8, "Été Été Été\r\n"), (9, "\n\n"), (10, ("x" * 200_000 + "\n") * 2), (11, "x" * 200_000 + "\n" + same)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'a' AS h1", "2 AS at", "3 AS copy", "'k' AS key")
    for least in (2, 3):
        got = drop_repeated_lines(df, min_docs=least)
        assert sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == brute(docs, least)
    assert drop_repeated_lines(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_long_texts_take_linear_time(spark):
    """Kept lines are picked from one split of the text: 200,000 lines would take an hour if each were a split of its own."""
    shared = [f"shared line number {i}" for i in range(0, 200_000, 2)]
    long = "\n".join(f"{'shared' if i % 2 == 0 else 'own'} line number {i}" for i in range(200_000))
    docs = [(1, "\n".join(shared)), (2, long)]
    got = {r.row.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[2].n_lines, got[2].n_dropped) == (200_000, 100_000) and got[1].n_dropped == 0
    assert got[2].kept == "\n".join(f"own line number {i}" for i in range(1, 200_000, 2))
