from vocalith.llm import linededup

from .tables import documents, empty, frame


def plain(rows):
    """(doc_id, text) -> cleaned text, by one pass over all windows in order."""
    first, gone = {}, {}
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if first.setdefault(w, (d, i)) != (d, i):
                gone.setdefault((d, t), set()).update((i, i + 1, i + 2))
    return {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())) for d, t in order}


def test_against_plain_version(spark):
    rows = documents() + [(500, "a\nb\nc\nd\na\nb\nc", "en", "s", 1, 7, 3, "x", 1, 0.5), (501, "q\nq\nq\nq\nq", "en", "s", 1, 7, 3, "x", 1, 0.5), (502, "b\nc\nd\nnew", "en", "s", 1, 7, 3, "x", 1, 0.5)]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in got:
        assert r["text"] in {None if t is None else want[r["doc_id"], t] for t in texts[r["doc_id"]]}
        assert r["n_lines"] - r["n_removed"] == (0 if r["text"] is None else len(r["text"].split("\n")) if r["n_removed"] < r["n_lines"] else 0)
    by = {r["doc_id"]: r for r in got}
    assert by[500]["text"] == "a\nb\nc\nd" and by[501]["text"] == "q" and by[502]["text"] == "new"
    assert by[0]["text"].count("shared line") == 4 and "shared line" not in by[9]["text"]


def test_different_texts_of_one_id_or_none_are_different_places(spark):
    for key in (None, 7):
        rows = [(key, f"a\nb\nc\nown {i}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(3)]
        got = linededup.dedup_lines(frame(spark, rows + rows[:1])).collect()
        texts = {r["text"] for r in got}
        assert len(got) == 4 and sum(t.startswith("a\nb\nc") for t in texts) == 1 and len(texts) == 3


def test_empty(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = linededup.dedup_lines(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_text_of_very_many_lines(spark):
    lines = [f"line {i % 9000} of a long text" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:50]))]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain(rows)
    assert got == {d: want[d, t] for d, t in rows}
