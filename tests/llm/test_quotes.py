import re

from folioscore.llm import quotes as Q


def norm(t):
    t = re.sub(r"(?m)^(?:>\x20?)+", "", t).lower()
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")


def depth(line):
    m = re.match(r"(?:>\x20?)+", line)
    return m[0].count(">") if m else 0


def parse(text):
    text = re.sub(r"\r\n?", "\n", text or "")
    if not re.search(r"(?m)^>", text):
        return text.strip(" \t\n\x0b\f\r"), []
    passages, now = [], None
    for line in text.split("\n"):
        d = depth(line)
        if d and now and now[0] == d:
            now[1].append(line)
        else:
            now = [d, [line]] if d else None
            if now:
                passages.append(now)
    body = re.sub(r"(?m)^[^\n>]+ wrote:[\x20\t]*(?:\n(?=>)|\n\n(?=>))", "\n", text)
    body = re.sub(r"(?m)^>[^\n]*(?:\n|\Z)", "", body)
    return re.sub(r"\n{3,}", "\n\n", body).strip(" \t\n\x0b\f\r"), passages


def long_lines(text):
    return {x for x in map(norm, text.split("\n")) if len(x.split(" ")) >= Q.LEAST_WORDS and x}


def brute(rows):
    parsed = [(c, t, r, *parse(x)) for c, t, r, x in rows]
    known = {}
    for c, t, _, body, _ in parsed:
        if c is not None and t is not None:
            for k in {norm(body), *map(norm, re.split(r"\n\s*\n", body)), *long_lines(body)} - {""}:
                known[c, k] = min(t, known.get((c, k), t))
    reply = {}
    for c, t, _, _, passages in parsed:
        found = []
        for d, lines in passages:
            text = "\n".join(lines)
            found += [(2 * d, -known[c, k]) for k in {norm(text)} - {""} if (c, k) in known and t is not None and known[c, k] < t]
            found += [(2 * d + 1, -known[c, k]) for k in long_lines(text) if (c, k) in known and t is not None and known[c, k] < t]
        if found:
            reply[c, t] = min([*found, *([reply[c, t]] if (c, t) in reply else [])])
    out = []
    for c, t, r, body, _ in parsed:
        root, n, own = t, 0, reply.get((c, t))
        while (c, root) in reply:
            root, n = -reply[c, root][1], n + 1
        out.append((c, t, r, -own[1] if own else None, root, n, body, f"<|{r or 'unknown'}|>\n{body}\n<|end|>\n"))
    return out


ROWS = [
    (1, 0, "user", "How do I sort a list?\n\nI have tried many things."),
    (1, 1, "assistant", "> How do I sort a list?\n\nUse sorted()."),
    (1, 2, "user", "Ann wrote:\n> > how do I  SORT a list?\n> Use sorted().\n\nAnd in reverse?"),
    (1, 3, "user", "unrelated"),
    (1, 4, "assistant", ">> Use sorted().\n> And in reverse?\nPass reverse=True.\n> I have tried many things.\n> not from here at all\nRight."),
    (1, 5, "user", "> > > > > > > > And in reverse?\nso deep"),
    (2, 0, "user", "> How do I sort a list?\nquotes another conversation"),
    (2, 1, None, "> quotes another conversation"),
    (2, 1, "user", "> quotes another conversation\r\nsame turn twice"),
    (2, 1, "user", "> quotes another conversation\r\nsame turn twice"),
    (None, 3, "user", "> unrelated"),
    (1, None, "user", "> unrelated\nno turn"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 2, "user", "> \n>\n>> \nonly signs"),
    (4, 0, "user", "first"),
    *[(4, i, "user", f"> {'first' if i == 1 else f'word number {i - 1}'}\nword number {i}") for i in range(1, 30)],
    (5, 0, "user", "line of many words\n" * 20_000),
    (5, 1, "user", "> line of many words\n" * 20_000 + "agreed"),
    (6, 0, "user", "word " * 100_000 + "end"),
    (6, 1, "user", "> " + "word " * 100_000 + "end\n\nagreed, " + " " * 100_000 + "in full"),
    (6, 2, "user", "w" * 300 + " wrote:\n> agreed, in full\nthe name above is long"),
    (7, 0, "user", "level zero"),
    *[(7, i, "user", "\n".join([f"{'>' * (i - k)} level {k or 'zero'}" for k in range(i)] + [f"level {i}"])) for i in range(1, 13)],
    (8, 0, "user", "ask me anything"),
    *[(8, i, "user", f"> ask me anything\nanswer {i}") for i in range(1, 3001)],
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, thread string, hash int")


def test_against_brute_force(spark):
    out = Q.conversations(frame(spark, ROWS).repartition(3))
    assert out.columns == ["conv_id", "turn", "role", "reply_to", "thread", "depth", "content", "formatted"]
    got, want = sorted(map(tuple, out.collect()), key=str), sorted(brute(ROWS), key=str)
    for g, w in zip(got, want, strict=True):
        assert g == w
    by = {(g[0], g[1]): g for g in got}
    assert by[6, 1][3] == 0 and by[6, 2][3] == 1 and by[6, 2][6] == "the name above is long"
    assert [by[7, i][3] for i in range(13)] == [None, *range(12)]
    assert by[7, 12][5] == 12 and all(by[8, i][3] == 0 for i in range(1, 3001))
    assert by[1, 2][3:6] == (1, 0, 2) and by[1, 4][3:6] == (2, 0, 3) and by[4, 29][5] == 29 and by[5, 1][3] == 0


def test_no_quotes_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b > c")]
    assert sorted(map(tuple, Q.conversations(frame(spark, rows)).collect())) == sorted(brute(rows))
    assert Q.conversations(frame(spark, [])).count() == 0


def test_sql(spark, tmp_path):
    """The query and its SQL over the fixture, which has quotes of every kind."""
    import duckdb

    from folioscore.llm import queries

    frame(spark, ROWS).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(queries.oracle_sql()["op10_quotation_linking"])
    names = [c[0] for c in cur.description]
    got = queries.op10_quotation_linking(spark, str(tmp_path)).select(*names)
    for g, w in zip(sorted(map(tuple, got.collect()), key=str), sorted(cur.fetchall(), key=str), strict=True):
        assert g == w


def test_deep_passages_side_by_side(spark):
    """Neighbours at depths 6 and 7 are passages of their own, however short."""
    rows = [(1, 0, "user", "one two"), (1, 1, "user", "three four"), (1, 2, "user", ">>>>>>> one two\n>>>>>> three four\nboth")]
    got = sorted(map(tuple, Q.conversations(frame(spark, rows)).collect()))
    assert got == sorted(brute(rows)) and got[2][3] == 1
