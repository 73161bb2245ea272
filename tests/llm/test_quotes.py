from linkloom.llm import quotes


def test_levels_and_passages():
    text = "Hello\n> one\n> two\n>> deep\n> > deeper too\nOn Monday Ann wrote:\n> three\n\n>\n> four\nbye"
    assert quotes.passages(text) == [
        (0, "Hello"), (1, "one\ntwo"), (2, "deep\ndeeper too"), (1, "three"), (1, "four"), (0, "bye"),
    ]
    assert quotes.own_text(text) == "Hello\n\nbye"
    assert quotes.passages(None) == quotes.passages("") == quotes.passages(" \n>\n") == []
    assert quotes.passages("a > b") == [(0, "a > b")]


def link(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "message_id bigint, text string, depth int, position string").repartition(3)
    return sorted((tuple(r) for r in quotes.link(frame).collect()), key=str)


def test_threads(spark):
    rows = [
        (1, "First message here"), (2, "> first  MESSAGE here\n\nA reply"), (3, "> A reply\n>> First message here\n\nMore"),
        (4, "> First message here\n\nAnother reply"), (5, "> never written\n\nAlone"), (6, None), (7, ""),
        (8, "> never written\n>> More\n\nBy the deeper one"), (9, "First message here"), (10, "> First message here\n\n> A reply\n\n> A reply\n\nx"),
        (11, "> Later\n\nToo early"), (12, "Later"), (13, "> self\n\nself"), (None, "> First message here"),
    ]
    out = {r[0]: r for r in link(spark, rows)}
    parent = {i: r[2] for i, r in out.items()}
    assert parent == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: None, 7: None, 8: 3, 9: None, 10: 1, 11: None, 12: None, 13: None, None: None}
    assert {i: out[i][3] for i in (1, 2, 3, 4, 8, 10)} == dict.fromkeys((1, 2, 3, 4, 8, 10), 1)
    assert {i: out[i][4] for i in (1, 2, 3, 4, 8, 10, 5)} == {1: 0, 2: 1, 3: 2, 4: 1, 8: 3, 10: 1, 5: 0}
    assert [out[i][5] for i in (1, 2, 3, 4, 8, 10)] == [1, 2, 3, 4, 5, 6]
    assert out[2][1] == "A reply" and out[6][1] == "" and out[None][3] is None


def test_repeats_long_chains_and_empty_tables(spark):
    chain = [(i, (f"> message {i - 1}\n\n" if i else "") + f"message {i}") for i in range(40)]
    rows = chain + [(3, "another row of three"), (50, "long " * 100_000), (51, "> " + "long " * 100_000 + "\n\nyes")]
    out = link(spark, rows)
    assert len(out) == len(rows)
    depth = {r[0]: r[4] for r in out}
    assert all(depth[i] == i for i in range(40)) and depth[51] == 1
    assert link(spark, rows[:0]) == []


def test_turns_without_an_id_are_kept(spark):
    from linkloom.llm.queries import quoted_mail

    rows = [(1, 0, "first"), (1, 1, "second"), (1, None, "no turn"), (1, -1, "before"), (1, 1 << 20, "too large"), (None, 1, "no conversation")]
    mail = quoted_mail(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string"))
    out = quotes.link(mail).collect()
    assert sorted(r["own"] for r in out) == sorted(x for _, _, x in rows)
    assert sorted(r["message_id"] for r in out if r["message_id"] is not None) == [1 << 20, (1 << 20) + 1]
    assert [r["parent_id"] for r in out if r["own"] == "second"] == [1 << 20]


def test_lines_that_introduce_a_quotation_have_any_length():
    long = "On Monday " + "somebody " * 100 + "wrote:"
    assert quotes.passages(f"{long}\n> one\nbye") == [(1, "one"), (0, "bye")]
