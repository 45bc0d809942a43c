from arkose.llm import chat


def test_longest_common_prefix_is_rendered_once(spark):
    u, a = ("user", "hi"), ("assistant", "ok")
    rows = [(1, [u, a, u, ("assistant", "yes é")], [u, a, ("user", "no"), a]), (2, [u, a], [u, a]), (3, [u], [u, a]), (4, None, [a]), (None, [(None, None)], [(None, "x<|end|>")]), (1, [], [])]
    df = spark.createDataFrame([(*r, "p") for r in rows], f"conv_id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    got = chat.preferences(df).collect()
    assert [r.n_prompt for r in got] == [2, 2, 1, 0, 0, 0]
    for r, (_, c, d) in zip(got, rows):
        turn = lambda t: f"<|{t[0] or 'unknown'}|>\n{(t[1] or '').replace('<|', '< |')}<|end|>\n"
        assert r.prompt + r.chosen == "".join(map(turn, c or [])) and r.prompt + r.rejected == "".join(map(turn, d or []))
        for text, spans, turns in ((r.chosen, r.chosen_mask, c), (r.rejected, r.rejected_mask, d)):
            assert [text[s.start : s.end] for s in spans] == [f"{t[1]}<|end|>\n" for t in (turns or [])[r.n_prompt :] if t[0] == "assistant"]
    assert chat.preferences(df.limit(0)).collect() == []


def test_last_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "z"), (2, 0, "assistant", "only"), (3, 0, "user", "none"), (None, 0, "assistant", "x"), (4, None, "assistant", None)]
    got = {r.conv_id: (r.chosen, r.rejected) for r in chat.last_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 4}
    assert [t.text for t in got[1][0]] == ["q", "a", "r", "b"] and [t.text for t in got[1][1]] == ["q", "a", "r", "a"]
    assert [t.text for t in got[2][1]] == [""]
