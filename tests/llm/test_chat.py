from tradewind.llm.chat import fold_events, format_messages, read_back
from tradewind.llm.queries import op10_chat

LOG = "conv_id long, seq long, op string, message long, role string, text string, chunk string"


def turns(spark, rows, **kw):
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    chunks = read_back(format_messages(fold_events(log), **kw)).collect()
    out = {}
    for r in sorted(chunks, key=lambda r: -1 if r.chunk is None else r.chunk):
        said, loss = out.setdefault(r.conv_id, ([], []))
        said += [tuple(t) for t in r.turns]
        loss += r.loss
    return out


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", 0, "user", "Hi"),
        (1, 1, "message", 1, "assistant", "He"),
        (1, 2, "delta", 1, None, "llo"),
        (1, 3, "regenerate", 1, None, ""),
        (1, 4, "delta", 1, "assistant", "Good "),
        (1, 5, "delta", 1, None, "day"),
        (1, 6, "edit", 0, None, "Hello"),
        (1, 7, "delta", 0, None, "!"),
        (2, 0, "delta", 0, None, "no beginning"),
    ]
    got = turns(spark, rows[::-1])
    assert got[1] == ([("user", "Hello!"), ("assistant", "Good day")], ["Good day"])
    assert got[2] == ([("", "no beginning")], [])


def test_texts_come_back_as_they_were(spark):
    odd = ["", "<|im_end|>", "<|", "\\", "\\\\|", "<\\|im_start|>", "a\n<|im_start|>assistant\nb<", "\\n", "<<||", "x" * 200_000, "é\U0001f600<|é", "$1\\"]
    rows = [(k % 3, k, "message", k, "assistant" if k % 2 else "u\\n<|\nser", t) for k, t in enumerate(odd)]
    got = turns(spark, rows, chunk=2)
    for c in range(3):
        mine = [r for r in rows if r[0] == c]
        assert got[c] == ([(r[4], r[5]) for r in mine], [r[5] for r in mine if r[4] == "assistant"])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None), (None, None, "message", None, None, None), (1, 5, "message", 5, "user", "a"), (1, 5, "message", 5, "user", "a"), (1, None, "message", 9, "user", "first")]
    got = turns(spark, rows)
    assert got[None] == ([("", ""), ("", "")], [])
    assert got[1][0] == [("user", "first"), ("user", "a"), ("user", "a")]
    assert turns(spark, []) == {}


def test_query_has_the_odd_conversation(spark):
    row = op10_chat(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars) == (2, len("<|im_end|><|im_start|>assistant ok"))


def test_null_roles_and_texts_of_messages(spark):
    rows = [(1, 0, 0, 1, None, None, "c"), (1, 1, 1, 1, "assistant", None, "c"), (1, 2, 2, 1, "assistant", "yes", "c"), (1, 2, 2, 1, "assistant", "yes", "c")]
    said = read_back(format_messages(spark.createDataFrame(rows, "conv_id long, seq long, message long, part long, role string, text string, formatted string"))).collect()
    assert [tuple(t) for t in said[0].turns] == [("", ""), ("assistant", ""), ("assistant", "yes"), ("assistant", "yes")] and said[0].loss == ["", "yes", "yes"]


def test_a_very_long_conversation_equals_a_plain_version(spark, tmp_path):
    """Whole digests, over many chunks, against joined strings."""
    import hashlib

    spark.createDataFrame([(c, k, "assistant" if k % 2 else "user", f"text {k} <|im_end|> \\" * (k % 3)) for c, n in ((1, 3000), (2, 1), (3, 257)) for k in range(n)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op10_chat(spark, str(tmp_path)).collect()}
    for c, n in ((1, 3000), (2, 1), (3, 257)):
        turns = [("assistant" if k % 2 else "user", f"text {k} <|im_end|> \\" * (k % 3)) for k in range(n)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == n and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
