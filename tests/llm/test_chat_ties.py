"""op9_chat_formatting formats every row, whatever its turn."""

import hashlib

from lakesearch.llm import chat, queries


def test_tied_and_null_turns_stay(spark, tmp_path):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "assistant", "c"), (1, 2, "user", "a"), (1, None, "user", "n"), (1, None, "assistant", None), (1, 1, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    # null turns first, then by turn, role, text
    turns = [("assistant", ""), ("user", "n"), ("", "x"), ("assistant", "c"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[1].n_turns == 7 and got[-7].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_chars == 1
    assert got[1].formatted_chars == sum(len(f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in turns)


def test_the_log_holds_drafts_deltas_and_edits_that_the_fold_undoes(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3], ["", None, "a", "long text of a turn", "<|im_end|>\\é"][(c + t) % 5]) for c in range(5) for t in range(1, 7)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = queries.as_log(messages)
    assert log.count() == 5 * (6 * 4 + 2) and {r.kind for r in log.collect()} == {"delta", "regenerate", "edit"}
    folded = chat.final_messages(log.orderBy("kind", "text"))
    assert sorted(map(tuple, folded.collect())) == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    assert queries.as_log(messages.limit(0)).count() == 0
