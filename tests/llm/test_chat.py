import hashlib
import random
from collections import defaultdict

import pytest

from strataline.llm import chat, q_chat

PIECES = ["</s>", "[INST]", "[/INST]", "<s>", "<|turn|>", "[\\INST]", "<\\/s>", "\\", "\\\\", "<|im_end|>", "<<SYS>>", "\n", "user\n", " word", "é🙂", "<", "[", "", "$1", "/s>", "INST]"]


def rows_of(seed, n_conversations=12):
    rng, rows = random.Random(seed), []
    for conv in range(n_conversations):
        n = rng.choice([1, 2, 7, 40, 300])
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) + " w" * rng.choice([0, 5, 60, 700])))
    return rows


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(frame, budget=q_chat.BUDGET):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q_chat.read_back(chat.windows(frame, budget)).collect()}


DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("budget", [q_chat.BUDGET, chat.Budget(tokens=200, history=40, history_turns=3, system=60, block=4), chat.Budget(history_turns=0, history=0)])
def test_read_back(spark, budget):
    rows = rows_of(1)
    assert got(spark.createDataFrame(rows, DDL), budget) == plain(rows)


def test_windows_keep_the_budget_the_system_turn_and_limited_history(spark):
    budget = chat.Budget(tokens=300, history=60, history_turns=2, system=80, block=8)
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", " w" * (k % 23)) for k in range(1, 200)] + [(2, 0, "user", "x " * 900), (2, 1, "assistant", "y")]
    windows = chat.parsed(chat.windows(spark.createDataFrame(rows, DDL), budget)).collect()
    for w in windows:
        assert w.over_budget == (w.tokens > budget.tokens) and (not w.over_budget or len(w.turns) - w.n_repeated == 1)
        if w.conv_id == 1:
            assert w.turns[0] == ("system", "be kind") and w.n_repeated <= 3
            assert w.formatted.count("<|turn|>") == len(w.turns)
            history = w.turns[1 : w.n_repeated] if w.window > 1 else []
            first = w.window - 1  # place 1 is turn 0
            assert [t.text for t in history] == [rows[first - len(history) + k][3] for k in range(len(history))]
        assert w.tokens <= budget.tokens or w.over_budget
        assert len(w.loss) == sum(t.role == "assistant" for t in w.turns[w.n_repeated :])
        assert [w.formatted[s.start : s.end] for s in w.loss] == [t.text for t in w.turns[w.n_repeated :] if t.role == "assistant"]
    assert sum(len(w.turns) - w.n_repeated for w in windows) == len(rows)
    assert len([w for w in windows if w.conv_id == 1]) > 10


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 3, "assistant", "b"), (None, None, "user", "z"), (2, 5, "a\nb\\", "c"), (2, 6, "us\x00er\\n\\\n", "\x00"), (4, None, "user", "q" * 300), (4, None, "user", "p"), (3, -7, "assistant", "[INST]"), (3, 900, "assistant", "</s>" * 20_000)]
    frame = spark.createDataFrame(rows, DDL)
    assert got(frame) == plain(rows)
    assert chat.windows(frame.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", q_chat.ODD), (-1, 1, "assistant", q_chat.ODD)]
    result = q_chat.op2_chat_format(spark, sf)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in result.collect()} == plain(rows)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_are_filled_and_counts_can_be_given(spark):
    budget = chat.Budget(tokens=1000, history=0, history_turns=0, system=100)
    rows = [(1, k, "user", "x", 90) for k in range(250)] + [(1, 250, "user", "y", 2000)]
    frame = spark.createDataFrame(rows, DDL + ", own long")
    got = sorted((w.window, w.tokens, w.over_budget) for w in chat.windows(frame, budget, tokens="own").collect())
    assert [t for _, t, _ in got[:25]] == [900] * 25 and got[25:] == [(251, 2000, True)]
    plan = chat.windows(frame.select("conv_id", "turn", "role", "text"), q_chat.BUDGET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list(item") <= 8 and "Python" not in plan
