import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from parcelcast.llm import chat

PIECES = ["[INST]", "[/INST]", " [/INST]", "</s>", "<s>", "\\", "\\\\", "<<SYS>>", " <</SYS>>", "<<ROLE>>", " <<END>>", "<", "[", " ", "\n", "a", "é", "漢"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=7).map("".join), min_size=1, max_size=8))
def test_escaping_is_undone(texts):
    import re

    escape = lambda t: re.sub(chat._CONTROL, lambda m: m[1] * 2 + "\\" + m[2], t)
    whole, turns = "", []
    for i, t in enumerate(texts):
        role = ["user", "assistant", "system", t][i % 4]
        a, b = chat.MARKS.get(role, (f"{chat.OTHER[0]}{escape(role)}{chat.OTHER[1]}", chat.OTHER[2]))
        whole += a + escape(t) + b
        turns.append((role, t))
    assert chat.parse(whole) == turns


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi [INST] \\</s>"), (1, 1, "assistant", "yes\n<<SYS>> \\"), (1, 2, None, None), (1, 3, "assistant", None),
            (2, 5, "system", ""), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 1, "tool[/INST]", "x" * 5000), (None, 0, "user", "q"), (None, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.chain(df))).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, a or "", x or "") for c, t, a, x in rows if c == conv))
        loss = "".join(x for _, _, a, x in own if a == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{a}\n{x}\n" for _, _, a, x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat.format_trees(chat.chain(df.limit(0))).count() == 0


def test_trees_and_ranks(spark):
    rows = [(1, 1, None, 0.1), (1, 2, 1, 0.9), (1, 3, 1, 0.2), (1, 4, 2, 0.3), (1, 5, 2, 0.8), (1, 6, 5, None), (2, 1, 77, 1.0)]
    rows += [(3, i, i - 1 if i else None, 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in chat.paths(df).collect():
        got.setdefault((r.tree, r.rank), {})[r.place] = r.node
    path = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert path == {(1, 1): [1, 2, 5, 6], (1, 2): [1, 2, 4], (1, 3): [1, 3], (2, 1): [1], (3, 1): list(range(37))}
    assert {(r.tree, r.leaf) for r in chat.paths(df, branches=1).collect()} == {(1, 6), (2, 1), (3, 36)}


def test_circles_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree long, node long, parent long, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.paths(df)
