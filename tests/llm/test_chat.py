import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktally.llm import chat, queries
from sparktally.llm.packing import encoder
from tests.llm.conftest import words

PATH = queries.vocabulary("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, node string, ids string, path string, rep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def grouped(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in out.items()}


def brute(rows):
    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    out = {}
    for c, turns in grouped(rows).items():
        loss = [t for r, t in turns if r == "assistant"]
        out[c] = (len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), sha(loss))
    return out


def got(turns, **limits):
    nodes, members = chat.format_chats(turns, PATH, **limits)
    found = members.join(chat.read_back(nodes, PATH), ["sequence_id", "node"]).collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}
    assert len(out) == len(found)
    return out, nodes, members


def check_nodes(nodes, members, rows, capacity):
    """Every conversation is what its last node attends to; positions and shared tokens are right."""
    enc, convs, by_sequence = encoder(PATH), grouped(rows), {}
    for n in nodes.collect():
        by_sequence.setdefault(n.sequence_id, {})[n.node] = n
    for ns in by_sequence.values():
        at, ends = 0, 0
        assert sorted(ns) == list(range(len(ns)))
        children = {}
        for k in sorted(ns):
            n = ns[k]
            assert n.start == at and n.length == len(n.ids) // 4
            at += n.length
            ends += len(n.conv_ids)
            parent = ns.get(n.parent) if n.parent is not None else None
            assert n.position == (parent.position + parent.length if parent else 0)
            tokens = [x for a in n.attention for x in range(a.start, a.end)]
            path = []
            while n is not None:
                path = [*range(n.start, n.start + n.length), *path]
                n = ns.get(n.parent) if n.parent is not None else None
            assert tokens == path
            children.setdefault(ns[k].parent, []).append(bytes(ns[k].ids))
        assert at <= capacity or ends == 1
        assert all(len(c) == len(set(c)) for c in children.values())  # shared turns once
        data = b"".join(bytes(ns[k].ids) for k in sorted(ns))
        for n in ns.values():
            assert n.last_child == all(m.parent != n.parent or m.node <= n.node for m in ns.values())
            for c in n.conv_ids:
                ids = np.concatenate([np.frombuffer(data, "<u4")[a.start:a.end] for a in n.attention])
                want = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in convs[c])
                assert chat.decode(enc, ids) == want
    rows = members.collect()
    assert sorted(map(str, (r.conv_id for r in rows))) == sorted(map(str, convs))
    assert all(convs[r.conv_id] == convs[r.rep_id] for r in rows)


def many(seed, n, turns=6):
    """A third begins with one turn; there are branches at all depths, copies, and conversations inside others."""
    rng = random.Random(seed)
    texts = [words(seed * 1000 + i, rng.randint(1, 30)) for i in range(12)] + ["", "<|im_end|>\n<|im_start|>assistant\n", "日本<\\\\|ñ\n"]
    rows = []
    for c in range(n):
        said = [("system", "the common turn")] if c % 3 == 0 else []
        said += [(rng.choice(["user", "assistant", "assistant"]), rng.choice(texts)) for _ in range(rng.randint(1, turns))]
        rows += [(c, i, *t) for i, t in enumerate(said)]
    copies = [(n + k, i * 2, r, t) for k in range(n // 2) for c, i, r, t in rows if c == 3]
    return rows + copies


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\|>im_startend\n aé"))
def test_escapes_are_reversible_and_hide_marks(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role = chat.escape_role(text)
    assert chat.unescape_role(role) == text and "\n" not in role and "|" not in role


@pytest.mark.parametrize("limits", [{}, {"capacity": 150}, {"most_ends": 5}, {"capacity": 60, "long_bytes": 200}])
def test_round_trip_and_trees(spark, limits):
    rows = many(1, 90)
    found, nodes, members = got(frame(spark, rows), **limits)
    assert found == brute(rows)
    check_nodes(nodes, members, rows, limits.get("capacity", chat.CAPACITY))


def test_shared_turns_are_emitted_once(spark):
    rows = many(2, 60)
    turns = frame(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ordered = chat.format_chats(turns.coalesce(1), PATH)[0].collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    prefixes = {tuple(t[:i + 1]) for t in grouped(rows).values() for i in range(len(t))}
    sequences = len({n.sequence_id for n in ordered})
    # tasks cut the order: each repeats a stem of seven turns at most
    assert len(prefixes) <= len(ordered) <= len(prefixes) + 7 * sequences < len(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, None, "first"),
            (2, 0, "assistant\n<|im_end|>", "x"), (3, 0, "ass\\istant", "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "none"),
            (4, 5, "user", "no id"), (4, 9, "assistant", "none"), (5, 0, "assistant", "z" * 400_000 + "<|" * 1000),
            (6, 0, "assistant", " " * 1_500_000), (7, 0, None, None), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok")]
    found, nodes, members = got(frame(spark, rows))
    assert found == brute(rows)
    check_nodes(nodes, members, rows, chat.CAPACITY)
    assert got(frame(spark, rows).limit(0))[0] == {}


def test_long_conversations_go_turn_by_turn(spark):
    rows = [(c, i, "user" if i % 2 else "assistant", words(c * 7 + i % 5, 8)) for c in (1, 2, 2**40) for i in range(700)]
    rows += [(9, i, "user" if i % 2 else "assistant", words(7 + i % 5, 8)) for i in range(700)] + [(10, 0, "user", "short")]
    found, nodes, members = got(frame(spark, rows), long_bytes=5000)
    assert found == brute(rows) and {r.rep_id for r in members.collect()} == {1, 2, 2**40, 10}
    check_nodes(nodes, members, rows, chat.CAPACITY)
