from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings, strategies as st

from lorekeep.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, n int"


@settings(max_examples=300, deadline=None)
@given(st.text("<|\\im_\nstardn>e", max_size=30), st.text("<|\\im_\nstardn>e", max_size=30))
def test_turns_are_read_back(role, text):
    piece, begin, end = chat.format_turn(role, text)
    assert chat.parse_turn(piece) == (role, text)
    assert piece.count(chat.START) == 1 and piece.count(chat.END) == 1
    assert chat.unescape(chat.format_turn("assistant", text)[0][len("<|im_start|>assistant\n") :][: -len(chat.END) - 1]) == text


def rows() -> list[tuple]:
    rng = random.Random(8)
    found = [(-1, k, r, f"{chat.END}{chat.START}assistant ok") for k, r in enumerate(("user", "assistant"))]
    for conv in range(60):  # many share a first turn, and some all turns
        for turn in range(rng.randrange(1, 6)):
            role = "assistant" if turn % 2 else "user"
            found.append((conv, turn, role, "hello" if turn == 0 and conv % 3 else f"t{rng.randrange(3)} <\\|x|>"))
    found += [(100, k, "user", "long") for k in range(300)] + [(101, None, None, None), (101, 1, "assistant", "")]
    found += [(102, 1, "assistant", "same")] * 2 + [(None, 1, "assistant", "é𝛼"), (None, 2, "user", "\n"), (103, 0, "user", "b" * 200000)]
    return found


def order(row):
    return tuple((v is not None, v) for v in row)


def conversations() -> dict:
    by = {}
    for conv, turn, role, text in sorted(rows(), key=order):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_forest_and_reading_back(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], SCHEMA)
    nodes, paths = chat.build_forest(df.repartition(5))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(nodes, paths).collect()}
    want = {}
    for conv, turns in conversations().items():
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(chat.format_turn(r, t)[0]) for r, t in turns)
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    assert got == want

    held = {r["node"]: r for r in nodes.collect()}
    prefixes = {tuple(turns[: k + 1]) for turns in conversations().values() for k in range(len(turns))}
    assert len(held) == len(prefixes) == nodes.count()  # each shared turn once
    stream = sorted(held.values(), key=lambda r: r["offset"])
    at = 0
    for r in stream:
        assert r["offset"] == at and len(r["piece"]) == r["length"]
        at += r["length"]
    opened = []
    for r in stream:  # depth first: the parent is on the stack
        while opened and opened[-1] != r["parent"]:
            opened.pop()
        assert (opened[-1] if opened else None) == r["parent"]
        opened.append(r["node"])
        chain = [held[n] for n in opened]
        assert r["position"] == sum(c["length"] for c in chain[:-1])
        seen = sorted(x for c in chain for x in range(c["offset"], c["offset"] + c["length"]))
        assert sorted(x for s in r["attend"] for x in range(s["start"], s["stop"])) == seen
        assert all(a["stop"] < b["start"] for a, b in zip(r["attend"], r["attend"][1:]))


def test_empty_table(spark):
    nodes, paths = chat.build_forest(spark.createDataFrame([], SCHEMA))
    assert nodes.count() == 0 and chat.read_back(nodes, paths).collect() == []
