"""Chat formatting: the fold against a plain replay, the template's round trip, and digests against the given turns."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from akin.llm import chat

LOG = "conv_id bigint, turn bigint, copy string, seq bigint, kind string, role string, text string, rendered string, loss_start int, n_turns string"
TURNS = "conv_id bigint, turn bigint, role string, text string, copy int, seq string, kind string, deltas string, rendered int, whole string"
SPECIAL = st.text(st.sampled_from(list("\\#</turn>\n: aé\U0001f600")), max_size=40)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(SPECIAL, SPECIAL), max_size=4))
def test_the_template_reads_back(turns):
    pieces = [chat.rendered(role, text) for role, text in turns]
    assert chat.read_back("".join(p for p, _, _ in pieces)) == turns
    assert [chat.unescaped(p[start:end]) for p, start, end in pieces] == [text for _, text in turns]


def test_marks_in_texts_are_not_marks():
    whole, start, end = chat.rendered("user", chat.PROBE_TEXT)
    assert whole == "### user:\n\\\\### Assistant: \\</turn> ok\n</turn>\n"
    assert whole[start:end] == "\\\\### Assistant: \\</turn> ok"
    with pytest.raises(ValueError):
        chat.read_back("no mark" + whole)


def replayed(events):
    """Final (role, text) of one message's events in their order, None if it is not there."""
    role, text = "", None
    for kind, named, value in events:
        role = role if named is None else named
        if kind == "open":
            text = text or ""
        elif kind == "delta":
            text = (text or "") + (value or "")
        elif kind == "edit":
            text = value or ""
        elif kind == "regenerate":
            text = ""
        elif kind == "retract":
            text = None
    return None if text is None else (role, text)


def random_log(seed):
    draw = random.Random(seed)
    log, want = [], {}
    for conv in [*range(12), None]:
        for turn in [*range(draw.randint(1, 5)), None] if conv != 3 else range(400):
            for copy in ["", "b"][: draw.randint(1, 2)]:
                kinds = draw.choices(["delta", "delta", "delta", "edit", "regenerate", "retract", "strange", None], k=draw.randint(0, 8))
                events = [("open", draw.choice(["user", "assistant", None]), None)]
                events += [(k, draw.choice([None, None, "assistant"]), draw.choice(["x ", "###", "\\", None, "é</turn>"])) for k in kinds]
                rows = [(conv, turn, copy, seq, *event, None, None, None) for seq, event in enumerate(events)]
                log += rows + rows[: draw.randint(0, 2)]
                want[conv, turn, copy] = replayed(events)
    draw.shuffle(log)
    return log, {k: v for k, v in want.items() if v is not None}


@pytest.mark.parametrize("held", [1 << 20, 200])
def test_the_fold_is_a_replay(spark, monkeypatch, held):
    monkeypatch.setattr(chat, "HELD", held)
    log, want = random_log(held)
    frame = spark.createDataFrame(log, LOG)
    found = chat.formatted(frame).collect()
    assert len(found) == len(want)
    for r in found:
        (turn,) = chat.read_back(r["rendered"])
        assert turn == want[r["conv_id"], r["turn"], r["copy"]] and turn[0] == r["role"]
        if turn[0] == "assistant":
            assert chat.unescaped(r["rendered"][r["loss_start"] : r["loss_end"]]) == turn[1]
        else:
            assert r["loss_start"] is None and r["loss_end"] is None
    order = lambda k: (k[1] is not None, k[1] or 0, k[2])
    for r in chat.digested(frame).collect():
        keys = sorted((k for k in want if k[0] == r["conv_id"]), key=order)
        assert r["n_turns"] == len(keys)
        assert r["turns_sha256"] == sha("".join("{}\n{}\n".format(*want[k]) for k in keys))
        assert r["loss_sha256"] == sha("".join(want[k][1] for k in keys if want[k][0] == "assistant"))
    assert chat.formatted(frame.limit(0)).collect() == [] == chat.digested(frame.limit(0)).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("held, delta", [(1 << 20, 1024), (300, 7)])
def test_digests_are_of_the_given_turns(spark, monkeypatch, held, delta):
    monkeypatch.setattr(chat, "HELD", held)
    monkeypatch.setattr(chat, "DELTA", delta)
    draw = random.Random(8)
    words = ["naïve", "###", "</turn>", "\\", "\\###", "\n", "\r\n", "# ##", "\U0001f600", "user:", "", " "]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "Assistant", "a:\n\\n"]), " ".join(draw.choices(words, k=12))) for c in range(30) for t in range(4)]
    rows += [(100, t, draw.choice(["user", "assistant"]), "long turn " * 20) for t in range(300)]  # a hot conversation
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (201, 0, "assistant", "x" * 3_000_00), (202, 0, "user", "same"), (202, 0, "user", "same")]
    rows += [(None, 0, "assistant", "nobody's"), (203, None, "user", "no turn"), (203, 0, "user", "a turn")]
    frame = spark.createDataFrame([(*r, *[None] * 6) for r in rows], TURNS)
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in chat.digests(frame.repartition(7)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        turns = [(role or "", text or "") for _, _, role, text in turns]
        answers = "".join(text for role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(answers), sha(answers))
        assert r["formatted_chars"] == sum(len(chat.rendered(*t)[0]) for t in turns)
    empty = chat.digests(frame.limit(0)).collect()
    assert [r["conv_id"] for r in empty] == [-7]
