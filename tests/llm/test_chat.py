import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import chat, queries, template
from tests.llm.helpers import SF

TEXT = st.lists(st.sampled_from(["<", "s", "/", ">", "\\", "[", "INST", "]", "n", "\n", " ", "é", "😀", "</s>", "[/INST]"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_escapes_are_reversible_and_hide_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    head = chat.line(text)
    assert chat.unline(head) == text and "\n" not in head and not any(c in head for c in chat.CONTROLS)


def digest(turns):
    said = [t for r, t in turns if r == "assistant"]
    return {"n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            "loss_chars": sum(map(len, said)), "loss_sha256": hashlib.sha256("".join(said).encode()).hexdigest()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=6))
def test_round_trip_of_conversations(turns):
    pieces = list(chat.formatter()({"role": r, "text": t} for r, t in turns))
    got = chat.read(pieces)
    assert got.pop("formatted_chars") == len("".join(t for t, _ in pieces))
    assert got == digest(turns)
    reader, back = chat.Reader(), []
    for c in "".join(t for t, _ in pieces):   # whatever the pieces
        back += reader.feed(c)
    assert back == turns and not reader.rest


def model(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    return {c: digest([x[-2:] for x in sorted(v)]) for c, v in own.items()}


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 0, None, "hi"), (2, None, "user", ""), (2, 0, "assistant", "x" * 200_000), (None, 0, "user", "lost"), (None, 1, "assistant", "</s>\n"),
            (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a")]
    extra = [(*r, "k", 9) for r in rows]
    frame = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, formatted string, part int")
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k not in ("conv_id", "formatted_chars")} for r in chat.digests(frame).collect()}
    assert got == model(rows)
    assert chat.digests(frame.limit(0)).count() == 0


def test_formatted_text_and_mask_in_parts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(40)] + [(2, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    parts = sorted(chat.format_conversations(frame, part_chars=100).where("conv_id = 1").collect(), key=lambda r: r["part"])
    assert len(parts) > 3 and "".join(r["formatted"] for r in parts) == whole[1]["formatted"]
    said = [chat.unescape(r["formatted"][s["start"]:s["end"]]) for r in parts for s in r["mask"]]
    assert said == [t for _, _, role, t in rows[:40] if role == "assistant"]


def test_query(spark):
    got = {r["conv_id"]: r.asDict() for r in queries.QUERIES["op4_chat_formatting"](spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.OWN_CONVERSATION
    assert {c: {k: r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")} for c, r in got.items()} == model(rows)


def render(source, **values):
    return "".join(t for t, _ in template.compile_template(source, values)(values))


def test_language():
    assert render("a{{ x }}b", x=None) == "ab" and render("{{ x.y.z }}|{{ x.q }}", x={"y": {"z": 3}}) == "3|"
    assert render("{% for i in xs %}{{ loop.index0 }}{{ i }}{% if loop.last %}.{% elif loop.first %}:{% else %},{% endif %}{% endfor %}", xs="abc") == "0a:1b,2c."
    assert render("{% for i in xs %}x{% endfor %}", xs=None) == ""
    assert render("{% set y = x ~ '!' %}{{ y | upper | trim }}", x=" a") == "A!"
    assert render("{{ not x == 'a' or 'b' in x and true }}", x="b") == "true"
    assert render("{{ (1 + 2) ~ '' }}{{ 'it\\'s\\n' }}") == "3it's\n"
    assert list(template.compile_template("{% generation %}{{ x }}{% endgeneration %}z", ["x"])({"x": 1})) == [("1", True), ("z", False)]


@pytest.mark.parametrize("bad", ["{{ y }}", "{{ x | nope }}", "{% for i in x %}", "{% if x %}", "{{ x.__class__() }}", "{{ x + }}", "{% bad %}", "{{ (x }}", "{% for i in x %}{% endfor %}{{ i }}", "{{ x[0] }}", "{% set 1 = x %}"])
def test_what_is_not_in_the_language(bad):
    with pytest.raises(template.TemplateError):
        template.compile_template(bad, ["x"])


def test_sandbox_sees_no_python_attributes():
    assert render("{{ x.__class__ }}{{ x.upper }}", x="text") == ""


def test_constant_folding():
    tree = template.fold(template.parse("a{{ 'b' | upper }}{{ 1 + 2 }}{% if 1 == 2 %}no{% elif true %}yes{{ x }}{% else %}no{% endif %}", ["x"]))
    assert tree == (template.Output(template.Const("aB3")), template.Output(template.Const("yes")), template.Output(template.Name(("x",))))
    source = "{% if x == 'q' and true %}1{% elif 'a' in 'b' %}2{% else %}3{{ 'c' ~ x }}{% endif %}"
    assert render(source, x="q") == "1" and render(source, x="z") == "3cz"


def test_long_conversations_are_never_held_whole():
    taken = []

    def messages():
        for i in range(10_000):
            taken.append(i)
            yield {"role": "user", "text": "x"}

    pieces = chat.formatter()(messages())
    for _ in range(30):
        next(pieces)
    assert len(taken) < 20
