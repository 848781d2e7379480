import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import chat, queries

AWKWARD = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", ">", "a", "é", "<\\|"]), max_size=12).map("".join)


@given(AWKWARD)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@settings(max_examples=100)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), AWKWARD), AWKWARD), max_size=5))
def test_read_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    out, spans = chat.format_messages(messages)
    reader = chat.Reader()
    for chunk, inside in chat.Template(chat.CHATML).render(messages=iter(messages)):
        reader.feed(chunk, inside)
    n, turn_hash, loss_chars, loss_hash, chars = reader.result()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (n, chars, loss_chars) == (len(turns), len(out), len(loss))
    assert turn_hash == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert loss_hash == hashlib.sha256(loss.encode()).hexdigest()
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize(("source", "want"), [
    ("a{{ 'b' + 'c' | upper }}d", "abCd"), ("{% if 1 == 1 %}x{% else %}y{% endif %}z", "xz"),
    ("{% if q %}x{% elif 'a' in 'cat' %}w{% else %}y{% endif %}", "w"), ("{{ m.a['b'] }}|{{ m.none.b }}", "7|"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
    ("{%- set y = 'k' -%}  {{- y -}}  !", "k!"), ("{# note #}{{ not none and ('u' or 'v') }}", "u"), ("{{ 1 + 2 }}", "3"), ("{{ 'a\\n' }}", "a\n"),
])
def test_language(source, want):
    scope = {"m": {"a": {"b": 7}}, "xs": ["p", "q"]}
    assert "".join(t for t, _ in chat.Template(source).render(**scope)) == want


def test_constants_are_folded():
    assert chat.Template("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% endif %}").tree == [("text", "abcd")]


@pytest.mark.parametrize("source", [
    "{{ x() }}", "{{ x | eval }}", "{% import os %}", "{% for x %}{% endfor %}", "{% if x %}", "{{ 'a' 'b' }}", "{{ }}", "{% endif %}",
    "{{ " + "(" * 80 + "1" + ")" * 80 + " }}", "{% if a %}" * 80,
])
def test_bad_templates(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_no_python_attributes():
    assert list(chat.Template("{{ x.__class__ }}{{ x['__class__'] }}").render(x="s")) == [("", False), ("", False)]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", "q"), (1, 0, "user", "a", "q"), (1, 0, "user", "a", "q"), (2, None, None, None, "q"), (2, 1, "assistant", None, "q"),
            (None, 0, "user", queries.CONTROL_TEXT, "q"), (3, 0, "assistant", "<|im_end|>" * 20_000, "q")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k}", "q") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    found = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    assert found[1].n_turns == 3 and found[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest()
    assert found[2].n_turns == 2 and found[2].loss_chars == 0 and found[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[3].loss_chars == 200_000
    assert found[4].n_turns == 3000 and found[4].loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(1, 3000, 2)).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    for kind in ("smallint", "decimal(9,2)", "string", "int"):
        rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id int, turn int, role string, text string").selectExpr(f"cast(conv_id as {kind}) conv_id", "turn", "role", "text")
        out = chat.format_conversations(rows)
        assert out.schema["conv_id"].dataType == rows.schema["conv_id"].dataType and out.first().loss_chars == 2
