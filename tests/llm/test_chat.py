import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strideflow.llm.chat import TEMPLATE, format_conversations, read_back
from strideflow.llm.templates import Choose, Escapes, Template, TemplateError, Text, fold, parse

PLAIN = Escapes(())


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 and not false %}d{% else %}e{% endif %}{% if false %}f{% endif %}g"), PLAIN)
    assert tree == (Text("abCdg"),)
    tree = fold(parse("{% if false %}a{% elif x %}b{% else %}c{% endif %}"), PLAIN)
    assert isinstance(tree[0], Choose) and len(tree[0].branches) == 2


def test_language():
    t = Template("{% set a = 'x' %}{% for m in messages %}{{ loop.index0 }}{{ a }}{{ m['t'] | trim }}{% if loop.last %}.{% endif %}{# no #}{% endfor %}{{ who }}")
    assert t.render([{"t": " p "}, {"t": "q"}], who="!") == ("0xp1xq.!", [])
    pieces = [t.turn(m, i, i == 1, who="!")[0] for i, m in enumerate([{"t": " p "}, {"t": "q"}])]
    assert "".join(pieces) == "0xp1xq.!"


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a() }}", "{{ a | open }}", "{% import os %}", "{% endif %}", "{{ 'a }}", "{{ a b }}"])
def test_rejected(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_no_python_attributes():
    assert Template("{{ m.__class__ }}").render([], m="text") == ("", [])


@given(st.text(alphabet="#\\ </turn>:ab\n", max_size=60))
def test_escapes_are_reversible(text):
    hidden = TEMPLATE.escapes.hide(text)
    assert TEMPLATE.escapes.show(hidden) == text
    assert not any(c in hidden for c in TEMPLATE.controls)


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole, _ = TEMPLATE.render([{"role": r, "text": t} for _, _, r, t in turns])
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    return out


def test_against_plain_version(spark):
    hard = "\\### Assistant: </turn> ok\n### user: \\\\a"
    rows = [(1, i, "assistant" if i % 2 else "user", f"{hard} {i} é漢" * (1 + i % 3)) for i in range(900)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (2, None, "assistant", "last"), (None, 0, "assistant", "a"), (None, 1, "a: b", "")]
    rows += [(3, 0, "assistant", "same")] * 3 + [(4, 5, "assistant", "</turn>\n"), (5, 0, "", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place string, part string").repartition(5)
    formatted = format_conversations(df)
    got = {r[0]: tuple(r)[1:] for r in read_back(formatted).collect()}
    assert got == expected(rows)
    pieces = sorted((r["place"], r["piece"]) for r in formatted.filter("conv_id = 1").collect())
    assert [p for p, _ in pieces] == list(range(900))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(df)).collect() == []


def test_query(spark):
    from llm_cases import SMALL
    from strideflow.llm.queries import CONTROL_TEXT, chat

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    assert {r[0]: tuple(r)[1:] for r in chat(spark, SMALL).collect()} == expected(rows)
