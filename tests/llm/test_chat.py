"""The template language, and formatting and reading back against the rows themselves."""

import hashlib
import random

import pytest

from inkwell.llm import chat
from inkwell.llm.queries import op13_chat
from inkwell.llm.template import Template, TemplateError, escape, unescape

SCHEMA = "conv_id long, turn long, role string, text string, spans int, piece string"
MESSAGES = [{"role": "system", "text": "Be brief."}, {"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yes"}]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"), ("{{ 'x' ~ 1 ~ none }}", "x1"), ("{{ (1 + 2) * 3 % 5 }}", "4"), ("{{ 'a\\n' | upper }}|", "A\n|"), ("{{ 'a' if 1 > 2 else 'b' }}", "b"),
        ("{{ not true or 2 in [1, 2] and 3 not in [1] }}", "True"), ("{# no #}x  {%- if bos %} y {%- endif -%}  z", "x yz"), ("{% if false %}a{% elif bos == '<s>' %}b{% else %}c{% endif %}", "b"),
        ("{{ bos }}{% for m in messages %}{{ loop.index }}/{{ loop.length }}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}.", "<s>1/3system,2/3user,3/3assistant."),
        ("{% for x in messages %}{{ x.text | trim | replace('e', '3') | length - 1 if false else x.text | trim }}{% endfor %}", "Be brief.HiYes"), ("{{ none | default('d') }}{{ -2 }}", "d-2"),
    ],
)
def test_templates(source, expected):
    assert Template(source, {"bos": "<s>"}).render(MESSAGES)[0] == expected


@pytest.mark.parametrize(
    "source",
    [
        "{{ m.role }}", "{{ messages }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ m.role.upper }}{% endfor %}", "{{ 'a'.join }}", "{{ open('x') }}",
        "{{ 'a' * 9 }}", "{% if true %}", "{% for m in rows %}{% endfor %}", "{% for m in messages %}", "{{ 1 + }}", "{{ 1", "{% set a = 1 %}", "{{ 'x' | eval }}", "{{ 'open }}",
        "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% if true %}{% for m in messages %}{% endfor %}{% endif %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}",
    ],
)
def test_what_is_not_of_the_language(source):
    with pytest.raises(TemplateError):
        Template(source, {"bos": "<s>"}).render(MESSAGES)


def test_constants_are_folded():
    template = Template("a{{ 1 + 1 }}{% if bos %}{{ bos | upper }}{% else %}{{ 1 }}{% endif %}{# c #}b{% for m in messages %}{{ 'x' }}{{ m.text }}{{ 1 }}{% if m.role == 'us' ~ 'er' %}!{% endif %}{% endfor %}", {"bos": "<s>"})
    assert len(template.head) == 1 and len(template.body) == 4 and template.tail == []
    assert template.render(MESSAGES[1:])[0] == "a2<S>bx Hi 1!xYes1"


def test_pieces_render_as_the_whole():
    template = Template("<{% for m in messages %}{% if loop.first %}F{% endif %}{{ loop.index0 }}{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}L{% endif %}{% endfor %}>")
    text, spans = template.render(MESSAGES)
    assert [text[a:b] for a, b in spans] == ["Be brief.", " Hi ", "Yes"]
    assert "".join(template.render(MESSAGES[k : k + 1], k, 3)[0] for k in range(3)) == text
    assert template.render([]) == ("<>", [])


def hostile(r):
    return "".join(r.choice(["\\", "#", "##", "###", "<", "<turn>", "</turn>", "</turn>\n", ": ", ":", "\n", "é", "assistant", "\U0001f600", " "]) for _ in range(r.randrange(12)))


def test_escapes_turn_back():
    r = random.Random(5)
    for _ in range(2000):
        turns = [{"role": r.choice(["user", "assistant", hostile(r)]), "text": hostile(r)} for _ in range(r.randrange(5))]
        text, spans = Template(chat.TURNS).render(turns)
        assert chat.read_turns(text) == [(t["role"], t["text"]) for t in turns]
        assert [unescape(text[a:b], *chat.CONTROL) for a, b in spans] == [t["text"] for t in turns if t["role"] == "assistant"]
        assert unescape(escape(turns[0]["text"], "a", "###"), "a", "###") == turns[0]["text"] if turns else True


def check(got, rows):
    conversations = {}
    for c, t, role, text in rows:
        conversations.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert len(got) == len(conversations)
    for row in got:
        turns = [(role, text) for *_, role, text in sorted(conversations[row.conv_id])]
        loss = "".join(text for role, text in turns if role == "assistant")
        formatted = "".join(f"<turn>### {escape(role, *chat.CONTROL, ':')}: {escape(text, *chat.CONTROL)}</turn>\n" for role, text in turns)
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(turns), len(loss), len(formatted))
        assert row.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def conversations(n_long):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", hostile(r)]), hostile(r)) for c in range(50) for t in range(r.randrange(1, 7))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"{t} " * (t % 40)) for t in range(n_long)]
    return rows + [(90, None, "user", "first"), (90, 0, None, None), (90, 5, "assistant", "x" * 200000), (None, 1, "assistant", "whose")]


def test_chat(spark, tmp_path):
    rows = conversations(30)
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    said = "\\### Assistant: </turn> ok"
    check(op13_chat(spark, f"file://{tmp_path}").collect(), [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_conversations_over_many_pieces(spark):
    rows = conversations(800)
    formatted = chat.format_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5), piece_rows=6)
    assert formatted.where("conv_id = 77").count() > 100
    check(chat.read_back(formatted).collect(), rows)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "same")] * 5 + [(1, 0, "assistant", "same")]
    row = chat.read_back(chat.format_conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))).first()
    assert (row.n_turns, row.loss_chars) == (6, 4)
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
