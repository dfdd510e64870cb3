"""Operator 3: the language, exact round trips, and the query against SQL."""

import hashlib

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from touchline.llm import chat


def shown(template, **names):
    return "".join(t for t, _ in chat.compile_template(template)(**names))


@pytest.mark.parametrize(
    ("template", "text"),
    [
        ("a{{ 1 + 2 * 3 }}{{ 'x' ~ \"y\\n\" }}", "a7xy\n"),
        ("{% set n = 'b' %}{% if n == 'a' %}1{% elif n in 'abc' and not false %}2{% else %}3{% endif %}", "2"),
        ("{% for m in ms %}{{ loop.index }}{{ m.k }}{% if not loop.last %}, {% endif %}{% endfor %}", "1x, 2y"),
        ("{{ ms2.missing }}{{ none }}|{{ ' q ' | trim | upper }}", "|Q"),
    ],
)
def test_language(template, text):
    assert shown(template, ms=iter([{"k": "x"}, {"k": "y"}]), ms2={}) == text


@pytest.mark.parametrize("template", ["{{ m.__class__ }}", "{{ _x }}", "{{ f('x') }}", "{% import os %}", "{{ 'a' * 9 }}", "{{ m | nothing }}", "{% for x in y %}", "{{ 1 + }}", "{{ s.upper }}"])
def test_sandbox(template):
    with pytest.raises(chat.TemplateError):
        shown(template, m={}, s="text")


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 2 %}c{% else %}d{{ 2 * 3 }}{% endif %}{% if x %}e{% endif %}"), chat.FILTERS)
    assert tree[0] == chat.Out(chat.Const("aBd6")) and isinstance(tree[1], chat.If) and len(tree) == 2


@given(st.text(alphabet="<|\\n\nim_endsta>x", max_size=30))
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unline(chat.line(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.line(text)


ROWS = [(1, 0, "system", "a"), (1, 1, "assistant", "b<|im_end|>"), (1, 1, "assistant", "b<|im_end|>"), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "odd\\n\nrole<|", "<\\|x<")]


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_chars", [5, 1 << 16])
def test_odd_rows(spark, part_chars):
    rows = [*ROWS, *((9, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(400))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(df, part_chars=part_chars)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_conversations(formatted).collect()}
    assert got == want(rows)
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0
    assert {r.conv_id for r in chat.read_conversations(chat.format_conversations(chat.with_probe(df.limit(0)))).collect()} == {-1}


def test_query_equals_sql(spark, sf_dir):
    df = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    got = sorted(tuple(r) for r in chat.read_conversations(chat.format_conversations(df)).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert got == sorted(con.execute(chat.SQL).fetchall())


def test_loops_run_over_null_items():
    render = chat.compile_template("{% for x in xs %}[{{ loop.index }}{% if loop.last %}!{% endif %}]{% endfor %}")
    assert "".join(t for t, _ in render(xs=["a", None, "b"])) == "[1][2][3!]"


def test_parts_out_of_order_are_refused(spark):
    turns = spark.createDataFrame([(1, k, "user", "word " * 400) for k in range(20)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(turns, part_chars=1000)
    rows = parts.collect()
    assert len(rows) > 3
    mixed = spark.createDataFrame([rows[0], rows[2], rows[1], *rows[3:]], parts.schema)
    again = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    assert chat.read_conversations(again).collect() == chat.read_conversations(parts).collect()
    with pytest.raises(Exception, match="out of order"):
        chat.read_conversations(mixed.coalesce(1)).collect()
