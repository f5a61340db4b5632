import duckdb
import pytest

from shelfmark.llm import chat
from shelfmark.llm.oracle import OP2
from shelfmark.llm.queries import op2_chat_format

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|end|> there"), (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", "second"), (2, 0, "user", None), (2, 1, "assistant", "a tie"), (2, 1, "assistant", "a tie"),
    (3, None, None, "no role\nand no turn"), (None, 0, "user", "no conversation"), (None, 1, "assistant", ""),
    (4, 0, "assistant", "<\\/s> <\\\\|end|> [\\INST] ẞ😀"), (5, 0, "user<|text|>x\n", "odd role"),
]
KIND = "conv_id long, turn long, role string, text string"


def test_escape_is_reversible():
    for text in ("</s>", "<\\/s>", "<\\\\/s>", "<<SYS>>", "a<|end|>b<|end|>", "< /s>", "[[INST]]", "\\"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 AS n", "'x' AS spans").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(OP2)
    names = [d[0] for d in expected.description]
    got = op2_chat_format(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], KIND)).count() == 0


def test_rewritten_history_is_seen():
    def forgetful(turns):  # shows the text of the last turn only
        return "".join(f"<{r}>{t if k == len(turns) - 1 else '...'};" for k, (r, t) in enumerate(turns))

    text, spans, rewritten = chat.locate(forgetful, [("u", "hello"), ("a", "world"), ("u", "again")])
    assert text == "<u>...;<a>...;<u>again;" and rewritten == 2
    assert spans[:2] == [None, None] and text[spans[2][1]:spans[2][2]] == "again"


@pytest.mark.parametrize("text", ["", "|", "<|end|>", "end|>\n", "a"])
def test_text_borders_do_not_depend_on_the_text(text):
    t = chat.MarkedTemplate()
    out, spans, _ = chat.locate(t, [("user", "q"), ("assistant", text)])
    assert t.plain(out[spans[1][1]:spans[1][2]]) == text and t.role(out[spans[1][0]:spans[1][1]]) == "assistant"
