import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows_of, sql_rows

from tidemark.llm.chat_format import ORACLES, Conversation, digests, format_conversations, op9_chat_format, read_back, unescape

HARD = st.lists(st.sampled_from(["\\", "<", "</turn>", "<turn>", "<part ", ">", "\n", "a", "é", "", "</turn>\n<turn>assistant\n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), HARD), HARD), max_size=5))
def test_reading_back_is_exact(turns):
    c = Conversation(frozenset({"assistant"}))
    for k, (role, text) in enumerate(turns):
        c.add(k, role, [{"kind": "text", "text": text}])
    row = c.row(1)
    assert read_back(row["formatted"]) == turns
    loss = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"])
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_parts(spark):
    rows = spark.sql("""
        SELECT 1L conv_id, 1 turn, 'user' role, 'ignored' text, array(
            named_struct('kind', 'text', 'text', 'see <part image=9>', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
            named_struct('kind', 'image', 'text', null, 'ref', 's3://a.png', 'width', 57, 'height', 28, 'seconds', null, 'pages', null),
            named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 1.5D, 'pages', null),
            named_struct('kind', 'document', 'text', null, 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', 2)) parts
        UNION ALL SELECT 1L, 2, 'assistant', 'fine words', null UNION ALL SELECT 1L, null, null, null, null UNION ALL SELECT null, 1, 'user', 'x', array()
    """)
    got = {r.conv_id: r for r in format_conversations(rows, parts_col="parts").collect()}
    assert got[1].n_turns == 3 and got[None].formatted == "<turn>user\n</turn>\n"
    assert got[1].formatted == "<turn>\n</turn>\n<turn>user\nsee \\<part image=9><part image=0><part audio=1><part document=2></turn>\n<turn>assistant\nfine words</turn>\n"
    assert [(a.kind, a.ref, a.tokens, a.number) for a in got[1].attachments] == [("image", "s3://a.png", 3, 0), ("audio", "b.wav", 38, 1), ("document", None, 512, 2)]
    assert got[1].n_tokens == 3 + 3 + 38 + 512 + 2
    assert format_conversations(rows.limit(0)).count() == 0


def test_rows_and_order(spark):
    rows = [(5, 2, "assistant", "b"), (5, 1, "user", "a"), (5, 2, "assistant", "b"), (6, 1, "assistant", None), (6, 2, "user", "z" * 100_000)]
    got = {r.conv_id: r for r in digests(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[5].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[5].loss_chars, got[6].loss_chars, got[6].formatted_chars) == (2, 0, 13 + 2 * 15 + 100_000)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = op9_chat_format(spark, d)
    assert rows_of(got) == sql_rows(ORACLES["op9_chat_format"], d)
    assert got.where("conv_id = -7").first().n_turns == 2
