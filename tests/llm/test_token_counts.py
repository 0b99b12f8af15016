import json

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.common import tokenizer_path
from tidemark.llm.token_counts import TokenCounter, count_tokens, op1_token_counts

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH) as _f:
    COUNTER = TokenCounter(json.load(_f))

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "it's we're I'LL", "x<|endoftext|>y z", "<|endoftext|><|endoftext|>",
    "naïve café — ½ ² Ⅷ", " x 　y ", "a\x1cb \x1c c", "é ́", "日本語テキスト 12345", "🙂🙂 ok", "\r\n\t\x0b\x0c", "a" * 5000, "ab" * 3000 + " cd",
]


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_odd_texts():
    for text in ODD:
        assert COUNTER.count(text) == expected(text), repr(text)
    assert COUNTER.count(None) == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdlmtrevabcXYZ019.,!é日 　<|>")), st.characters(blacklist_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF)), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == expected(text)


def test_small_bound_changes_nothing():
    with open(PATH) as f:
        tight = TokenCounter(json.load(f), bound=2)
    text = "the quick brown fox jumps over the lazy dog, the end of the tale"
    assert tight.count(text) == expected(text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", 9), (None, "x", 9), (2, None, 9), (2, "", 9), (1, "hello world", 9)], "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(docs).collect())
    assert got == [(-1, 1, 1), (1, 11, 2), (1, 11, 2), (2, 0, 0), (2, 0, 0)]
    assert count_tokens(docs.limit(0)).count() == 0


def test_query_equals_library(spark, data_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_token_counts(spark, data_dir).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        assert (got[k].n_bytes, got[k].n_tokens) == (len((text or "").encode()), expected(text or ""))
        assert got[k].over_limit == (got[k].n_tokens > 512)
