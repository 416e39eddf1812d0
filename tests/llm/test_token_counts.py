import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from keyloom.llm import token_counts as tc

TEXTS = ["", " ", "a", "  two  blanks ", "tab\tand\nline", "▁ odd ▁mark", "<s> </s> <unk> <0x0A>", "é" * 40, "x" * 3000, "日本 語 " * 50, "\x00 nul"]


@pytest.fixture(scope="module")
def whole():
    sp = SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))
    return lambda t: len(sp.encode(t))


@pytest.mark.parametrize("piece", [1, 7, 100])
def test_split_counts_add_up(whole, piece):
    count = tc.counter(piece_bytes=piece, batch_bytes=50)
    texts = [*TEXTS, " ".join(TEXTS), " ".join(f"wörd{i} and," for i in range(500))]
    sizes, tokens = count([t.encode() for t in texts])
    assert list(tokens) == [whole(t) for t in texts]
    assert list(sizes) == [len(t.encode()) for t in texts]


def test_rows_of_every_kind(spark, whole):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "a b", None), (3, "long text here " * 9000, "z")]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert [r.n_tokens for r in got] == [0, whole("a b"), whole("a b"), whole("long text here " * 9000)]
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
