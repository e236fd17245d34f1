import os

import pytest

from tabulon.errors import EngineError
from tabulon.llm.tokens import TOKENIZER, count_tokens

needs = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


@needs
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(rows, name):
    t = rows([(1, "hello world", 9), (2, None, 9), (3, "", 9), (4, "<|endoftext|> é样本", 9), (5, "hello world", 9)], "id long, text string, tokens int")
    got = count_tokens(t, "text", tokenizer=os.path.join(os.path.dirname(TOKENIZER), name))
    assert got.columns == ["id", "tokens", "tokens_1"]
    n = {r["id"]: r["tokens_1"] for r in got.collect()}
    assert n[1] == n[5] and 2 <= n[1] <= 3 and n[2] is None and n[3] == 0 and n[4] > 5


@needs
def test_two_libraries_agree(rows):
    t = rows([(i, x) for i, x in enumerate(["It’s  a\n\ntest 123,45", "Größe – ça", "第 1 号", " " * 50 + "x" * 2000])], "id long, text string")
    a, b = (count_tokens(t, "text", tokenizer=os.path.join(os.path.dirname(TOKENIZER), f"byte_bpe_50k.{k}")).orderBy("id").collect() for k in ("tiktoken", "json"))
    assert a == b


def test_missing_file(rows):
    with pytest.raises(EngineError):
        count_tokens(rows([(1, "x")], "id long, text string"), "text", tokenizer="/nowhere.json")
