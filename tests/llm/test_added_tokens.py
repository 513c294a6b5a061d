import pytest

from sigspark.llm import packing
from sigspark.llm.queries import tokenizer_file


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "a<|startoftext|>b", "<|EndOfText|>", "é <|endoftext|><|endoftext|>", "<| endoftext |>", "plain words"])
def test_ids_of_added_tokens_are_the_tokenizers(text):
    words = packing._Words.of(tokenizer_file())
    assert words.by_word
    assert words.ids(text)[:-1].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
