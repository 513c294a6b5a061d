import pytest

from sigspark.llm import pii


@pytest.mark.parametrize("cue", ["customer id: ", "Customer ID: ", "User ID: ", "user Id=", "API key: ", "API Key=", "apiKey: ", "Api_Key=", "PassWord: "])
def test_cues_in_any_spelling(cue):
    text = f"İ ſ K Ünï {cue}ab12345678 and more"
    assert [text[a:b] for a, b in pii.spans(text, pii._automaton())["account"]] == ["ab12345678"]


def test_long_values():
    value = "a1b2" * 400
    text = f"token: {value} end"
    assert [text[a:b] for a, b in pii.spans(text, pii._automaton())["account"]] == [value]
