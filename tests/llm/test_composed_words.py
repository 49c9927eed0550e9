import numpy as np
import pytest

from cupola.llm import tokenfile


@pytest.mark.parametrize("text", ["H̱ T̈ W̊ Y̊ J̌", "XH̱y, T̈. end", "École été ABC", "plain Words ́ À́", "J̌ J J̌"])
def test_decomposed_capitals_match_the_library(text):
    encoder = tokenfile.WordEncoder()
    for t in (text.lower(), text, text):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
