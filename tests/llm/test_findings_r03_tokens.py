"""Finding of round 3 on op9_token_output: CPU seconds."""

import public_tokenizers

from quadrille.llm import token_output


def test_known_words_are_not_encoded_again_with_marks():
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, plain = [], e.tokenize
    e.tokenize = lambda letters: asked.append(letters) or plain(letters)
    texts = ["a word", "a word, (word) a.", " Été, naïve! a\x1cb", "x<|y  z", ""]
    for text in texts:
        assert e.encode(text) == e._whole(text)
    assert len(asked) == len(set(asked))
