"""The encoder against the tokenizers library, set up as the README of the vocabularies says."""

import public_tokenizers
from tokenizers import Tokenizer

from bookweave.llm.packing import encoder


def test_ids_are_those_of_tokenizers():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("<|endoftext|> a", "x<|endoftext|>", "Two  words\n\n", "漢字 é 🙂 it's 12 345", ""):
        assert encoder().encode_to_numpy(text, disallowed_special=()).tolist() == other.encode(text, add_special_tokens=False).ids
