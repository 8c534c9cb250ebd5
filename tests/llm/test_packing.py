"""Ids of words that are encoded together."""

import numpy as np
import pyarrow as pa
import public_tokenizers

from pricelake.llm import arrays as A, packing as P

ODD = [
    "", None, "a<|endoftext|>b c <|endoftext|> d", " lead  two  ", "tab\tx\n\n y é è  z", "x\x00 y", "中文 字 é a",
    "end ", "\n", "é é é", "it's  'll don't x  y", "one two three four five", " é- –x – y",
]


def test_new_words_of_a_chunk_are_encoded_by_few_calls():
    tokens = P.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    encode, calls = tokens.encode, []
    tokens.encode = lambda text: calls.append(text) or encode(text)
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(20)]
    ids, at = tokens.ids(*A.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encode(t) for t in texts]
    # the first word of each text has no white space before it, the last one is followed by a text
    assert len(calls) <= 1 + 2 * len(texts)


def test_ids_are_those_of_whole_texts():
    tokens = P.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    ids, at = tokens.ids(*A.text_bytes(pa.array(ODD)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokens.word_ids(t or "") for t in ODD]
    again = tokens.ids(*A.text_bytes(pa.array(ODD)))
    assert np.array_equal(ids, again[0]) and np.array_equal(at, again[1])
