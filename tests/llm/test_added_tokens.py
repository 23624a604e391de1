"""Texts that hold the text of an added token, next to the library."""

import numpy as np
import pyarrow as pa

from gridsift.llm import catalog, token_files
from tests.llm.helpers import TEXTS


def test_added_tokens_encode_as_in_the_library():
    from tokenizers import Tokenizer

    path = catalog.tokenizer("word_bpe_49k.json")
    texts = [
        "J̌ ǰ J̌. İ i̇ ab., a.b, 1,2. it's, DON'T. ﬁ, ́x .́ a B. <|endoftext|> a<|endoftext|>.",
        "<|endoftext|>", "<|startoftext|>Ab. x", "A<|endoftext|>B.", "<|ENDOFTEXT|> <|EndOfText|>. <|endoftext|>,", "é<|endoftext|>É.",
        "a <|endof", "text|> b", "<|endoftext|><|endoftext|>Z, < |endoftext|> <|endoftext|", "<|Other|> X.", "<|endoftext", "|>", *TEXTS,
    ]
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = token_files.Encoder(path)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert want[1] == [49407] and 49406 in want[2]
