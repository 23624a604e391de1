"""Sampled pieces next to a lattice that is built from the model file alone."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridsift.llm import catalog, pieces


@pytest.fixture(scope="module")
def weights():
    """Weight and id of each piece of the model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer("piece_bpe_32k.model"))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {model.id_to_piece(i): (1 / (1 + i), i) for i in plain}


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(catalog.tokenizer("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["a    b", "   x", "a  ", "a  b   c", "        re"])
def test_runs_of_spaces_are_sampled_from_the_whole_lattice(lattice, weights, text):
    whole, shares = "▁" + text.replace(" ", "▁"), {}

    def walk(at, way, weight):
        if at == len(whole):
            shares[way] = weight
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in weights:
                w, i = weights[whole[at:end]]
                walk(end, (*way, i), weight * w)

    walk(0, (), 1.0)
    n, total = 20000, sum(shares.values())
    ids, counts = lattice.encode(pa.array([text] * n), np.arange(n))
    found = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(found) <= set(shares)
    for way, w in shares.items():
        p = w / total
        assert abs(found[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_all_pieces_of_marks_are_drawn(lattice, weights):
    runs = {x: i for x, (_, i) in weights.items() if set(x) == {"▁"} and len(x) > 1}
    assert len(runs) == 14
    texts = [" " * (len(x) - 1) for x in runs] + ["def f():\n        return 1", " " * 300 + "x  y"]
    n = 300
    ids, counts = lattice.encode(pa.array(texts * n), np.repeat(np.arange(n), len(texts)))
    assert set(runs.values()) <= set(ids.tolist())
    data, edges = lattice.decode(ids, counts)
    assert [data[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)] == texts * n
