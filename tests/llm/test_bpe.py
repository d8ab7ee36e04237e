import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausework.llm import bpe

PATH = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    with open(PATH, "rb") as f:
        return bpe.Encoder(f.read()), reference


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()


def test_exact_on_hard_texts(both):
    encoder, reference = both
    texts = ["", " ", "a" * 500, "ab" * 300, "<|endoftext|>", "don't we'll", "\r\n\t  x", "Состав: мука пшеничная, E322", "한국 🍓👩‍🍳", "½ ¼ ™", "x" + " " * 70 + "y", "пе" * 999]
    for t in texts:
        assert ids(encoder, t) == reference.encode(t, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbcdeinorst ERS'\n019.,éёжқ한🍓​"), max_size=60))
def test_exact_on_random_texts(both, text):
    encoder, reference = both
    assert ids(encoder, text) == reference.encode(text, add_special_tokens=False).ids
    assert reference.decode(ids(encoder, text), skip_special_tokens=False) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab ab", "x"), (3, "ab ab", "x"), (4, "слово " * 20000, "x")], "doc_id bigint, text string, ids string")
    got = bpe.encode_texts(df).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got[:2]] == [[], []] and got[2].ids == got[3].ids and len(got) == 5
    assert bpe.encode_texts(df.limit(0)).count() == 0
