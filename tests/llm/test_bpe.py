import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from claimworks.llm import bpe

ENC = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x1c\xa0ab'sé9漢🙂.", max_size=200), st.integers(1, 20))
def test_parts_equal_whole(text, size):
    assert bpe.encode_text(ENC, text, size).tolist() == ENC.encode_ordinary(text)


def test_query_shapes(spark):
    long = "word " * 60_000 + "x" * 3000
    rows = [(1, "Hello world", 7), (2, None, 7), (3, "", 7), (4, long, 7), (1, "Hello world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.encode(df, decoded=True).collect()
    assert len(out) == 5
    for r in out:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw
        assert np.frombuffer(r.ids, "<u4").tolist() == ENC.encode_ordinary(r.text or "")
    back = bpe.decode(bpe.encode(df)).where("doc_id = 4").first()
    assert hashlib.sha256(back.decoded).digest() == hashlib.sha256(long.encode()).digest()
    assert bpe.encode(df.where("false")).count() == 0
