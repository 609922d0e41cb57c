import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import token_blocks as tb
from pagewright.llm.encoding import Encoder

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000))
def test_blocks_round_trip(ids):
    a = np.asarray(ids, np.uint32)
    assert tb.unpack_blocks(tb.pack_blocks(a)).tolist() == ids if ids else tb.pack_blocks(a) == []


@pytest.mark.parametrize("ids", [[7] * 1024, [0] * 1025, [2**32 - 1] * 3, list(range(5000)), [5] * 1000 + [2**32 - 1] * 24, [0] * 50 + [2**32 - 1] * 974])
def test_blocks_of_extreme_widths(ids):
    assert tb.unpack_blocks(tb.pack_blocks(np.asarray(ids, np.uint32))).tolist() == ids


def test_file_round_trip():
    out = io.BytesIO()
    w = tb.BlockWriter(out)
    docs = [(None, b""), (-5, np.arange(3000, dtype="<u4").tobytes()), (9, b"\1\0\0\0"), (9, b"")]
    for d in docs:
        w.add(*d)
    assert w.close() == (4, 3001)
    got = list(tb.read_blocks(out, len(out.getvalue())))
    assert [(a, c) for a, _, c in got] == docs and [b for _, b, _ in got] == [0, 0, 3000, 3001]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAé漢 \n\t.,!'5|$ 　\x1c")), max_size=40))
def test_encoding_is_the_library_s(text):
    e = test_encoding_is_the_library_s.__dict__.setdefault("e", Encoder(P.path("byte_bpe_50k.json"), 50))
    want = e._tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode([text, None])[0], "<u4").tolist() == want


def test_documents(spark):
    long = "word " * 30000 + "\n\n  end"
    rows = [(3, "b c"), (1, None), (2, ""), (None, "x"), (3, "a <|endoftext|> c"), (7, long), (5, "b c")]
    df = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, ids string")
    files = tb.write_token_blocks(df, tb.work_path(spark, "t"), P.path("byte_bpe_50k.json"))
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tb.read_token_blocks(files).collect()]
    t = Encoder(P.path("byte_bpe_50k.json"))._tokenizer
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    none = tb.write_token_blocks(df.limit(0), tb.work_path(spark, "t"), P.path("byte_bpe_50k.json"))
    assert tb.read_token_blocks(none).count() == 0
