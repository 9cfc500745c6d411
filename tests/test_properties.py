"""Property tests (hypothesis): cipher round trips, path parsing, sizing formula."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeforge.functions.cipher import PKCS5, RC2Params, decrypt_values, encrypt_values, expand_key

KEY = RC2Params(b"prop-key", b"\x01\x02\x03\x04\x05\x06\x07\x08")
K = expand_key(KEY.key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80).filter(lambda s: not s.endswith("\0")), max_size=30),
       st.sampled_from([("CBC", None), ("CBC", PKCS5), ("ECB", None), ("ECB", PKCS5)]))
def test_cipher_round_trip(texts, opts):
    p = RC2Params(KEY.key, KEY.iv if opts[0] == "CBC" else None, opts[0], opts[1])
    data = [t.encode("utf-8") for t in texts]
    enc = encrypt_values(data, K, p)
    dec = decrypt_values(enc, K, p)
    for d, e, v in zip(data, enc, dec):
        assert len(e) == (8 * (len(d) // 8 + 1) if opts[1] else 8 * -(-len(d) // 8))
        assert (v if opts[1] else v.rstrip(b"\0")) == d


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20))
def test_batch_equals_one_by_one(values):
    batch = encrypt_values(values, K, KEY)
    assert batch == [encrypt_values([v], K, KEY)[0] for v in values]


_seg = st.sampled_from(["a", "b1", "P_12345", "2021", "04", "x_9", "2020/01/02", "P_1"])
_path = st.lists(_seg, min_size=1, max_size=8).map(lambda parts: "/" + "/".join(parts) + "/f.csv")


@settings(max_examples=40, deadline=None)
@given(st.lists(_path, min_size=1, max_size=20))
def test_path_parts_match_python(spark, paths):
    from lakeforge.functions.paths import file_date, file_name

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r) for r in df.select(file_name("path"), file_date("path")).collect()]
    want = [(re.sub(r".*[0-9]{4}/[0-9]{2}/[0-9]{2}/", "", p), re.sub(r"P_[0-9]{5}|[^0-9]", "", p)[:8]) for p in paths]
    assert got == want
    again = [tuple(r) for r in df.select(file_name(file_name("path"))).collect()]
    assert again == [(w[0],) for w in want]


@settings(max_examples=20, deadline=None)
@given(st.integers(min_value=0, max_value=5000), st.integers(min_value=1, max_value=2000))
def test_partition_count_formula(spark, n, rows):
    from lakeforge.sources.tables import partition_count_frame

    got = partition_count_frame(spark.range(n), "t", rows).first()
    assert (got.row_count, got.partitions) == (n, 1 + n // rows)
