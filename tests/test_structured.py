"""Caption texts inside documents, and times of frames, against plain forms."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import structured as S


def test_caption_texts_of_documents(spark):
    docs = ['{"Caption": " a  b ", "name": "x  y", "n": [1, null, "z  z"], "segments": [{"text": "t  t", "id": "i  i"}, {"text": ["u  u", {"speech_content": "s  s", "other": "o  o"}]}]}', '["l  l", {"k": "v  v"}]', '"said  so"', "no  json", None, "5", '{"text": null}', '{"a": {"summary": "é  é"}}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = {r["i"]: r["d"] for r in S.finalized_documents(df, ["i"], "d", lambda c: X.collapse(c)).collect()}
    assert len(got) == len(docs)
    first = json.loads(got[0])
    assert first == {"Caption": "a b", "name": "x  y", "n": [1, None, "z  z"], "segments": [{"text": "t t", "id": "i  i"}, {"text": ["u u", {"speech_content": "s s", "other": "o  o"}]}]}
    assert [got[i] for i in range(1, 8)] == ['["l l",{"k":"v  v"}]', '"said so"', "no json", None, "5", '{"text":null}', '{"a":{"summary":"é é"}}']


def plain_times(a, z, duration, fps, frames, strategy, target, count, most, least, factor):
    least = max(2 if strategy == "adaptive" else 1, least)
    begin = max(0.0, a or 0.0)
    end = z if z is not None else duration
    if duration is not None and end is not None:
        end = min(end, duration)
    if end is None and frames and fps:
        end = begin + frames / fps
    if end is None or end <= begin:
        return None

    def rounded(n):
        n = max(least, n)
        if factor and factor > 1:
            n = max(factor, round(n / factor) * factor)
        if most is not None:
            cap = most // factor * factor if factor and 1 < factor <= most else max(1, most)
            n = min(n, cap)
        return max(1, n)

    last = max(begin, end - (0.5 / fps if fps else 1e-6))
    if strategy == "uniform":
        given = count if count is not None else most
        return None if given is None else np.linspace(begin, last, rounded(given)).tolist()
    n = max(least, math.ceil((end - begin) * (target or fps or 1.0)))
    n = min(n, max(1, count)) if count is not None else n
    return np.linspace(begin, last, rounded(n)).tolist()


@pytest.mark.parametrize("strategy", ["uniform", "fps", "adaptive"])
def test_times_of_frames(spark, strategy):
    rows = [(i, a, z, d, f, n) for i, (a, z, d, f, n) in enumerate([(None, None, 10.0, 24.0, 240), (1.0, 4.5, 10.0, 24.0, None), (0.0, 99.0, 3.0, 0.0, 0), (2.0, None, None, 10.0, 35), (5.0, 4.0, 10.0, 24.0, 1), (None, None, None, None, None), (-3.0, 0.01, None, 30.0, None)])]
    df = spark.createDataFrame(rows, "i int, a double, z double, d double, f double, n int")
    for target, count, most, least, factor in ((None, None, 8, 1, None), (2.0, 7, 16, 4, 2), (1.5, None, None, 1, 4), (None, 1, 5, 1, None)):
        got = {r["i"]: r["t"] for r in df.select("i", S.wanted_times("a", "z", "d", "f", "n", strategy=strategy, target_fps=target, count=count, most=most, least=least, factor=factor).alias("t")).collect()}
        for i, a, z, d, f, n in rows:
            want = plain_times(a, z, d, f, n, strategy, target, count, most, least, factor)
            assert (got[i] is None) == (want is None), (i, strategy, target)
            assert want is None or (len(want) == len(got[i]) and np.allclose(want, got[i])), (i, strategy)
    with pytest.raises(ValueError):
        S.wanted_times("a", "z", "d", "f", "n", strategy="other")
    assert df.select(S.wanted_times("a", "z", "d", "f", "n", strategy="keyframe").alias("t")).filter(F.col("t").isNotNull()).count() == 0
