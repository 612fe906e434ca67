"""Fill-in-the-middle: round trips; the whole query also against SQL in tests/test_queries.py."""

import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.llm import infill
from tests.llm.helpers import empty_documents, odd_documents

PIECES = st.lists(st.sampled_from(["\n", "a", "é", "😀", "<", "<P", "S>", ">", "<M", " ", "\r\n", "word"]), max_size=40).map("".join)
DRAWS = st.tuples(*[st.integers(0, (1 << 32) - 1)] * 4)


def slow(text, draws, rate=100, suffix_first=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    i, j = sorted(d % (len(lines) + 1) for d in draws[:2])
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    if not text or re.search("<[PSM]>", text) or draws[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if draws[3] % 100 < suffix_first:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(PIECES, DRAWS, st.integers(0, 100))
def test_forms_and_round_trip(text, draws, rate):
    data = bytearray(text.encode())
    found = infill.encode(data, draws, rate, 50)
    assert (*found, data.decode()) == slow(text, draws, rate)
    infill.decode(data, found[1])
    assert data.decode() == text


@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 60), st.integers(1, 9))
def test_rotation_of_any_step(data, a, b, c, step):
    i, j, k = sorted(min(x, len(data)) for x in (a, b, c))
    kept, infill.STEP = infill.STEP, step
    try:
        turned = bytearray(data)
        infill.rotate(turned, i, j, k)
    finally:
        infill.STEP = kept
    assert bytes(turned) == data[:i] + data[j:k] + data[i:j] + data[k:]


def test_long_text():
    text = "".join(f"line {i} é\n" for i in range(300_000))
    data = bytearray(text.encode())
    found = infill.encode(data, (123_457, 7, 0, 0), 100, 50)
    assert (*found, data.decode()) == slow(text, (123_457, 7, 0, 0))
    infill.decode(data, found[1])
    assert data.decode() == text


def test_odd_rows(spark):
    odd = odd_documents(spark).withColumn("output", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("n", F.lit(None))
    done = infill.transform(odd)
    assert done.columns == [c for c in odd.columns if c not in ("output", "n")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = infill.restore(done).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(text, infill.draws(7, r.doc_id)) and r.restored == text
    assert {r.form for r in infill.transform(odd, rate=0).collect()} == {"plain"}
    assert infill.digests(empty_documents(spark)).count() == 0
    assert infill.restore(spark.createDataFrame([(None, None)], "output string, form string")).first().restored is None
