"""Double-byte text is decoded by expressions, as the codec does."""

import random

from pyspark.sql import functions as F

from folio.sources import files


def test_as_the_codec(spark):
    rng = random.Random(3)
    every = [bytes((a, b)) for a in range(256) for b in range(256)]
    cases = [b"", b"plain", "中文 test 漢字。".encode("gbk"), b"\x80", b"\xff\xff", b"\x81", b"a\x81", b"\x81 a", b"\xa1\xa1\xa1", "é".encode(), b"\x00\xd6\xd0\x0a", "中".encode("gbk") * 50_000 + b"\xff"]
    cases += [b"x".join(every[i : i + 256]) for i in range(0, 65_536, 256)]
    cases += [bytes(rng.choice((rng.randrange(256), rng.randrange(0x81, 0xFF), rng.randrange(32, 127))) for _ in range(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, raw binary")
    got = {r["i"]: (r["t"], r["d"]) for r in df.select("i", files.decode_gbk(F.col("raw")).alias("t"), files.decoded(F.col("raw")).alias("d")).collect()}
    for i, c in enumerate(cases):
        assert got[i][0] == c.decode("gbk", "replace"), c[:50]
        try:
            want = c.decode()
        except UnicodeDecodeError:
            want = c.decode("gbk", "replace")
        assert got[i][1] == want
    assert spark.createDataFrame([(None,)], "raw binary").select(files.decoded(F.col("raw"))).first()[0] is None


def test_no_python_in_the_plan(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("中".encode("gbk"))
    (tmp_path / "b.md").write_bytes("中".encode())
    df = files.scan(spark, str(tmp_path), "export")
    assert {r["content"] for r in df.collect()} == {"中"}
    assert "Python" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
