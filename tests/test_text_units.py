"""Texts with characters beyond the basic plane are measured in units of UTF-16."""

from pyspark.sql import functions as F

from tidemark.functions import text as T


def units(s):
    b = s.encode("utf-16-le", "surrogatepass")
    return [b[k] + 256 * b[k + 1] for k in range(0, len(b), 2)]


def fingerprint(role, content):
    h = 5381
    for u in units(role + ":") + units(content)[:200]:
        h = (h * 33 + u + 2**31) % 2**32 - 2**31
    return h


def test_units_lengths_and_fingerprints(spark):
    texts = ["", "plain", "a🙂b", "🙂" * 150, "x" * 199 + "🙂", "x" * 198 + "🙂🙂", "日本🚀", "é\n🙂", "a" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.utf16_length(F.col("t")).alias("n"), T.utf16_units(F.col("t")).alias("u"), T.fingerprint(F.lit("user"), F.col("t")).alias("f"), T.quick_tokens(F.col("t")).alias("q")).collect()
    for r in rows:
        assert r.n == len(units(r.t)) and r.u == units(r.t) and r.f == fingerprint("user", r.t)
    assert {r.t: r.q for r in rows if r.t in ("a🙂b", "日本🚀", "")} == {"a🙂b": 1, "日本🚀": 4, "": 0}
