import datetime
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from tidemark.llm import pseudonyms
from tidemark.llm.pseudonyms import ANY, date_pseudonym, op5_pseudonyms, permute_characters, permute_number, pseudonym, pseudonymise


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card(rng, n=16):
    body = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def test_permutations_are_one_to_one(spark):
    n = spark.range(400).select(permute_number(F.col("id"), 20, "k", "x").alias("y")).distinct().where("y between 0 and 399").count()
    assert n == 400
    words = spark.range(26 * 100).select(F.concat(F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit("-"), F.chr((F.col("id") / 100).cast("long") + 97)).alias("w"))
    got = [r[0] for r in words.select(permute_characters(F.col("w"), "k", "x")).collect()]
    assert len(set(got)) == 2600 and all(re.fullmatch(r"\d\d-[a-z]", w) for w in got)


def hash_number(*parts, digits=15):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def plain_number(value, side, key, label):
    """The permutation of numbers, written again: halves in turn, each moved by a hash of the other."""
    left, right = divmod(value, side)
    for k in range(1, 9):
        left, right = right, (left + hash_number(key, label, k, right)) % side
    return left * side + right


def plain_characters(text, key, label, alphabets=(string.digits, string.ascii_lowercase, string.ascii_uppercase)):
    def moved(part, other, k):
        out = ""
        for i, c in enumerate(part):
            letters = next((a for a in alphabets if c in a), None)
            out += c if letters is None else letters[(letters.index(c) + hash_number(key, label, k, other, i, digits=12)) % len(letters)]
        return out

    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, 9):
        if k % 2:
            left = moved(left, right, k)
        else:
            right = moved(right, left, k)
    return left + right


def put(template, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in template)


def plain_pseudonym(v, key):
    """What becomes of a valid value, by kind, in plain Python."""
    digits = re.sub(r"\D", "", v)
    if "@" in v:
        name, domain = v.split("@")
        rest, top = domain.rsplit(".", 1)
        return plain_characters(name, key, "name") + "@" + plain_characters(rest, key, "domain") + "." + top
    if re.fullmatch("[0-9a-f]{20,}|[0-9A-F]{20,}", v):
        return plain_characters(v, key, "secret", ("0123456789" + ("abcdef" if re.search("[a-f]", v) else "ABCDEF"),))
    if v.startswith("+"):
        code = re.match(r"\+(?:1|7|[2-9][0-9]?)", v)[0]
        return code + put(v[len(code) :], plain_characters(re.sub(r"\D", "", v[len(code) :]), key, "phone", (string.digits,)))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
        return put(v, plain_characters(digits, key, "national_id", (string.digits,)))
    if re.fullmatch(r"(\d+\.){3}\d+", v):
        a, b, c, d = map(int, v.split("."))
        n = plain_number(((a * 256 + b) * 256 + c) * 256 + d, 1 << 16, key, "machine")
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    if len(digits) >= 13:
        body = plain_characters(digits[:-1], key, "card", (string.digits,))
        return put(v, body + next(str(d) for d in range(10) if luhn(body + str(d))))
    form = "%Y-%m-%d" if "-" in v else "%d.%m.%Y" if "." in v else "%d/%m/%Y"
    first = datetime.date(1850, 1, 1)
    day = first + datetime.timedelta(plain_number((datetime.datetime.strptime(v, form).date() - first).days, 302, key, "date"))
    if form[1] == "Y" or re.match(r"\d\d\D\d\d\D", v):
        return day.strftime(form)
    return f"{day.day}{form[2]}{day.month}{form[2]}{day.year}"


def test_values_against_a_plain_permutation(spark):
    rng = random.Random(12)
    values = [*VALID, card(rng), card(rng, 15), card(rng, 19), "+49 30 1234 5678", "8.8.4.4", "FFFF0000FFFF0000FFFF1", "09/11/2001", "1999-12-31", "x@y.co"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonym(F.col("v"), "some key").alias("p")).collect()
    for r in got:
        assert r.p == plain_pseudonym(r.v, "some key"), r


def test_a_key_is_needed(spark):
    for key in ("", None):
        try:
            pseudonymise(spark.range(1).withColumn("text", F.lit("x")), key)
            raise AssertionError("no key was taken")
        except ValueError:
            pass


def test_dates_stay_dates_and_differ(spark):
    days = spark.range(0, 302 * 302, 7).select(F.date_format(F.date_add(F.lit("1850-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    got = [r[0] for r in days.select(date_pseudonym(F.col("d"), "k")).collect()]
    assert len(set(got)) == len(got) and all(datetime.date.fromisoformat(d) for d in got)


VALID = {
    "a.b@mail.example.com": r"[a-z]\.[a-z]@[a-z]{4}\.[a-z]{7}\.com", "Joe.19@x-y.org": r"[A-Z][a-z]{2}\.\d{2}@[a-z]-[a-z]\.org", "+1 (743) 555-3824": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "152.143.123.131": r"(\d+\.){3}\d+", "2321bac4d15ec8f90433955bf9d3cf61da5bdd00": "[0-9a-f]{40}", "9233A8ECF7C5B09FE594": "[0-9A-F]{20}", "123-45-6789": r"\d{3}-\d\d-\d{4}", "2024-02-29": r"\d{4}-\d\d-\d\d",
    "01.02.1999": r"\d\d\.\d\d\.\d{4}", "3/4/2001": r"\d+/\d+/\d{4}", "4111 1111 1111 1111": r"(\d{4} ){3}\d{4}",
}
INVALID = ["4111111111111112", "2023-02-29", "999.1.1.1", "31.04.2001", "000-12-3456", "1.2.3.4.5", "x4111111111111111", "", "no value", "1234", "0000000000000000", "3000-01-01"]


def test_values(spark):
    frame = spark.createDataFrame([(v,) for v in [*VALID, *INVALID]], "v string").select("v", pseudonym(F.col("v"), "k").alias("p"), pseudonym(F.col("v"), "other").alias("q"))
    rows = {r.v: r for r in frame.collect()}
    for v, form in VALID.items():
        assert re.fullmatch(form, rows[v].p), (v, rows[v].p)
        assert rows[v].p != v and rows[v].q != rows[v].p
    assert luhn(re.sub(r"\D", "", rows["4111 1111 1111 1111"].p))
    assert all(int(o) < 256 for o in rows["152.143.123.131"].p.split("."))
    for v in INVALID:
        assert rows[v].p == v


def test_texts_against_brute_force(spark):
    rng = random.Random(3)
    values = [*VALID, *INVALID, card(rng), card(rng, 15), "12 " + card(rng), "a\x02b", "\x02", "\x02~", "\x02|", "$1 \\ x"]
    texts = [None, "", "plain", f"{card(rng)} {card(rng)}", "9" * 50_000]
    for _ in range(80):
        texts.append(rng.choice(["", " ", "\n"]).join(f"{rng.choice(['', ' ', ', ', chr(34), '(', 'é'])}{rng.choice(values)}{rng.choice(['', '.', ' ', ')', '!!', 'ß'])}" for _ in range(rng.randint(0, 6))))
    docs = spark.createDataFrame([(i, t, "x", "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, n_dates string, __values string, __new string").repartition(3)
    found = [re.findall(f"({ANY})", t or "") for t in texts]
    every = sorted({v for f in found for v in f})
    new = {r.v: r.p for r in spark.createDataFrame([(v,) for v in every], "v string").select("v", pseudonym(F.col("v"), "k").alias("p")).collect()}
    got = {r.doc_id: r for r in pseudonymise(docs, "k").collect()}
    assert all(r["__values"] == "a" and r["__new"] == "b" for r in got.values())
    for i, text in enumerate(texts):
        assert got[i].text == (None if text is None else re.sub(f"({ANY})", lambda m: new[m[0]], text)), text
        assert got[i].n_values == sum(new[v] != v for v in found[i])
    assert pseudonymise(docs.limit(0), "k").count() == 0


def test_query_leaves_clean_texts_alone(spark, data_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = op5_pseudonyms(spark, data_dir).collect()
    assert {r.doc_id for r in got} == set(before)
    assert all((r.text == before[r.doc_id]) == (r.n_values == 0) for r in got)
    assert any(r.n_numbers for r in got)


def test_the_query_keeps_one_key_and_shows_none(spark, data_dir):
    rows = lambda: sorted(tuple(r) for r in pseudonyms.op5_pseudonyms(spark, data_dir).collect())
    first = rows()
    key = pseudonyms.stored_key(spark)
    assert first == rows() and key == pseudonyms.stored_key(spark) and key.startswith(pseudonyms.KEY_FORM)
    frame = pseudonyms.op5_pseudonyms(spark, data_dir)
    assert key not in frame._jdf.queryExecution().toString() and key not in frame._jdf.queryExecution().simpleString()
    spark.conf.set(pseudonyms.KEY_SETTING, "another")
    try:
        assert pseudonyms.stored_key(spark) == "another" and rows() != first
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
