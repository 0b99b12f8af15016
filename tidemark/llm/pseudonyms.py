"""PII: format-preserving pseudonyms by keyed Feistel permutation, in DataFrame functions only.

Candidates are found by pattern and then validated: card numbers by their check digit, calendar dates
by the calendar, telephone numbers, addresses of machines and of mail, and secrets by their form. A
value is permuted within its own format, so the pseudonym of a card number is a card number with a right
check digit and a date stays a date, and equal values get equal pseudonyms in all documents: nothing
is looked up or shuffled.

The permutation splits a string of digits (or characters of one class each) in two and lets each half
shift the other by a keyed hash, `ROUNDS` times. Dates are numbered within a square number of days, which
splits the same way.
"""

from __future__ import annotations

import re
import secrets
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.sources.folders import shared_root

ROUNDS = 8
#: A control character that marks places while a text is put together again.
MARK = "\x02"
#: The setting of a session that holds the key of `op5_pseudonyms`.
KEY_SETTING = "spark.tidemark.pseudonyms.key"
#: How a key that is made here begins, and the setting that hides what matches it in shown plans.
KEY_FORM, REDACTION = "tidemark-key-", "spark.sql.redaction.string.regex"
#: Days that dates are permuted among: a square number of them from 1850-01-01 on, so that no walking is needed.
FIRST_DAY, DAY_SIDE = "1850-01-01", 302

CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{1,7}|(?:[0-9]{4}-){3}[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])"
)
PHONE = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])"
NATIONAL_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DATE = r"(?<![0-9A-Za-z./-])(?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9]\.[01]?[0-9]\.[12][0-9]{3}|[0-3]?[0-9]/[01]?[0-9]/[12][0-9]{3})(?![0-9A-Za-z/-]|\.[0-9])"
MACHINE = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
MAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z][0-9A-Za-z._%+-]*@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*\.[A-Za-z]{2,}(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{20,128}|[0-9A-F]{20,128})(?![0-9A-Za-z])"
#: In the order in which a place is taken.
KINDS = {"mail": MAIL, "secret": SECRET, "card": CARD, "national_id": NATIONAL_ID, "phone": PHONE, "date": DATE, "machine": MACHINE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def round_hash(key: str, label: str, step: Column, other: Column) -> Column:
    """A number from 0 below 2 ** 60 that depends on the key, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), step.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(value: Column, side: int, key: str, label: str) -> Column:
    """A keyed permutation of the numbers from 0 below side * side."""
    start = F.struct((value / side).cast("long").alias("l"), (value % side).cast("long").alias("r"))
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    end = F.aggregate(
        steps, start, lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + round_hash(key, label, k, s["r"]), F.lit(side).cast("long")).alias("r"))
    )
    return end["l"] * side + end["r"]


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for letters in alphabets:
        at, n = F.instr(F.lit(letters), c), len(letters)
        out = F.when((c != "") & (at > 0), F.substring(F.lit(letters), (F.pmod(at - 1 + by, F.lit(n)) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def permute_characters(text: Column, key: str, label: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A keyed permutation of strings that keeps each character's class; signs stay where they are."""

    def shifted(part: Column, other: Column, step: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(label), step.cast("string"), other)

        def one(c: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)
            return _shift(c, F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), alphabets)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))

    def turn(s: Column, k: Column) -> Column:
        left = F.when(k % 2 == 1, shifted(s["l"], s["r"], k)).otherwise(s["l"])
        right = F.when(k % 2 == 0, shifted(s["r"], s["l"], k)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    end = F.aggregate(steps, start, turn)
    return F.concat(end["l"], end["r"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def check_sum(digits: Column) -> Column:
    """The sum by which card numbers are checked: every second digit from the right doubled, digits of doubles added."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    weighed = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b)


def is_card(text: Column) -> Column:
    return (F.pmod(check_sum(digits_of(text)), F.lit(10)) == 0) & (F.regexp_replace(digits_of(text), "0", "") != "")


def fill_digits(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""

    def filled(new: Column) -> Column:
        def place(c: Column, i: Column) -> Column:
            before = F.length(digits_of(F.substring(template, F.lit(1), i)))
            return F.when(c.rlike("^[0-9]$"), F.substring(new, before + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(template, ""), place), "")

    return let(digits, filled)


def card_pseudonym(text: Column, key: str) -> Column:
    def checked(payload: Column) -> Column:
        check = F.pmod(-check_sum(F.concat(payload, F.lit("0"))), F.lit(10))
        return fill_digits(text, F.concat(payload, check.cast("string")))

    digits = digits_of(text)
    return let(permute_characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", _ALPHABETS[:1]), checked)


def digit_pseudonym(text: Column, key: str, label: str) -> Column:
    return fill_digits(text, permute_characters(digits_of(text), key, label, _ALPHABETS[:1]))


def phone_pseudonym(text: Column, key: str) -> Column:
    """The digits after the country code are permuted."""
    code = F.regexp_extract(text, r"^\+(?:1|7|[2-9][0-9]?)", 0)
    return F.concat(code, digit_pseudonym(F.substring(text, F.length(code) + 1, F.length(text)), key, "phone"))


def _date_parts(text: Column) -> tuple[Column, Column]:
    """The day as a date (null where the calendar has none), and which form it was written in."""
    iso = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    dots = F.try_to_timestamp(text, F.lit("d.M.yyyy"))
    slashes = F.try_to_timestamp(text, F.lit("d/M/yyyy"))
    form = F.when(text.contains("-"), "iso").when(text.contains("."), "dots").otherwise("slashes")
    return F.coalesce(F.when(form == "iso", iso), F.when(form == "dots", dots), F.when(form == "slashes", slashes)).cast("date"), form


def _day_number(text: Column) -> Column:
    day, _ = _date_parts(text)
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((number >= 0) & (number < DAY_SIDE * DAY_SIDE), number)


def is_date(text: Column) -> Column:
    return _day_number(text).isNotNull()


def date_pseudonym(text: Column, key: str) -> Column:
    _, form = _date_parts(text)
    padded = text.rlike(r"^[0-9]{2}[./][0-9]{2}[./]")

    def written(moved: Column) -> Column:
        return (
            F.when(form == "iso", F.date_format(moved, "yyyy-MM-dd"))
            .when((form == "dots") & padded, F.date_format(moved, "dd.MM.yyyy"))
            .when(form == "dots", F.date_format(moved, "d.M.yyyy"))
            .when(padded, F.date_format(moved, "dd/MM/yyyy"))
            .otherwise(F.date_format(moved, "d/M/yyyy"))
        )

    number = permute_number(_day_number(text), DAY_SIDE, key, "date").cast("int")
    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), number), written)


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda o: o.cast("int"))


def is_machine(text: Column) -> Column:
    return F.forall(_octets(text), lambda o: o <= 255) & ~text.rlike(r"(^|\.)0[0-9]")


def machine_pseudonym(text: Column, key: str) -> Column:
    value = F.aggregate(_octets(text), F.lit(0).cast("long"), lambda a, o: a * 256 + o)

    def written(moved: Column) -> Column:
        return F.concat_ws(".", *(F.shiftright(moved, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)))

    return let(permute_number(value, 1 << 16, key, "machine"), written)


def mail_pseudonym(text: Column, key: str) -> Column:
    """Name and domain are permuted apart; the last label of the domain stays."""
    name, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(permute_characters(name, key, "name"), F.lit("@"), permute_characters(rest, key, "domain"), F.lit("."), top)


def secret_pseudonym(text: Column, key: str) -> Column:
    lower, upper = (permute_characters(text, key, "secret", (letters,)) for letters in ("0123456789abcdef", "0123456789ABCDEF"))
    return F.when(text.rlike("[a-f]"), lower).otherwise(upper)


def kind_of(value: Column) -> Column:
    """What a found value is after validation; null where it is nothing that is replaced."""
    whole = {k: value.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    return (
        F.when(whole["mail"], "mail")
        .when(whole["card"] & is_card(value), "card")
        .when(whole["secret"], "secret")
        .when(whole["national_id"] & ~value.rlike("^(?:000|666|9..)-|-00-|-0000$"), "national_id")
        .when(whole["phone"] & F.length(digits_of(value)).between(9, 15), "phone")
        .when(whole["date"] & is_date(value), "date")
        .when(whole["machine"] & is_machine(value), "machine")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value, itself where validation fails."""
    kind = kind_of(value)
    return (
        F.when(kind == "mail", mail_pseudonym(value, key))
        .when(kind == "card", card_pseudonym(value, key))
        .when(kind == "secret", secret_pseudonym(value, key))
        .when(kind == "national_id", digit_pseudonym(value, key, "national_id"))
        .when(kind == "phone", phone_pseudonym(value, key))
        .when(kind == "date", date_pseudonym(value, key))
        .when(kind == "machine", machine_pseudonym(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the personal values of `text_col` replaced, and `n_numbers`, `n_dates`, `n_values` (replacing columns so named).

    `key` is the caller's secret: who has it can turn pseudonyms back, and equal keys give equal pseudonyms
    in all runs. The key stands in the plan: set `spark.sql.redaction.string.regex` to what hides it. n_numbers counts cards, national ids, telephone numbers and machine addresses, n_dates dates,
    n_values all that was replaced, mail addresses and secrets included. Null texts stay null with
    counts of 0; empty texts stay empty. Values that fail validation, and dates outside 1850-01-01
    to 2099-09-14, stay. Every row is treated by itself: no shuffle, repeated rows come out alike,
    an empty table stays empty, other columns stay whatever their names. Texts without a digit or @ skip the search.
    """
    if not key:
        raise ValueError("a key is needed: without one every reader could turn pseudonyms back")
    values, kinds, new = (f"{name}-{uuid.uuid4().hex}" for name in ("values", "kinds", "new"))
    text = F.col(text_col)
    likely = text.rlike("[0-9@]")
    found = F.when(likely, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(values, found)
    out = out.withColumn(kinds, F.transform(values, kind_of)).withColumn(new, F.transform(values, lambda v: pseudonym(v, key)))
    # the gaps between the values, in order, with the new values put in between
    marked = F.regexp_replace(F.regexp_replace(text, MARK, MARK + "~"), f"({ANY})", MARK + "|")
    gaps = F.split(marked, MARK + "[|]", -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.exists(kinds, lambda k: k.isNotNull())
    count = lambda *some: F.size(F.filter(kinds, lambda k: k.isin(*some))).cast("long")
    return out.withColumns({
        text_col: F.when(changed, F.regexp_replace(rebuilt, MARK + "~", MARK)).otherwise(text),
        "n_numbers": count("card", "national_id", "phone", "machine"), "n_dates": count("date"),
        "n_values": F.size(F.filter(kinds, lambda k: k.isNotNull())).cast("long"),
    }).drop(values, kinds, new)


def stored_key(spark: SparkSession) -> str:
    """The session's key, or that of all jobs with this shared folder: made at random once and kept there.

    Who can read the folder can turn pseudonyms back, so its permissions guard the key; a session that sets
    KEY_SETTING leaves none there.
    """
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    path = f"{shared_root(spark)}/pseudonyms-key"
    made = spark.createDataFrame([(KEY_FORM + secrets.token_hex(32),)], "value string").coalesce(1)
    made.write.mode("ignore").text(path)  # one that is there stays
    return spark.read.schema("value string").text(path).orderBy("value").first()[0]


def redacted(spark: SparkSession, key: str) -> None:
    """Keep the key out of plans as `explain` and the event log show them, where the session has no rule of its own."""
    if not spark.conf.get(REDACTION, None):
        spark.conf.set(REDACTION, f"{KEY_FORM}[0-9a-f]+" if key.startswith(KEY_FORM) else re.escape(key))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the session's key, or the one stored in the shared folder, so that runs and jobs link."""
    key = stored_key(spark)
    redacted(spark, key)
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key)


QUERIES = {"op5_pseudonyms": op5_pseudonyms}
