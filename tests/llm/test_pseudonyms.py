import ipaddress
import re
from datetime import date

from pyspark.sql import functions as F

from slotalign.llm.pseudonyms import DAY_LEFT, DAY_RIGHT, DAYS, PATTERN, permuted_digits, pseudonymise
from slotalign.llm import pseudonyms


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, texts, key="k"):
    return {r.i: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), key).collect()}


def test_digits_are_permuted(spark):
    for size in (1, 2, 3):
        values = spark.range(10**size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("d"))
        got = [r.p for r in values.select(permuted_digits(F.col("d"), "k", "x").alias("p")).collect()]
        assert sorted(got) == sorted(f"{i:0{size}d}" for i in range(10**size))


def test_all_days_are_permuted(spark):
    assert DAY_LEFT * DAY_RIGHT - DAYS == 121
    texts = spark.range(3000).select(F.date_format(F.expr("date_add(DATE'2001-01-01', CAST(id AS INT))"), "yyyy-MM-dd").alias("text"))
    got = [r.text for r in pseudonymise(texts, "k").collect()]
    assert len(set(got)) == 3000 and all(date(1900, 1, 1) <= date.fromisoformat(t) <= date(2099, 12, 31) for t in got)


def test_formats_and_links(spark):
    texts = ["card 4111 1111 1111 1111, 4111111111111111; bad 4111111111111112", "+1 (988) 555-2485 or +1 (988) 555-2485.",
             "42.144.35.254 but 300.1.1.1 and 1.2.3.4.5", "on 2021-03-04, 4.3.2021 and 03/04/2021, not 2021-02-30",
             "123-45-6789 and 000-12-3456", "mail Ann.B@Mail.example.org", "plain 12345 text"]
    got = replaced(spark, texts)
    spaced, joined = re.findall(r"(?:\d{4} ?){4}", got[0].text)[:2]
    assert spaced.replace(" ", "") == joined and luhn(joined) and joined != "4111111111111111" and "4111111111111112" in got[0].text
    first, second = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)
    assert first == second != "+1 (988) 555-2485"
    assert ipaddress.ip_address(got[2].found[0].pseudonym) and got[2].text.endswith("but 300.1.1.1 and 1.2.3.4.5")
    days = [f.pseudonym for f in got[3].found]
    y, m, d = map(int, days[0].split("-"))
    assert days[1:] == [f"{d}.{m}.{y}" if d < 10 or m < 10 else f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}"] and "2021-02-30" in got[3].text
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} and 000-12-3456", got[4].text) and not got[4].text.startswith("123-45")
    assert re.fullmatch(r"mail u[0-9a-f]{12}@d[0-9a-f]{8}\.example", got[5].text) and got[6].text == texts[6]
    assert replaced(spark, texts, "other")[1].text != got[1].text


def test_text_around_matches_is_kept(spark, words):
    texts = [f"{a}é 4111111111111111 {b}\n55.63.178.142 🙂 {a}@x.example.com" for a, b in zip(words[:50], words[50:100])]
    plain = re.compile(PATTERN, re.ASCII)
    for i, row in replaced(spark, texts).items():
        values = iter([f.pseudonym for f in row.found])
        assert row.text == plain.sub(lambda m: next(values), texts[i]) and [f.value for f in row.found] == plain.findall(texts[i])
        assert [f.kind for f in row.found] == ["card", "ipv4", "email"]


def test_odd_rows(odd_docs, no_docs):
    rows = pseudonymise(odd_docs, "k")
    assert {(r.doc_id, r.text) for r in rows.collect()} == {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert rows.where("size(found) > 0").count() == 0 and pseudonymise(no_docs, "k").count() == 0
    assert pseudonyms.KINDS == tuple(dict.fromkeys(pseudonyms.KINDS))


def test_very_many_labels_do_not_stop_a_job(make_docs):
    texts = ["x@" + "a." * 4000 + "com", "x@" + "ab." * 200_000 + "com", "x@" + "a" * 500_000, "mail a.b@example.org now",
             "1-" * 200_000, "+49 " * 100_000, "a@b" * 100_000]
    rows = {r.doc_id: r for r in pseudonymise(make_docs(texts), key="k").collect()}
    assert rows[0].text == texts[0] and rows[2].text == texts[2]
    assert len(rows[1].found) == 1 and len(rows[1].found[0].value) == 2 + 3 * 126 + 2 and rows[1].text.endswith("ab.com")
    assert [f.kind for f in rows[3].found] == ["email"] and "example.org" not in rows[3].text
