import re

from pyspark.sql import functions as F

from obsframe.llm import surrogates

from .conftest import by_id

TEXTS = [
    "Write to ann.lee@mail7.example.com or ANN.LEE@MAIL7.EXAMPLE.COM today.",
    "Call +1 (017) 555-7713, not +10175557713; card 4111-1111-1111-1111 and 4111111111111111.",
    "Hosts 97.51.17.173 and 192.168.3.4 and 97.51.17.173.",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or 04DBEBAB91AB85687D33EEAAF9AC699E1188F962',
    "Mrs. Mary Hill met Mr. John Hill. Then Mrs Mary Hill left. Господин Иван Петров came.",
    "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013000.",
    "nothing here", "", None, "Write to ann.lee@mail7.example.com or ANN.LEE@MAIL7.EXAMPLE.COM today.",
    "card 9807915762804490 é漢😀 end@", "version 1.2.3.4.5 and 12 3456",
]


def test_kinds_formats_and_coreference(spark, docs):
    got = by_id(surrogates.replace_entities(docs(TEXTS)))
    text = {k: r["text"] for k, r in got.items()}
    assert len(got) == len(TEXTS)
    one, two = re.fullmatch(r"Write to ([a-z]{3}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com) or (\S+) today\.", text[0]).groups()
    assert two == one.upper() and one != "ann.lee@mail7.example.com"
    a, b, c, d = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), not (\+1\d{10}); card (4\d{3}(?:-\d{4}){3}) and (4\d{15})\.", text[1]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713" and c.replace("-", "") == d != "4111111111111111"
    digits = [int(x) for x in d]
    assert sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(digits)) % 10 == 0
    a, b, c = re.fullmatch(r"Hosts (\S+) and (192\.168\.\d+\.\d+) and (\S+)\.", text[2]).groups()
    assert a == c != "97.51.17.173" and b != "192.168.3.4" and all(0 <= int(x) < 256 for x in a.split("."))
    a, b = re.fullmatch(r'token = "([0-9a-f]{40})" or ([0-9A-F]{40})', text[3]).groups()
    assert b == a.upper() and not a.startswith("04dbebab")
    a, b, c, d = re.fullmatch(r"Mrs\. (\w+ \w+) met Mr\. (\w+ \w+)\. Then Mrs (\w+ \w+) left\. Господин (\w+ \w+) came\.", text[4]).groups()
    assert a == c and a.split()[0] in surrogates.GIVEN["f", "Latin"] and b.split()[0] in surrogates.GIVEN["m", "Latin"]
    assert d.split()[0] in surrogates.GIVEN["m", "Cyrillic"] and re.fullmatch(r"[а-яё]+", d.split()[1].lower())
    a, b, c = re.fullmatch(r"SSN (\d{3}-\d\d-\d{4}), IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20})\.", text[5]).groups()
    assert b.replace(" ", "") == c and a != "123-45-6789"
    assert (text[6], text[7], text[8]) == ("nothing here", "", None)
    assert text[9] == text[0] and got[9]["n_entities"] == 2 and got[6]["n_entities"] == 0
    assert re.fullmatch(r"card 9\d{15} é漢😀 end@", text[10]) and text[11] == TEXTS[11]


def test_key_changes_surrogates(spark, docs):
    a, b = (by_id(surrogates.replace_entities(docs(TEXTS), key=k))[2]["text"] for k in ("one", "two"))
    assert a != b and a == by_id(surrogates.replace_entities(docs(TEXTS), key="one"))[2]["text"]


def test_no_two_entities_share_a_surrogate(spark):
    """All 10,000 numbers of four free digits: every round has collisions, and each must end with a number of its own."""
    known = spark.range(9000).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 5, "0").alias("plain"), F.lit("n").alias("gender"))
    rows = surrogates.assign(known).collect()
    assert len(rows) == 9000 == len({r["made"] for r in rows})
    assert not {r["made"] for r in rows} & {r["plain"] for r in rows}
    assert all(re.fullmatch(r"\d{5}", r["made"]) for r in rows)


def test_edges(spark, docs):
    assert surrogates.replace_entities(docs([(1, "x")]).limit(0)).count() == 0
    df = docs([(None, "ip 1.2.3.4"), (5, "ip 1.2.3.4"), (5, "b 1.2.3.4")], ", entity string, made int", ("e", 3))
    rows = surrogates.replace_entities(df).collect()
    assert len(rows) == 3 and len({r["text"].split()[1] for r in rows}) == 1 and all(r["entity"] == "e" for r in rows)
    assert surrogates.replace_entities(df, out="safe").columns == ["doc_id", "text", "entity", "made", "safe", "n_entities"]
