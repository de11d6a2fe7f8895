import hashlib
import logging
import re
import shutil

import pytest
from pyspark.sql import functions as F
from umbra import config as C
from umbra.functions import checksums, fakes, names, text
from umbra.functions.spans import matches, resolve_overlaps, span, splice


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_checksums(spark):
    cases = ["2363", "2364", "6011 0009 9013 9424", "6011 0009 9013 9425", "", "xyz", "0", "2341 2341 2346"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select("v", checksums.verhoeff_valid(F.col("v")).alias("a"), checksums.luhn_valid(F.col("v")).alias("b")).collect()
    assert {r.v: (r.a, r.b) for r in rows} == {c: (checksums.verhoeff(c), checksums.luhn(c)) for c in cases}
    assert checksums.verhoeff("2363") and not checksums.verhoeff("2364") and checksums.luhn("6011 0009 9013 9424")


@pytest.mark.parametrize("pattern", [r"\d+", r"(?<!\w)[a-z]+(?=!)", r"(?U)\w+", r"a|ab"])
def test_places_of_matches(spark, pattern):
    texts = ["", "12 ab! 345", "ab!ab! x", "éa 🎉 7 ñb! a", "a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), pattern).alias("m")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern.replace("(?U)", ""), r.t or "", 0 if "(?U)" in pattern else re.ASCII)]
        assert [tuple(x) for x in r.m] == want


def resolved(spark, rows):
    col = F.array(*(span(F.lit(a), F.lit(b), t, s, "x") for a, b, t, s in rows))
    return [(x.start, x.end, x.entity_type) for x in spark.range(1).select(resolve_overlaps(col).alias("s")).first().s]


def test_the_longest_span_wins_then_its_type(spark):
    assert resolved(spark, [(4, 9, "PERSON", 0.99), (4, 30, "ADDRESS", 0.5), (28, 33, "URL", 0.7), (40, 52, "IN_PAN", 0.5), (40, 52, "ODD", 1.0)]) == [(4, 30, "ADDRESS"), (40, 52, "IN_PAN")]
    # The order of types: what identifies one person stands before a card's number.
    for first, second in (("IN_AADHAAR", "CREDIT_CARD"), ("IN_PAN", "CREDIT_CARD"), ("CREDIT_CARD", "US_SSN"), ("URL", "IN_AADHAAR"), ("EMAIL_ADDRESS", "URL")):
        assert resolved(spark, [(0, 14, second, 0.9), (0, 14, first, 0.4)]) == [(0, 14, first)]


def test_splice(spark):
    r = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("XYZ").alias("fake")), F.struct(F.lit(3).alias("start"), F.lit(4).alias("end"), F.lit("").alias("fake")))
    assert one(spark, splice(F.col("t"), r), t="ab🎉d e") == "XYZ🎉 e"


def test_text_forms(spark):
    assert one(spark, text.mask(F.col("v")), v="Oscar is at quay.org") == "O***r ** ** q**y.o*g"
    assert one(spark, text.match_case(F.col("a"), F.col("b")), a="NORA", b="Eva") == "EVA"
    assert one(spark, text.strip_org_suffix(F.col("v")), v="Spindrift Ropes Private Limited") == "Spindrift Ropes"
    assert one(spark, text.org_suffix(F.col("v")), v="GULL LLP").strip() == "LLP"
    assert one(spark, text.normal(F.col("v")), v="  “Tara   Sen”, ") == "tara sen"
    assert set(one(spark, text.stems(F.col("v")), v="cutting")) >= {"cut", "cutting"}
    assert "carry" in one(spark, text.stems(F.col("v")), v="Carries")
    assert one(spark, text.host_of(F.col("v")), v="https://www.Quay.Example. com/x?y") == "quay.example.com"
    m = one(spark, text.parse_marks(F.col("v")), v="by [[PERSON:Uma Sen]], see [[URL:q.z]]")
    assert m.text == "by Uma Sen, see q.z" and [(e.start, e.end, e.type, e.text) for e in m.entities] == [(3, 10, "PERSON", "Uma Sen"), (16, 19, "URL", "q.z")]
    assert one(spark, F.sha1("v"), v="x") == hashlib.sha1(b"x").hexdigest()


def test_titles(spark):
    cases = {"managing director": True, "director and chief engineer": True, "company secretary and compliance officer": True, "compliance": False, "river director": False, "": False, "vice chair, board": False}
    for phrase, want in cases.items():
        assert C.is_title(phrase) == want and bool(one(spark, text.is_title(F.col("v")), v=phrase)) == want, phrase


def values(text, found):
    return [text[a:b] for a, b, *_ in found]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("leased by Gull & Anchor Marine Private Limited, as of May", ["Gull & Anchor Marine Private Limited"]),
        ("SALT\tWorks Limited", ["SALT\tWorks Limited"]),
        ("Lender: Coral Reef Bank Limited; Guarantor: none", ["Coral Reef Bank Limited"]),
        ("Ebb and Flow Traders Pvt. Ltd. moved. Tidepool LLP came later", ["Ebb and Flow Traders Pvt. Ltd.", "Tidepool LLP"]),
        ("Leela Rao of Sandbar Foundation wrote", ["Sandbar Foundation"]),
        ("deposits with Coast Bank of India.", ["Coast Bank of India"]),
        ("any scheduled Bank, and limited means", []),
    ],
)
def test_companies(line, want):
    assert values(line, names.companies(line)) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Contact Person: Padma Trivedi Registration No.: KL/2291", ["Padma Trivedi"]),
        ("contact persons: ROGER Spencer/ Jaya Sen and Ian Webb; fax", ["ROGER Spencer", "Jaya Sen", "Ian Webb"]),
        ("Contact Person: Uma NAIR", ["Uma"]),
        ("Contact Person: ", []),
    ],
)
def test_contacts(line, want):
    assert values(line, names.contacts(line)) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Store: Shed 9, Jetty Road, Willingdon Island, Kochi – 682 003, Kerala, India; open", ["Shed 9, Jetty Road, Willingdon Island, Kochi – 682 003, Kerala, India"]),
        ("Return it to 77 Pebble Lane, Rockport, ME 04856 by post.", ["77 Pebble Lane, Rockport, ME 04856"]),
        ("The keeper lives at 2 Dune Way, Karwar, Karnataka, India.", ["2 Dune Way, Karwar, Karnataka, India"]),
        ("a long story. " * 20 + "Plot 4, Sector 9, Panaji 403 001", ["Plot 4, Sector 9, Panaji 403 001"]),
        ("Berth BRT-660214 is free, order 310 200 too", []),
    ],
)
def test_addresses(line, want):
    assert values(line, names.addresses(line)) == want


def verified(line, kind, value, source=C.NER):
    at = line.index(value)
    return [(line[a:b], t) for a, b, t, *_ in names.verify(line, (at, at + len(value), kind, 0.9, source))]


@pytest.mark.parametrize(
    ("line", "kind", "value", "want"),
    [
        ("the Kestrel Analytics Team won", "ORGANIZATION", "the Kestrel Analytics Team", [("Kestrel Analytics", "ORGANIZATION")]),  # narrowed to its company word
        ("Zephyr Analytics/ Tidal Logistics", "ORGANIZATION", "Zephyr Analytics/ Tidal Logistics", [("Zephyr Analytics", "ORGANIZATION"), ("Tidal Logistics", "ORGANIZATION")]),
        ("Nora Webb, Ian Fisher and Tara Sen", "PERSON", "Nora Webb, Ian Fisher and Tara Sen", [("Nora Webb", "PERSON"), ("Ian Fisher", "PERSON"), ("Tara Sen", "PERSON")]),
        ("Mooring Act applies", "ORGANIZATION", "Mooring Act", []),  # ends as a term does
        ("Mooring Regulations apply", "ORGANIZATION", "Mooring", []),  # followed by one
        ("Tender Pier closed", "PERSON", "Tender Pier", []),  # holds one
        ("pier B12 closed", "PERSON", "B12", []), ("QT closed", "PERSON", "QT", []), ("PhDs met", "PERSON", "PhDs", []), ("X-Ray", "PERSON", "X-Ray", []),
        ("Deputy Director", "PERSON", "Deputy Director", []), ("the Reserve Bank of India", "ORGANIZATION", "Reserve Bank", []),
        ("Driftwood opened", "ORGANIZATION", "Driftwood", [("Driftwood", "ORGANIZATION")]), ("DRIFTWOOD", "ORGANIZATION", "DRIFTWOOD", []), ("Harbour Road", "ORGANIZATION", "Harbour Road", []),
        ("Mr. Ian Webb, ", "PERSON", "Mr. Ian Webb, ", [("Ian Webb", "PERSON")]), ("mail a@b.c", "PERSON", "a@b.c", []), ("(Ian Webb", "PERSON", "(Ian Webb", [("Ian Webb", "PERSON")]),
    ],
)
def test_verification(line, kind, value, want):
    assert verified(line, kind, value) == want


def test_guessed_names():
    for line, want in (
        ("Uma Nair met Mr Oluwaseun Adeyemi and Dr. Ingrid Solberg.", ["Uma Nair", "Oluwaseun Adeyemi", "Ingrid Solberg"]),
        ("Iravati Phadnis, Chief Engineer, spoke", ["Iravati Phadnis"]),
        ("The Kestrel Analytics report praised Brightwater Shipping.", ["Kestrel Analytics", "Brightwater Shipping"]),
        ("Blue Water and Green Boat", []),
    ):
        assert values(line, names.guessed(line)) == want, line


def test_a_failing_recogniser_adds_nothing(monkeypatch, caplog):
    def broken(text):
        raise RuntimeError

    with caplog.at_level(logging.WARNING):
        assert [x[2] for x in names.name_spans("Contact Person: Padma Trivedi", broken)] == ["PERSON"]
    assert "the name recogniser failed" in caplog.text
    monkeypatch.setattr(names, "addresses", broken)
    assert [x[2] for x in names.name_spans("Contact Person: Padma Trivedi", None)] == ["PERSON"]


def test_fakes_are_invalid_and_keep_their_shape():
    f = lambda kind, v, seed=3: fakes.fake(seed, "s", kind, v.lower(), v)
    for card in ("5105 1051 0510 5100", "6011 0009 9013 9424"):
        assert len(f("CREDIT_CARD", card)) == len(card) and not checksums.luhn(f("CREDIT_CARD", card)) and f("CREDIT_CARD", card)[0] == card[0]
    assert not checksums.verhoeff(f("IN_AADHAAR", "3675 9834 6012"))
    assert f("US_SSN", "219-07-6631").startswith("9")
    assert re.fullmatch(r"(192\.0\.2|198\.51\.100|203\.0\.113)\.\d+", f("IP_ADDRESS", "172.16.40.2")) and f("IP_ADDRESS", "fe80::1").startswith("2001:db8::")
    assert re.fullmatch(r"[A-Z]{3}P[A-Z]\d{4}[A-Z]", f("IN_PAN", "BQRPT5521L"))
    assert re.fullmatch(r"\+91 \d\d \d{4} \d{4}", f("PHONE_NUMBER", "+91 48 4266 0193")) and re.fullmatch(r"0\d\d \d{4} \d{4}", f("PHONE_NUMBER", "080 2558 4471"))
    state, street, town = f("ADDRESS", "Kerala, India"), f("ADDRESS", "9 Dune Way"), f("ADDRESS", "Shed 9, Jetty Road, Willingdon Island, Kochi – 682 003, Kerala, India")
    assert state.endswith(", India") and state.count(",") == 1 and re.fullmatch(r"\d+ [A-Z][A-Za-z ]+", street) and re.search(r" – [1-8]\d\d \d{3}, .*, India$", town)
    assert f("ORGANIZATION", "Gull & Anchor LLP").endswith(" LLP") and f("ORGANIZATION", "Spindrift LIMITED").endswith(" Limited") and f("ORGANIZATION", "Sen Family Trust").split()[1:] == ["Family", "Trust"]
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", f("DATE_OF_BIRTH", "09/04/2001")) and re.fullmatch(r"\d{4}-\d\d-\d\d", f("DATE_OF_BIRTH", "1990-02-17"))
    assert re.fullmatch(r"\d+ [A-Z][a-z]+ \d{4}", f("DATE_OF_BIRTH", "28 October 1966"))
    assert f("PERSON", "Uma Nair") == f("PERSON", "Uma Nair") != f("PERSON", "Uma Nair", 4)
    assert [len(f("PERSON", " ".join("ABCDEF"[:n])).split()) for n in (1, 2, 3, 4, 6)] == [1, 2, 3, 4, 4]


def test_lists_are_lower_case():
    assert all(x == x.lower() for x in C.TITLE_HEADS | C.TITLE_MODIFIERS | C.PUBLIC_BODIES | C.GENERIC | C.NAME_WORDS | C.DICTIONARY | C.STATES)


def test_rest_works_without_llm(tmp_path):
    """The package imports, and registers its own queries, without the llm folders."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "umbra", tmp_path / "umbra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op1') for x in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, has, ok = out.stdout.split()
    assert int(n) > 20 and has == "False" and ok == "True", out.stderr
