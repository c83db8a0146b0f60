import random
import re

from lattica.llm import surrogates as sg

TEXT = {
    1: "Write to Mr. John Smith at john.smith@mail.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111.",
    2: "JOHN.SMITH@mail.example.com called +1 017 555 7713; Smith? Mrs Smith and Frau Anna Weber. Card 4111111111111111.",
    3: "From 10.20.30.40, ssn 123-45-6789, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\".",
    4: "No person, 12 apples, version 2.0. and CC BY 4.0.",
    5: None,
    6: "",
    7: "Доктор Dr. Иванов и Анна Иванова. Mary Jones; Anna Weber.",
    8: "a@b.co" + " words" * 30_000 + " a@b.co",
}


def clean(spark, rows, key="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mentions", "'x' AS copy", "2 AS at", "'y' AS kind")
    return [(r.row.doc_id, r.clean, r.n_entities) for r in sg.replace_entities(df, key).collect()]


def test_surrogates(spark):
    rows = [*TEXT.items(), (1, TEXT[1]), (None, TEXT[1])]
    got = clean(spark, rows)
    assert len(got) == len(rows) and len({t for d, t, _ in got if d in (1, None)}) == 1
    text, n = {d: t for d, t, _ in got}, {d: k for d, _, k in got}
    assert (n[1], n[2], n[3], n[4], n[5], n[6], n[7], n[8]) == (4, 5, 3, 0, 0, 0, 4, 2)
    assert text[4] == TEXT[4] and text[5] is None and text[6] == ""
    for d, gone in ((1, ["John", "Smith", "john.smith", "555-7713", "4111 1111"]), (2, ["JOHN", "Mrs Smith", "7713", "Weber", "41111"]), (3, ["10.20.30.40", "123-45", "b44e15"]), (7, ["Анна", "Mary", "Jones"]), (8, ["a@b.co"])):
        assert not [g for g in gone if g in text[d]], (d, text[d])
    # the same entity, written otherwise, has the same surrogate in the format it is written in
    phone = [re.sub(r"\D", "", re.search(r"\+1[ ()\d-]+\d", text[d]).group()) for d in (1, 2)]
    assert phone[0] == phone[1] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])
    cards = [re.sub(r"\D", "", re.search(r"card ([\d ]{16,19})", text[d], re.I).group(1)) for d in (1, 2)]
    assert cards[0] == cards[1] and re.search(r"4\d{3} \d{4} \d{4} \d{4}", text[1])
    luhn = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(cards[0]))]
    assert sum(v - 9 * (v > 9) for v in luhn) % 10 == 0
    mails = [re.search(r"\S+@\S+\w", text[d]).group() for d in (1, 2)]
    assert mails[0] == mails[1].lower() and mails[1].split("@")[0].isupper() and mails[0].endswith(".com")
    surname = re.search(r"Mr\. (\w+) (\w+)", text[1]).group(2)
    assert f"Mrs {surname}" in text[2] and surname[0].isupper()
    given = re.search(r"Frau (\w+) (\w+)", text[2])
    assert given.group() == "Frau " + " ".join(given.groups()) and f"{given.group(1)} {given.group(2)}." in text[7]
    assert given.group(1).endswith("a") and re.search(r"Dr\. [А-Яа-я]+ и [А-Яа-я]+ [А-Яа-я]+\.", text[7])
    assert re.search(r"ssn \d{3}-\d{2}-\d{4}", text[3]) and re.search(r'"[0-9a-f]{40}"', text[3])
    assert clean(spark, rows[:3]) == clean(spark, rows[:3]) != clean(spark, rows[:3], "other")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sg.replace_entities(empty, "k").count() == 0


def test_names_alone_and_joined(spark):
    rows = [(1, TEXT[2]), (2, "Mr John Smith came. Smith said that John's dog, SMITH and Smith's car; blacksmith Smithers smith."), (3, "Mr Smith-Jones and Dr. John Q. Public left; Smith-Jones and Public agreed. Public's hat."), (4, "Smith is not named here.")]
    got = {d: t for d, t, _ in clean(spark, rows)}
    assert "Smith" not in got[1] and not re.search(r"Smith\b|John|SMITH", got[2]) and "blacksmith Smithers smith." in got[2]
    surname = re.search(r"Mr (\w+) (\w+) came\. (\w+) said that (\w+)'s dog, (\w+) and (\w+)'s car", got[2]).groups()
    assert surname[1] == surname[2] == surname[5] == surname[4].capitalize() and surname[0] == surname[3]
    assert not re.search("Smith|Jones|John|Public", got[3]) and got[4] == rows[3][1]


def test_accounts_addresses_labels_and_scripts(spark):
    rows = [
        (1, "Pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000, not GB00 WEST 1234 5698 7654 32. At 12:30:45 std::dec ab::1."),
        (2, "From 2001:db8::1 and 2001:DB8:0:0:8:800:200C:417A, 2001:db8::1."),
        (3, "Author: Brenda Quimby wrote. Quimby left. The Author: an essay."),
        (4, "Κύριος Παπαδόπουλος και Ελένη Παππά. " + "0f" * 200 + " x@" + "a." * 30 + "com"),
    ]
    got = {d: t for d, t, _ in clean(spark, rows)}
    one, two, other = re.search(r"Pay (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}), not (GB00 [A-Z]{4}(?: \d{4}){3} \d\d)\.", got[1]).groups()
    assert one.replace(" ", "") == two != "DE89370400440532013000" and "WEST" not in other and got[1].endswith("At 12:30:45 std::dec ab::1.")
    assert int(two[4:] + "1314" + two[2:4]) % 97 == 1
    a, b, c = re.search(r"From (\S+) and (\S+), (\S+)\.$", got[2]).groups()
    assert a == c and re.fullmatch(r"\d{4}:[a-f]{2}\d::\d", a) and re.fullmatch(r"\d{4}:[A-F]{2}\d:\d:\d:\d:\d{3}:\d{3}[A-F]:\d{3}[A-F]", b) and "2001:" not in a
    assert not re.search("Brenda|Quimby", got[3]) and "The Author: an essay." in got[3]
    assert re.fullmatch(r"Κύριος [Α-ω\u0370-\u03ff]+ και [Α-ω\u0370-\u03ff]+ [Α-ω\u0370-\u03ff]+\. [0-9a-f]{400} \S+@\S+\.com", got[4])
    assert not re.search("Παπαδόπουλος|Ελένη|Παππά|0f0f0f|a\\.a\\.a", got[4])


def test_no_detected_name_left_in_clear(spark):
    """Against brute force: in no text is a name of its own full mentions left, whatever stands around it, and equal names have equal surrogates."""
    r = random.Random(5)
    given, names = ["Mary", "John", "Sabine", "Carlos"], ["Quimby", "Ortega", "Lindqvist", "O'Hara", "Smith-Jones", "Weber"]
    rows, own = [], {}
    for d in range(60):
        people = [(r.choice(given), r.choice(names)) for _ in range(r.randrange(1, 4))]
        parts = [f"{g} {n}" if r.random() < 0.5 else f"Dr. {n}" for g, n in people]
        parts += [r.choice([n, n.upper(), f"{n}'s", f"({n})", f"\n{n},"]) for _, n in people for _ in range(3)] + ["words", "and", "Some"]
        rows.append((d, ", ".join([*parts[: len(people)], *r.sample(parts, len(parts))])))
        own[d] = {n for _, n in people}
    surnames = {}
    for d, text, _ in clean(spark, rows):
        for n in own[d]:
            assert not re.search(rf"(?i)\b{n}\b", text), (n, text)
        titled = re.findall(r"Dr\. ([^ ,]+)", dict(rows)[d])
        for n, s in zip(titled, re.findall(r"Dr\. ([^ ,]+)", text), strict=True):
            assert surnames.setdefault(n, s) == s
    assert len(set(surnames.values())) == len(surnames) > 3


def test_long_odd_texts(spark):
    rows = [(1, "a-" * 200_000), (2, "x@y" + ".z" * 100_000), (3, "9" * 300_000), (4, "Mr " * 100_000), (5, "(1)-" * 50_000 + "@"), (6, "A" * 300_000 + "1")]
    got = clean(spark, rows)
    assert len(got) == len(rows) and {d: n for d, _, n in got}[1] == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    monkeypatch.setattr(sg, "SYLLABLES", {k: v[:3] for k, v in sg.SYLLABLES.items()})
    monkeypatch.setattr(sg, "ENDINGS", {k: {e: x[:1] for e, x in v.items()} for k, v in sg.ENDINGS.items()})
    names = [(f"name{chr(97 + i)}",) for i in range(20)] + [("babababamann",)]
    entities = spark.createDataFrame(names, "canon string").selectExpr("'surname' AS kind", "canon")
    got = [(r.canon, r.surrogate) for r in sg.entity_surrogates(entities.union(entities), "k").collect()]
    assert len(got) == len(names) == len({s for _, s in got}) and not {c for c, _ in got} & {s for _, s in got}


def test_native(spark):
    plan = sg.op3_surrogates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_names_of_several_parts(spark):
    texts = ["Mr. José García López", "Ms. Anna Maria Lopez Ruiz", "Mr. Jean de la Fontaine", "Herr Dr. Klaus Weber", "MR. JOHN SMITH", "Contact: Ludwig van Beethoven", "Frau Prof. Dr. Anna von der Heide", "SSN 123456789", "ssn: 123456789"]
    names = {"José", "García", "López", "Anna", "Maria", "Lopez", "Ruiz", "Jean", "Fontaine", "Klaus", "Weber", "JOHN", "SMITH", "Ludwig", "Beethoven", "Heide", "123456789"}
    got = {d: t for d, t, _ in clean(spark, [(d, f"We saw {t}, and {t} left.") for d, t in enumerate(texts)] + [(90, "Herr Weber and Mrs Smith; 123-45-6789, 123456789."), (91, "the plane de la fontaine, SSN")])}
    for d, text in enumerate(texts):
        assert not names & set(re.findall(r"\w+", got[d])), got[d]
        first, second = re.fullmatch(r"We saw (.+), and (.+) left\.", got[d]).groups()
        assert first == second and len(first.split()) == len(text.split())
    assert re.fullmatch(r"We saw Mr\. \w+ de la \w+, and .*", got[2]) and re.fullmatch(r"We saw Herr Dr\. \w+ \w+, and .*", got[3])
    assert re.fullmatch(r"We saw MR\. [A-Z]+ [A-Z]+, and .*", got[4]) and re.fullmatch(r"We saw Contact: \w+ van \w+, and .*", got[5]) and re.fullmatch(r"We saw Frau Prof\. Dr\. \w+ von der \w+, and .*", got[6])
    weber, smith = re.match(r"Herr (\w+) and Mrs (\w+);", got[90]).groups()
    assert f" {weber}, and" in got[3] and f" {smith.upper()}, and" in got[4]
    number = re.search(r"SSN (\d{9}),", got[7]).group(1)
    assert number in got[8] and f"{number[:3]}-{number[3:5]}-{number[5:]}, 123456789." in got[90] and got[91] == "the plane de la fontaine, SSN"
