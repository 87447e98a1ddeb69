import random
import re

from ledgerloom.llm.licenses import TEMPLATES, needed_bigrams, scan_licenses, template_bigrams


def _bigrams(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _brute(text, threshold):
    text = text or ""
    units = {*text.split("\n"), text, *[p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p]}
    hits = []
    for u in units:
        for name, body in TEMPLATES.items():
            a, b = _bigrams(u), _bigrams(body)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                hits.append((-2 * len(a & b) / (len(a) + len(b)), name))
    best = min(hits, default=(0.0, None))
    return best[1], -best[0], len(hits)


def _texts():
    rng = random.Random(6)
    out = [None, "", "\n\n", "word", "All rights reserved", "all RIGHTS, reserved!\nAll rights reserved.", TEMPLATES["MIT-text"].upper(), "x\n\n" + TEMPLATES["GPL-3.0-header"].replace(". ", ".\n") + "\n\ny", "the " * 5000]
    for _ in range(150):
        words = rng.choice(list(TEMPLATES.values())).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["license", "the", "foo", "é"])
        out.append("\n".join(rng.choice(["some prose here.", " ".join(words), "", "license"]) for _ in range(rng.randint(1, 5))))
    return out


def test_pruned_scan_equals_brute_force(spark):
    texts = _texts()
    for threshold in (0.6, 0.8, 1.0):
        got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=threshold).collect()
        wrong = [(texts[r.doc_id], r.license, r.dice, r.n_hits, _brute(texts[r.doc_id], threshold)) for r in got if (r.license, r.dice, r.n_hits) != _brute(texts[r.doc_id], threshold)]
        assert not wrong, wrong[0]


def test_every_match_holds_a_needed_bigram():
    bigrams = template_bigrams({"a": "one two three four five six", "b": "two three four"})
    needed = set(needed_bigrams(bigrams, 0.8))
    for own in bigrams.values():
        most_lost = len(own) - int(0.8 / 1.2 * len(own) + 0.999999)
        assert len(needed & set(own)) >= min(len(own), most_lost)


def test_rows_and_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "All rights reserved.", 3), (1, "All rights reserved.", 3), (None, None, None)], "doc_id long, text string, license int")
    got = scan_licenses(df)
    assert sorted(str(r.license) for r in got.collect()) == ["All-Rights-Reserved", "All-Rights-Reserved", "None"] and got.columns == ["doc_id", "text", "license_hits", "license", "dice", "n_hits"]
    assert scan_licenses(df.limit(0)).count() == 0


def test_long_units_that_repeat_few_words_are_still_compared(spark):
    text = "all rights reserved " * 4000
    other = " ".join(f"w{i}" for i in range(30_000)) + "\nAll rights reserved.\n" + "x" * 100_000
    got = {r.doc_id: (r.license, r.n_hits) for r in scan_licenses(spark.createDataFrame([(1, text), (2, other), (3, None)], "doc_id long, text string")).collect()}
    assert got[1] == ("All-Rights-Reserved", 1) and got[2] == ("All-Rights-Reserved", 1) and got[3] == (None, 0)


def test_clause_texts_are_told_apart(spark):
    from ledgerloom.llm.licenses import TEMPLATES

    names = ["BSD-3-Clause-text", "BSD-2-Clause-text", "Zlib", "0BSD", "ISC", "AGPL-3.0-header", "LGPL-2.1-header"]
    rows = [(i, "Copyright (c) 2020 Acme\n\n" + TEMPLATES[n].replace(". ", ".\n * ")) for i, n in enumerate(names)]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_every_template_is_named_as_itself(spark):
    docs = spark.createDataFrame([(name, text) for name, text in TEMPLATES.items()], "name string, text string")
    got = {r.name: (r.license, r.dice) for r in scan_licenses(docs).collect()}
    assert got == {name: (name, 1.0) for name in TEMPLATES}
    notice = "Copyright (c) 2021, A. Holder\n\n" + TEMPLATES["ISC"].replace("copies. THE", "copies.\n\nTHE")
    assert scan_licenses(spark.createDataFrame([("n", notice)], "name string, text string")).first().license == "ISC"
