import random
import re

import duckdb
import pytest

from ledgerloom.llm.licenses import TEMPLATES, scan_license_windows, scan_licenses, windows_sql
from test_licenses import _bigrams, _texts


def _run_hits(text, threshold):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    hits = {}
    for name, body in TEMPLATES.items():
        own = _bigrams(body)
        most = int(len(own) * (2 - threshold) / threshold + 1e-9)
        for i in range(len(pairs)):
            seen = set()
            for b in pairs[i : i + most]:
                seen.add(b)
                hits[name] = max(hits.get(name, 0), 2 * len(seen & own) / (len(seen) + len(own)))
    return {name: dice for name, dice in hits.items() if dice >= threshold}


def _planted():
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the of and software to in use any word other".split()) for _ in range(n))
    mit = re.sub(r"(conditions:|Software\. )", r"\1\n\n", TEMPLATES["MIT-text"])
    return [f"# readme\n\n{prose(300)}\n\nMIT License\n\nCopyright 2020 Acme\n\n{mit}\n\n{prose(250)}", "Copyright 2020 Acme. All rights reserved.", f"{prose(20)} Released under the MIT License. {prose(20)}", prose(200)]


def test_licence_in_a_long_document_and_notice_in_a_long_line(spark):
    docs = spark.createDataFrame(list(enumerate(_planted())), "doc_id long, text string")
    found = {r.doc_id: (r.license, r.dice) for r in scan_license_windows(docs).collect()}
    assert found == {0: ("MIT-text", 1.0), 1: ("All-Rights-Reserved", 1.0), 2: ("MIT", 1.0), 3: (None, 0.0)}
    assert {r.license for r in scan_licenses(docs).collect()} == {None}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_runs_equal_brute_force_and_sql(spark, threshold):
    rows = list(enumerate(_texts()[8:40] + _planted() + [None, "", "word"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units = {r.doc_id: {h.license: 0 for h in r.license_hits} | {h.license: max(x.dice for x in r.license_hits if x.license == h.license) for h in r.license_hits} for r in scan_licenses(df, threshold=threshold).collect()}
    got = {r.doc_id: (r.license, r.dice, r.n_hits) for r in scan_license_windows(df, threshold=threshold).collect()}
    for i, text in rows:
        runs = _run_hits(text or "", threshold)
        every = {n: max(runs.get(n, 0), units[i].get(n, 0)) for n in {*runs, *units[i]}}
        best = min(((-d, n) for n, d in every.items()), default=(0.0, None))
        assert got[i] == (best[1], -best[0], len(every)), text
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {i: (name, dice, n) for i, name, dice, n in con.execute(windows_sql(threshold=threshold)).fetchall()} == got
