"""Operators that SQL can't express, against plain loops and hand-made cases."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import mining, series, vocabulary
from ledgerloom.operators.clauses import ClauseWords, clauses

WORDS = ClauseWords(
    adverbs=("hereby", "also"), negators=("do not", "decline to"), doubts=("without merit", "nothing in", "no basis"), partial=("finding",),
    full=("petition", "appeal"), determiners=("the", "an"), standards=("petitions such as",),
)


def test_capped_top_skips_without_using_quota(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice("abc"), rng.sample(["x", "y", "z"], rng.randint(1, 2))) for g in ("d1", "d2") for i in range(40)]
    got = series.capped_top(spark.createDataFrame(rows, "g string, i int, sub string, labels array<string>"), "g", [F.col("i")], "sub", "labels", 9, 4, 5)
    want = []
    for g in ("d1", "d2"):
        taken, subs, labels = [], {}, {}
        for _, i, sub, own in (r for r in rows if r[0] == g):
            if len(taken) < 9 and subs.get(sub, 0) < 4 and any(labels.get(x, 0) < 5 for x in own):
                taken.append(i)
                subs[sub] = subs.get(sub, 0) + 1
                for x in set(own):
                    labels[x] = labels.get(x, 0) + 1
        want += [(g, k, i) for k, i in enumerate(taken)]
    assert sorted((r.g, r.place, r.i) for r in got.collect()) == want


def test_clusters_compare_with_seeds_only(spark):
    stories = [("m", 1, ["fee", "rule", "final"]), ("m", 2, ["fee", "rule", "final", "now"]), ("m", 3, ["fee", "rule", "now", "soon"]), ("m", 4, ["rule", "now", "soon", "fee"]), ("n", 1, ["fee", "rule", "final"]), ("n", 2, [])]
    got = mining.cluster_stories(spark.createDataFrame(stories, "day string, k int, tokens array<string>"), "day", "k", "tokens", [])
    # 3 is near 2, a member, but 2 of 5 away from the seed 1; so it starts a cluster of its own, which 4 joins.
    assert sorted((r.day, r.k, r.seed) for r in got.collect()) == [("m", 1, 1), ("m", 2, 1), ("m", 3, 3), ("m", 4, 3), ("n", 1, 1), ("n", 2, 2)]


def test_a_rare_common_token_makes_one_story_of_two(spark):
    stories = [("m", 1, ["visa", "bulletin", "march", "cutoffs"]), ("m", 2, ["visa", "zebra", "march"]), ("m", 3, ["zebra", "march", "alone", "again", "here"])]
    rows = spark.createDataFrame(stories, "day string, k int, tokens array<string>")
    assert [r.seed for r in mining.cluster_stories(rows, "day", "k", "tokens", ["zebra"]).orderBy("k").collect()] == [1, 2, 2]


def test_frames_of_hand_made_clauses(spark):
    docs = [
        (1, "Accordingly, we hereby GRANT the petition for review and remand."),
        (2, "There is no basis in law. For these reasons, we do not affirm the finding below."),
        (3, "No clause here."),
        (4, None),
        (5, ""),
        (6, "We grant petitions such as this one only when new evidence is shown."),
        (7, "There is nothing in the record, so we decline to vacate. And we order the agency's award"),
    ]
    rows = {(r.doc_id, r.verb): r for r in clauses(spark.createDataFrame(docs, "doc_id long, text string"), WORDS).collect()}
    assert set(rows) == {(1, "grant"), (2, "affirm"), (7, "order")}  # the standard's own wording and a verb without object say nothing
    one, two, seven = rows[1, "grant"], rows[2, "affirm"], rows[7, "order"]
    assert (one.caps, one.negated, one.scope, one.object) == (True, False, "full", "petition for review and")
    assert docs[0][1][one.start : one.end] == "GRANT" and one.begin == 0
    assert (two.negated, two.scope, two.object) == (True, "partial", "finding below")
    assert docs[1][1][two.begin :].startswith("For these reasons")
    assert (seven.negated, seven.scope, seven.object) == (False, "unknown", "agency")


def test_a_negative_left_context_negates(spark):
    docs = [(1, "Finding the claim without merit, we deny the appeal."), (2, "It is without merit. Now we deny the appeal.")]
    got = {r.doc_id: r.negated for r in clauses(spark.createDataFrame(docs, "doc_id long, text string"), WORDS).collect()}
    assert got == {1: True, 2: False}


def test_the_vocabulary_is_written_as_tables(spark, tmp_path):
    found = spark.createDataFrame([(d, "order" if d % 2 else "deny", f"object {d % 3}", d % 2 == 1, False, "full", d / 40) for d in range(40)], "doc_id long, verb string, object string, caps boolean, negated boolean, scope string, place double")
    labels = spark.createDataFrame([(d, "REMAND ORDER" if d % 4 == 1 else "", "denied" if d % 2 == 0 else "") for d in range(40)], "doc_id long, title string, petition string")
    vocabulary.write(found, labels, str(tmp_path), floor=5)
    verbs = {r.verb: r for r in spark.read.json(f"{tmp_path}/verbs").collect()}
    assert (verbs["order"].docs, verbs["order"].caps_ratio, verbs["order"].remand_lift) == (20, 1.0, 2.0) and verbs["deny"].remand_lift == 0.0
    assert spark.read.json(f"{tmp_path}/summary").first().objects_kept == 3
