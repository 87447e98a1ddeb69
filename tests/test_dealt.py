"""Queries whose rows are small but take long: a file of one piece is still work for all cores."""

from ledgerloom.operators import relevance, variants
from ledgerloom.plans import catalog


def _parts(spark, folder, n):
    rows = spark.range(n).selectExpr("id AS p_partkey", "concat('blue ', id) AS p_name", "'Brand#3' AS p_brand", "CAST(id % 50 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_amended_texts_are_dealt_out(spark, tmp_path):
    _parts(spark, tmp_path, 400)
    found = catalog.registry().queries["d18_amended"](spark, str(tmp_path))
    assert len({r.part for r in found.selectExpr("spark_partition_id() AS part").collect()}) > 4
    assert found.filter("section = '655.731'").count() == 400 and found.filter("paragraphs = 'f,h'").count() == 400


def test_white_space_of_instructions(spark):
    texts = ["Amend  Sec.\t214.1 by\n revising paragraphs (a),\u000b(b)\r\nand (c).  Section\n214.2 is  amended", "no instruction", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", relevance.amended("t").alias("a")).orderBy("k").collect()
    assert [[tuple(x) for x in r.a] if r.a is not None else None for r in got] == [[("214.1", ["a", "b", "c"]), ("214.2", [])], [], [], None]


def test_documents_are_dealt_out_before_they_are_taken_apart(spark):
    docs = spark.range(200).coalesce(1).selectExpr("id AS k", """parse_json('{"a":[1,{}],"b":{"c":"{","d":[]},"e":"[]"}') AS d""")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        leaves = variants.flatten(docs, "k", "d")
        assert len({r.part for r in leaves.filter("path = 'e'").selectExpr("path", "spark_partition_id() AS part").collect()}) == 4
    finally:
        spark.conf.unset(name)
    got = {(r.path, r.text, r.kinds) for r in leaves.filter("k = 7").selectExpr("path", "to_json(value) AS text", "kinds").collect()}
    assert got == {("a.0", "1", "oa"), ("a.1", "{}", "oa"), ("b.c", '"{"', "oo"), ("b.d", "[]", "oo"), ("e", '"[]"', "o")}
