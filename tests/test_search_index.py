"""The search index that is kept between searches."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import searchindex
from lodestone.operators.searchindex import SearchIndex

SCHEMA = "id string, body string, title string"


def found(index, text):
    return sorted(r.key for r in index.search(text).collect())


def test_search_after_adding_replacing_deleting_and_merging(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    assert found(index, "anything") == [] and index.segments() == []
    docs = lambda rows: spark.createDataFrame(rows, SCHEMA)
    add = lambda rows: index.add(docs(rows), "id", F.concat_ws(" ", "body", "title"), F.col("title"))
    add([("1", "a long tail", "TinyTREX"), ("2", "the other", "T-Rex"), ("3", None, "Éclair Café"), (None, "lost", "lost"), ("4", "", "")])
    assert found(index, "trex") == ["1", "2"]  # parted at capitals, neighbours joined
    assert found(index, "t rex") == ["1", "2"]  # all words joined: the first has no word t
    assert found(index, "ECLAIR caf") == ["3"] and found(index, "clair") == []
    assert found(index, "t") == ["2"]  # one letter matches whole
    assert found(index, "") == [] and found(index, "?!") == [] and found(index, "lost") == []
    add([("2", "something else", "Rabbit"), ("5", "", "trexes")])
    assert found(index, "trex") == ["1", "5"] and found(index, "rabb") == ["2"]
    index.delete(docs([("1", "", ""), ("99", "", "")]), "id")
    assert found(index, "trex") == ["5"]
    add([("1", "", "back")])
    assert found(index, "back") == ["1"] and found(index, "tiny") == []
    for whole in (False, True):
        index.compact(whole)
        assert found(index, "trex") == ["5"] and found(index, "ba") == ["1"] and found(index, "rabb") == ["2"] and found(index, "cafe") == ["3"]
    assert sorted(s.kind for s in index.segments()) == ["keys", "postings"]  # nothing is left to hide


def test_segments_of_a_level_are_merged_and_old_ones_deleted(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    for k in range(searchindex.FAN):
        index.add(spark.createDataFrame([(f"{k}{i}", f"word{i} batch{k}", "") for i in range(20)], SCHEMA), "id", F.col("body"))
    posts = [s for s in index.segments() if s.kind == "postings"]
    assert [s.level for s in posts] == [1] and posts[0].rows == 40 * searchindex.FAN
    assert len(found(index, "word1")) == 11 * searchindex.FAN  # word1 and word10 to word19
    on_disk = {p.name for p in (tmp_path / "i").iterdir()} - {"list"}
    assert len(on_disk) <= 3 * searchindex.FAN + 2  # what the version before still names


def test_a_prefix_reads_a_small_part_of_the_rows(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", group_rows=2000, page_rows=200)
    spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("w"), F.sha1(F.col("id").cast("string"))).alias("body")).createOrReplaceTempView("many")
    index.add(spark.table("many"), "id", F.col("body"))
    read = index.live(searchindex.prefix("w00a"))
    rows = read.collect()
    assert 0 < len(rows) < 60
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(term,w00a)" in plan
    leaves = read._jdf.queryExecution().executedPlan().collectLeaves()
    scanned = sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
    assert len(rows) <= scanned <= 60_000 // 20


def test_kept_is_built_once_for_the_files_that_a_table_has(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([("1", "first words", "")], SCHEMA).write.parquet(path)
    ask = lambda: searchindex.kept(spark.read.parquet(path), "t", "id", F.col("body"), folder=f"file://{tmp_path}")
    first = ask()
    assert found(first, "wor") == ["1"] and ask().segments() == first.segments()
    spark.createDataFrame([("2", "second words", "")], SCHEMA).write.mode("append").parquet(path)
    assert found(ask(), "wor") == ["1", "2"] and ask().folder != first.folder


@pytest.mark.parametrize("text, want", [("Crème BRÛLÉE", "creme brulee"), ("Ångström", "angstrom"), ("été", "ete"), ("İstanbul", "istanbul"), ("straße", "straße")])
def test_terms_are_folded_alike_in_tables_and_searches(spark, text, want):
    row = spark.createDataFrame([(text,)], "v string").select(F.lower(searchindex.unaccented(F.col("v"))).alias("v")).first()
    assert row.v == want
    assert searchindex.query_terms(text) == want.split()
