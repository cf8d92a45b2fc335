"""The Hebrew segments that the typography and bidi queries read are whole."""

from cuelake.plans import bindings, text_queries


def test_long_segments_stay_whole(spark, tmp_path):
    text = "\n".join(["short one"] + ["abc " * 100 + "end"] * 2)
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    own = {x.pos: x.text for x in bindings.segments(spark, str(tmp_path)).collect()}
    got = {x.pos: x.text for x in text_queries.hebrew(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and len(got[1]) == len(own[1]) + 1
