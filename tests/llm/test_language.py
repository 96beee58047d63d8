import zlib

from tessera.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").where("doc_id < 4000").collect()}
    got = [r for r in language.op2_language_id(spark, sf).where("doc_id < 4000").collect()]
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def test_odd_rows(spark):
    en, de = "the cat and the dog went to the house " * 3, "der hund und die katze gehen nach hause "
    rows = [(i, en, "en") for i in range(30)] + [(100 + i, de, "de") for i in range(30)] + [(None, de, None), (7, None, "en"), (8, "", None), (9, "12 345! ½²", "xx"), (9, "12 345! ½²", "xx"), (10, en * 3000, None)]
    df = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, lang string, score double, rejected string")
    model = language.learn(df)
    assert set(model.dictionaries) == {"en", "de"}
    got = language.identify(df, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].lang_pred == "de" and by_id[10].lang_pred == "en"
    assert [by_id[i].lang_pred for i in (7, 8, 9)] == ["und"] * 3 and by_id[8].score == 0
    empty = df.limit(0)
    assert language.learn(empty).dictionaries == {}
    assert language.identify(empty, language.learn(empty), ["doc_id"]).count() == 0
    assert language.identify(df, language.LanguageModel({}), ["doc_id"]).where("lang_pred = 'und'").count() == len(rows)


def test_long_texts_teach_too(spark):
    en, de = "the cat and the dog went to the house ", "der hund und die katze gehen nach hause "
    rows = [(i, en, "en") for i in range(30)] + [(100 + i, de * 1000, "de") for i in range(3)] + [(200 + i, None, "de") for i in range(5000)] + [(None, de * 1000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert set(model.dictionaries) == {"en", "de"}
    assert len(model.dictionaries["de"]) >= 4 * (language.SAMPLE_CHARS - 2)
    assert model.classify(de)[0] == "de"


def test_narrow_margins_are_rejected():
    model = language.LanguageModel({"a": b"one two three four five six " * 20, "b": b"one two three four five six " * 20})
    assert model.classify("one two three") == ("a", 0.0, True)
    assert language.LanguageModel({"a": b"one two three four " * 20}).classify("zzz") == ("a", 1.0, False)
