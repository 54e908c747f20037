import random

from pyspark.sql import functions as F

from samewise.llm import language as L

WORDS = {
    "en": "the of and house tree with water there which light over under small".split(),
    "de": "der die und haus baum mit wasser welche licht über unter klein schön".split(),
    "fr": "le la et maison arbre avec eau lequel lumière dessus petit être".split(),
}


def corpus(n=600):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([6, 30, 200]))), lang, "other"))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    dicts = L.learn(df.where(L.fold(F.col("doc_id"), 5) != 0))
    assert sorted(dicts) == sorted(WORDS)
    got = {r.id: r for r in L.identify(df, dicts).collect()}
    import zlib

    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {r.doc_id for r in df.where(L.fold(F.col("doc_id"), 5) == 0).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, x string")
    dicts = L.learn(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ... _"), (5, "½ ² ① Ⅷ ٣"), (None, "der die und haus"), (4, "the house with water " * 100_000), (4, "the house with water " * 100_000)], "doc_id long, text string")
    got = sorted((str(r.id), r.lang_pred) for r in L.identify(odd, dicts).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "und"), ("None", "de")]
    assert L.learn(df.where(F.lit(False))) == {} and L.learn(df.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert {r.lang_pred for r in L.identify(odd, {}).collect()} == {"und"}
    assert L.identify(odd.limit(0), dicts).count() == 0


def test_every_language_is_learned_however_many(spark, monkeypatch):
    monkeypatch.setattr(L, "ALL_BYTES", 1 << 17)
    rows = [(i, f"lang{i} " * 60, f"l{i}") for i in range(1200)] + [(5000 + i, WORDS["en"][i % 8] * 3, "en") for i in range(300)]
    dicts = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(dicts) == 1201 and sum(map(len, dicts.values())) <= 1201 * 256


def brute(rows, dicts):
    """(id, held_out, lang_pred, score) one text at a time, with compressors made afresh."""
    import zlib

    import zstandard

    out = []
    for i, t, *_ in rows:
        held = zlib.crc32(str(i).encode()) % 5 == 0
        if not t or not any(c.isalpha() for c in t):
            out.append((i, held, "und", 0.0))
            continue
        sizes = {}
        for name, raw in dicts.items():
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = len(c.compress(t.encode()))
        best = min(sizes.items(), key=lambda x: (x[1], x[0]))
        out.append((i, held, best[0], round(1 / sum(2.0 ** (-L.SHARP * min(s - best[1], 2000)) for s in sizes.values()), 9)))
    return out


def test_query_matches_brute_force(spark, tmp_path):
    rows = corpus(150) + [(900, None, "en", "x"), (901, "12", "de", "x"), (902, "der die", None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dicts = L.learn(docs.where(L.fold(F.col("doc_id"), 5) != 0))
    got = L.op9_language_id(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(brute(rows, dicts))


def test_narrow_margins_are_rejected():
    same = b"common words here xyzxyz" * 20
    c = L._compressors((("a", same), ("b", same)))
    assert L.classify("common words here", c)[0] == "a" and L.classify("common words here", c)[2] is False


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(5000 if lang == "fr" else 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t.encode()) for _, t, lang in rows if lang == "fr") > L.SAMPLE_BYTES
    dicts = L.learn(df)
    assert sorted(dicts) == sorted(WORDS) and all(len(d) <= L.DICT_BYTES for d in dicts.values())
    got = {r.id: r.lang_pred for r in L.identify(df, dicts).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
