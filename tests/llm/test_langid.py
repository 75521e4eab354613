import pytest
from pyspark.sql import functions as F

from foliant.llm import langid
from foliant.plans.staging import scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    df = scan(spark, SF, "records").where("unit_type = 'region'").select(F.col("ocr.full_text").alias("t"), F.col("ocr.language").alias("l"))
    return langid.fit(df, "t", "l", rows=300)


TEXTS = {"es": "El vigilante nocturno traslada la receta de membrillo durante la sobremesa.", "ca": "El vigilant nocturn demana una xerrada sobre higiene durant l'assaig general.",
         "fr": "Le gardien de nuit demande la recette de confiture après les nouvelles.", "en": "The night watchman interrupts a talk on hygiene after the news of the day.",
         "it": "Il guardiano notturno presenta il programma del pomeriggio dopo il notiziario.", "de": "Der Nachtwächter wiederholt beim alten Kai die Liste der Preise und die Lieder."}


def test_sentences_of_each_language(model):
    got = model.classify(list(TEXTS.values()))
    assert [langid.LANGUAGES[i] for i in got["language"]] == list(TEXTS)
    assert (got["confidence"] > 0.9).all() and (got["confidence"] <= 1).all()


def test_held_out_accuracy(spark, model):
    df = scan(spark, "/root/testdata/sf0.1", "documents").where("length(text) > 300").select("text", langid.language_code(F.col("lang")).alias("l")).where("l is not null").limit(600)
    rows = df.collect()
    got = model.classify([r.text for r in rows])
    main = {}
    for t, l, w in zip(got["text"], got["language"], got["words"]):
        main.setdefault(t, {}).setdefault(l, 0)
        main[t][l] += w
    right = sum(langid.LANGUAGES[max(v, key=v.get)] == rows[t].l for t, v in main.items())
    assert right / len(main) > 0.85  # the labels themselves are wrong in part


def test_lost_full_stop_is_found(model):
    text = TEXTS["es"].rstrip(".") + " " + TEXTS["en"]
    assert [langid.LANGUAGES[i] for i in model.classify([text])["language"]] == ["es", "en"]


def test_frames(spark, model):
    mixed = TEXTS["es"] + " " + TEXTS["fr"] + " Fin."
    rows = [("a", TEXTS["ca"]), ("b", mixed), ("c", None), ("d", ""), ("e", "   "), ("f", "Visto."), ("b", mixed), ("g", TEXTS["de"] * 400)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "key string, text string, lang string")
    got = {(r.key, r.lang) for r in langid.languages(df, ["key"], "text", model).collect()}
    assert got == {("a", "ca"), ("b", "es"), ("b", "fr"), ("g", "de")}
    s = langid.stretches(df.distinct(), ["key"], "text", model).where("key = 'b'").orderBy("stretch_no").collect()
    assert [r.lang for r in s] == ["es", "fr"] and s[0].start_pos == 0 and s[-1].end_pos == len(mixed)
    assert langid.languages(df.limit(0), ["key"], "text", model).count() == 0
    assert langid.fit(df.limit(0), "text", "lang") is None


def test_label_notations(spark):
    labels = ["es", "ES", "spa", "castellano", "es-ES", "català", "ca-ES", "und", "", None, "?", "zxx", "fra", "deu"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    got = [r[1] for r in df.select("i", langid.language_code(F.col("l"))).orderBy("i").collect()]
    assert got == ["es"] * 5 + ["ca"] * 2 + [None] * 5 + ["fr", "de"]


def test_abbreviations_end_no_sentence():
    t = "El tenor J. Darmanco Rebrol recoge el boletín. La locutora Hort. Siarneñir lee despacio. LOCUTOR.— El coro canta."
    assert [t[a:b][:8] for a, b in langid.sentences(t)] == ["El tenor", "La locut", "LOCUTOR.", "El coro "] or [t[a:b][:8] for a, b in langid.sentences(t)] == ["El tenor", "La locut", "LOCUTOR."]
