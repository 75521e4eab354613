from foliant.llm import ocr

HEADERS = ocr.Headers({"radio costaclara": {"boletin nocturno"}})
CONFUSIONS = [("n", "u"), ("m", "rn"), ("d", "cl"), ("a", "o"), ("l", "1"), ("o", "0"), ("t", "f")]


def confusions(spark):
    return spark.createDataFrame(CONFUSIONS, "seen string, misread string")


def test_furniture():
    t = "Pág. 7\nEl coro ensaya sin que nadie lo hubiera\nRadi0 Costaclara — Boletín nocturno\nprevisto."
    assert ocr.strip_furniture(t, 7, HEADERS) == ("El coro ensaya sin que nadie lo hubiera\nprevisto.", True, True)
    flat = "El coro ensaya sin que nadie lo hubiera Radio Costaclara — Boletín nocturno previsto. Pág. 7"
    s, h, n = ocr.strip_furniture(flat, 7, HEADERS)
    assert h and n and " ".join(s.split()) == "El coro ensaya sin que nadie lo hubiera previsto."
    for mark in ("[3]", "(3)", "- 3 -", "— 3 —", ". 3 .", "3", "Hoja núm. 3"):
        assert ocr.strip_furniture(f"{mark}\nEl coro canta todos los días en la plaza mayor.", 3, HEADERS)[2], mark
    assert ocr.strip_furniture("El coro canta en la plaza. 3 La banda toca.", 3, HEADERS)[2]
    for plain in ("El día 3 canta el coro.", "A las 3:15 canta el coro.", "VOZ 3: El coro canta.", "", "Quedan 3 cartas."):
        assert ocr.strip_furniture(plain, 3, HEADERS) == (plain, False, False)


def test_misread_page_numbers():
    for mark in ("- I2 -", "(l)", ". O .", "[l0]", "Pág. l", "— I —"):
        s, _, n = ocr.strip_furniture(f"El coro canta en la plaza mayor {mark} todos los días.", 1, HEADERS)
        assert n and " ".join(s.split()) == "El coro canta en la plaza mayor todos los días.", mark
    for line in ("Pág. l", "- l -"):
        assert ocr.strip_furniture(f"El coro canta\n{line}\nen la plaza.", 7, HEADERS) == ("El coro canta\nen la plaza.", False, True)
    for plain in ("He said - I - that it rains.", "La parte (II) del programa.", "L'home i l'altre, O bé.", "folio"):
        assert ocr.strip_furniture(plain, 7, HEADERS) == (plain, False, False)


def test_divided_words():
    got = ocr.divided_words("el re-\nsultado y l'emis‐\n  sor, hig¬ iene, mi- \nentras Fizuix-Dolvirmuga pre- cio; 3-\nx")
    assert [(a, b) for _, _, a, b in got][:5] == [("re", "sultado"), ("emis", "sor"), ("hig", "iene"), ("mi", "entras"), ("pre", "cio")]
    assert ocr.divided_words("x" * 100000 + "-" * 1000) == []


def words(spark, counts):
    return spark.createDataFrame([(w, n, n) for w, n in counts.items()], "word string, n long, n_low long")


def test_corrections(spark):
    df = words(spark, {"sección": 900, "seccióu": 2, "margen": 500, "rnargen": 1, "acordado": 400, "acorclado": 1, "la": 9000, "lo": 800, "rebrol": 300, "rebro1": 1, "estrena": 4000, "estreno": 7, "espatllat": 300, "espat11at": 1, "solo": 3, "sala": 4, "x": 1, "": 1})
    names = spark.createDataFrame([("rebrol",)], "word string")
    df = df.withColumn("n_low", (df.n * (df.word != "rebrol").cast("int")))
    got = {r.word: r.right for r in ocr.corrections(df, names, confusions=confusions(spark)).collect()}
    assert got == {"seccióu": "sección", "rnargen": "margen", "acorclado": "acordado", "estreno": "estrena", "espat11at": "espatllat"}
    assert ocr.corrections(df.limit(0), names, confusions=confusions(spark)).count() == 0


def test_frequent_misreadings_at_any_size(spark):
    one = [f"el {w} canta en la {p} de la tarde" for w in ("sábado", "concierto") for p in ("plaza", "iglesia", "radio", "calle") for _ in range(25)]
    one += ["el sábad0 canta en la plaza de la tarde", "el concierfo canta en la calle de la tarde", "el concierfo canta en la radio de la tarde"]
    one += [f"voz: morgen {w} wir" for w in ("singen", "tanzen", "fahren")] + [f"un margen {w} aquí" for w in ("ancho", "largo", "fino") for _ in range(20)]
    for times in (1, 10):
        df = spark.createDataFrame([(t,) for t in one * times], "text string")
        got = ocr.corrections(ocr.count_words(df, "text"), spark.createDataFrame([], "word string"), texts=df, confusions=confusions(spark))
        assert {r.word: r.right for r in got.collect()} == {"sábad0": "sábado", "concierfo": "concierto"}
    copies = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "text string")
    assert sorted(r.text for r in ocr.distinct_texts(copies, "text").collect()) == ["a", "b"]


def regions(spark):
    body = "El coro de la parroquia ensaya el resultado del encuentro en la plaza mayor. "
    rows = [("d1", "d1_p0001", f"r{i}", body * 3) for i in range(30)]
    rows += [("d1", "d1_p0002", "a", "El coro de la parroquia ensaya el re-\nsultado del encuentro en la p1aza mayor."), ("d1", "d1_p0003", "b", None), ("d2", "d2_p0004", "c", ""),
             ("d2", "d2_p0004", "d", "Fernando Fizuix-\nDolvirmuga ensaya en la plaza."), ("d1", "d1_p0002", "a", "El coro de la parroquia ensaya el re-\nsultado del encuentro en la p1aza mayor.")]
    return spark.createDataFrame([(*r, "x") for r in rows], "document_id string, page_id string, region_id string, text string, word string")


def test_defects_and_repair(spark):
    df = regions(spark)
    counts = ocr.count_words(df, "text").cache()
    none = spark.createDataFrame([], "word string")
    fixes = ocr.corrections(counts, none, confusions=confusions(spark))
    found = ocr.find_defects(df, ["page_id", "region_id"], "text", counts, fixes, [ocr.NO_HEADERS], "page_id").distinct().cache()
    assert {(r.region_id, r.defect, r.word) for r in found.collect()} == {("a", "hyphen", "resultado"), ("a", "char", "plaza")}
    fixed = {r.region_id: r.text_repaired for r in ocr.repair(df, ["page_id", "region_id"], "text", found, [ocr.NO_HEADERS], "page_id").collect()}
    assert fixed["a"] == "El coro de la parroquia ensaya el resultado del encuentro en la plaza mayor."
    assert fixed["b"] is None and fixed["c"] == "" and fixed["d"] == "Fernando Fizuix-Dolvirmuga ensaya en la plaza."
    assert ocr.header_stems(df, "document_id", "page_id", "text").count() == 0
    assert ocr.find_defects(df.limit(0), ["page_id", "region_id"], "text", counts, fixes, [ocr.NO_HEADERS], "page_id").count() == 0


def test_many_corrections_are_joined(spark, monkeypatch):
    df = regions(spark)
    counts = ocr.count_words(df, "text").cache()
    fixes = ocr.corrections(counts, spark.createDataFrame([], "word string"), confusions=confusions(spark))
    monkeypatch.setattr(ocr, "MAX_BROADCAST", 0)
    found = ocr.find_defects(df, ["page_id", "region_id"], "text", counts, fixes, [ocr.NO_HEADERS], "page_id")
    assert {(r.region_id, r.defect, r.word) for r in found.collect()} == {("a", "hyphen", "resultado"), ("a", "char", "plaza")}


def learned(spark, rows, at_once=None):
    df = spark.createDataFrame(rows, "document_id string, page_id string, text string")
    return ocr.header_blocks(ocr.header_stems(df, "document_id", "page_id", "text").cache(), at_once)


def test_headers_are_learned_whatever_their_share(spark):
    names = [f"{a}{b} {c}" for a in ("Radi", "Antena", "Emis", "Onda", "Voz") for b in ("or", "al", "ex", "um", "ip") for c in ("Costaclara", "Montenegro", "Valdeluz", "Ribera", "Sant Pol") for _ in range(4)]
    names = [f"{n} {chr(97 + i % 4) * 5}" for i, n in enumerate(names)]
    assert len(set(names)) == 500
    shows = ["Boletín nocturno", "Tarde infantil", "Guion de tarde"]
    rows = [(f"d{i}-{j}", f"p{i}-{j}", f"{n} — {shows[j % 3]}\nEl coro canta en la plaza {j}.\nLa banda toca\ntodos los días.") for i, n in enumerate(names) for j in range(6)]
    for mastheads in (1, 25, 500):
        [h] = learned(spark, rows[: 6 * mastheads])
        assert len(h.tails) == mastheads and set(h.tails) == {ocr.fold(n) for n in names[:mastheads]}
    assert h.find("Rod1or Costaclara aaaaa") == "radior costaclara aaaaa" and h.find("El coro canta") is None
    assert len(learned(spark, rows, 100)) == 5
    # on three pages of one document; in running text and once only: no header
    rows = [("d", f"p{i}", "Hoja Azul — Carnet\nEl coro canta.\nLa banda toca.") for i in range(3)] + [("e", f"q{i}", f"Hoja Roja — Carnet {i}\nEl coro canta.") for i in range(3)]
    rows += [(f"f{i}", "r", "El coro canta\nla banda toca\nLa Reina — dicen\nse va\nhoy") for i in range(5)] + [(None, None, None), ("g", "s", "")]
    assert learned(spark, rows)[0].tails == {"hoja azul": {"carnet"}}


def test_headers_of_several_blocks_are_found(spark):
    df = spark.createDataFrame([("p_p0001", f"r{i}", f"{n} — Carnet\nEl coro canta en la plaza mayor.\nNada más.", "x") for i, n in enumerate(("Hoja Azul", "Hoja Verde", "Tren Largo"))], "page_id string, region_id string, text string, word string")
    blocks = [ocr.Headers({n: {"carnet"}}) for n in ("hoja azul", "hoja verde", "tren largo")]
    counts, none = ocr.count_words(df, "text"), spark.createDataFrame([], "word string, right string")
    found = ocr.find_defects(df, ["region_id"], "text", counts, none, blocks, "page_id")
    assert {(r.region_id, r.defect) for r in found.collect()} == {(f"r{i}", "header") for i in range(3)}
    fixed = ocr.repair(df, ["region_id"], "text", found, blocks, "page_id").collect()
    assert {r.text_repaired for r in fixed} == {"El coro canta en la plaza mayor. Nada más."}


def test_confusions_are_learned(spark):
    many = ["montaña", "ventana", "nombre", "camino", "general", "cuando", "mañana", "entero", "rueda", "calle", "canto", "tener", "manera", "persona", "terreno"]
    counts = {w: 400 for w in many} | {w.replace("n", "u", 1): 1 for w in many[:8]} | {"rueba": 1, "cal1e": 1, "ventaua": 1, "veutaua": 1}
    df = words(spark, counts)
    lettered = df.cache()
    assert {(r.seen, r.misread) for r in ocr.learn_confusions(ocr.glyph_pairs(lettered), lettered).collect()} == {("n", "u")}
    got = {r.word: r.right for r in ocr.corrections(df, spark.createDataFrame([], "word string")).collect()}
    # two misread letters in a word too; a confusion of one word is chance
    assert got["moutaña"] == "montaña" and got["veutaua"] == "ventana" and not {"rueba", "cal1e"} & set(got)


def test_words_are_counted_as_in_python(spark):
    texts = ["El re-\nsultado, el RE-  sultado y l'hora: l'Hora-punta 3·4 col·lecció.", "", None, "---", "a-b-\nc d_e ñandú-"]
    got = {(r.word, r.n, r.n_low) for r in ocr.count_words(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    assert got == {("el", 2, 1), ("resultado", 0, 0), ("y", 1, 1), ("l", 2, 2), ("hora", 1, 1), ("hora-punta", 1, 0), ("3·4", 1, 1), ("col·lecció", 1, 1), ("a-bc", 0, 0), ("d", 1, 1), ("e", 1, 1), ("ñandú", 1, 1)}
