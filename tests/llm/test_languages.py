import pytest

from millrace.llm import languages
from millrace.llm.languages import analyse, detect, detected, fit, is_other, label_column, label_language, pieces, words_of

TEXTS = {
    "en": "The cache is warm and the parser keeps the rows. We measured the time it took to read a page and what it cost.",
    "de": "Der Zwischenspeicher ist warm und die Zeilen bleiben. Wir haben gemessen, wie lange das Lesen einer Seite dauert.",
    "fr": "Le cache est chaud et les lignes restent. Nous avons mesuré le temps que prend la lecture d'une page entière.",
    "es": "La caché está caliente y las filas se quedan. Medimos el tiempo que tarda en leerse una página entera.",
    "zh": "缓存很热，行会保留。我们测量了读取一页所需要的时间，结果很稳定。",
    "ja": "キャッシュは温かく、行は残ります。ページを読むのにかかる時間を測りました。",
}


@pytest.fixture(scope="module")
def model():
    return fit([(lang, words_of(t)) for lang, t in TEXTS.items() for _ in range(4)])


def test_labels(spark):
    for label, lang in {"en": "en", "EN-us": "en", "zh-Hans": "zh", "Chinese": "zh", "deu": "de", "Spanish": "es", "jpn": "ja", " fr_FR ": "fr", "": None, None: None, "und": None, "unknown": None, "klingon": "?"}.items():
        assert label_language(label) == lang
        df = spark.createDataFrame([(label,)], "l string")
        assert df.select(label_column(df["l"]).alias("v")).first()["v"] == lang


def test_detection(model):
    for lang, t in TEXTS.items():
        found, confidence = detect(words_of(t), model)
        assert found == lang
        assert confidence > 0.8
    assert detect([], model) == (None, 0.0)
    # unseen words by their n-grams
    assert detect(words_of("Zwischenspeichern gemessener Seitenlesung"), model)[0] == "de"


def test_wrong_labels_are_outvoted():
    samples = [(lang, words_of(t)) for lang, t in TEXTS.items() for _ in range(9)]
    samples += [("en", words_of(TEXTS["zh"])), ("de", words_of(TEXTS["en"]))]
    noisy = fit(samples)
    assert all(detect(words_of(t), noisy)[0] == lang for lang, t in TEXTS.items())


def test_pieces():
    text = "---\nlayout: post\n---\n\n# Title\n\nProse one\n\n```\ncode\n\nmore code\n```\n\n$$\nx\n\ny\n$$\n\n![alt](i.png)\n\n> quote\n\n{{ title }}\n\n- item"
    assert [n for n, _ in pieces(text)] == [2, 8, 10]
    assert pieces("") == []


def test_documents(model):
    found = analyse(f"{TEXTS['en']}\n\n# Kopf\n\n{TEXTS['de']}\n\n{TEXTS['en']}", model)
    assert found.language == "en"
    assert [(n, lang) for n, lang, _ in found.foreign] == [(2, "de")]
    # a piece that is partly in the main language is not foreign
    mixed = analyse(f"{TEXTS['en']}\n\n{TEXTS['en']}\n\n{TEXTS['de']} {TEXTS['de']} {TEXTS['en']}", model)
    assert mixed.foreign == []
    assert analyse("# only a heading", model).language is None


def test_look_alike_letters_do_not_mislead(model):
    assert analyse("Thе cаchе is wаrm аnd thе раrsеr kеерs thе rоws.", model).language == "en"


FOREIGN = {
    "it": "La luna saliva piano sopra i tetti mentre il vecchio fornaio apriva la bottega. Ogni mattina metteva il pane ancora caldo nelle ceste e aspettava che i ragazzi scendessero verso la piazza.",
    "pt": "Ontem à noite choveu muito e ninguém quis sair de casa. O meu avô ficou perto da janela, a ouvir as gotas, e contou-nos como era a aldeia quando ainda não havia luz.",
    "nl": "Gisteren hebben wij met onze buren een lange wandeling door het bos gemaakt. Er lag veel sneeuw, maar de kinderen vonden dat juist leuk en wilden nog niet naar huis.",
    "ru": "Вчера вечером пошёл сильный дождь, и никто не хотел выходить из дома. Дедушка сидел у окна и рассказывал нам, какой была деревня, когда ещё не было света.",
    "ko": "어제 저녁에는 비가 많이 와서 아무도 밖에 나가려고 하지 않았다. 할아버지는 창가에 앉아 전기가 없던 시절의 마을 이야기를 들려주셨다.",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_other_languages(spark, data, trained, lang):
    found = analyse(FOREIGN[lang] + "\n\n" + FOREIGN[lang], trained)
    assert (found.language, found.foreign) == ("other", [])


def test_a_label_of_another_language_is_right_there(spark, data, trained):
    """Neither p2_found's label rows nor its pieces flag a text beyond the model's languages."""
    rows = [(i, t) for i, t in enumerate(FOREIGN.values())]
    assert [r["lang"] for r in detected(spark.createDataFrame(rows, "article_id long, markdown string"), trained).collect()] == ["other"] * len(rows)


def test_short_pieces_keep_their_language(trained):
    assert analyse("Votre session a expiré.", trained).language == "fr"
    assert not is_other(0, 4)
    assert is_other(0, 12)


@pytest.fixture(scope="module")
def trained(spark):
    small = "/root/testdata/sf0.01"
    return languages.train(*(languages.read_table(spark, small, *t) for t in (("article", "article_id", "markdown"), ("language_detection", "article_id", "language"))))


def test_rows(spark, model):
    rows = [(1, TEXTS["fr"], "x"), (1, TEXTS["fr"], "x"), (2, None, None), (3, "", "y"), (4, TEXTS["en"] * 3000, None), (None, TEXTS["ja"], "z")]
    df = spark.createDataFrame(rows, "article_id long, markdown string, lang string")
    got = sorted((str(r["article_id"]), r["piece_no"], r["lang"]) for r in detected(df, model).collect())
    assert got == [("1", -1, "fr"), ("1", -1, "fr"), ("4", -1, "en"), ("None", -1, "ja")]
    assert detected(df.limit(0), model).count() == 0
    empty = languages.train(df.limit(0), spark.createDataFrame([], "article_id long, language string"))
    assert detect(["the"], empty) == (None, 0.0)


def test_query(spark, data):
    assert languages.p2_found(spark, data).columns == ["article_id", "piece_no", "lang"]
    assert languages.p2_languages(spark, data).count() > 0
