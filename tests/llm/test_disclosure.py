"""Personal information: patterns, names learnt from the corpus, placeholders."""

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import disclosure as d

NAMES = {d.stem(x) for x in ("Марфа", "Тихонов", "Лавр", "Alaric", "Oakvale", "O'Brackney", "Ashgrove-Lyle")}


@pytest.fixture(scope="module")
def untaught(spark):
    """What is known of terms before any text is read."""
    return {(r.type, r.term): r.bits for r in d.revealing_terms(spark.createDataFrame([], "text string")).collect()}


def spans(text, told, least=d.LEAST_BITS):
    case = d.letter_case(text)
    s = d.disclosed(d.proposals(text, case), lambda kind, term: told.get((kind, term), 0.0), least)
    return s + d.name_spans(text, s, case, lambda w: d.stem(w) in NAMES)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Пиши на k.t+ci@mail.kite.example.", [("EMAIL", "k.t+ci@mail.kite.example")]), ("to <lavr(собака)почта.example>", [("EMAIL", "lavr(собака)почта.example")]),
        ("cc: a-b [at] post [dot] example;", [("EMAIL", "a-b [at] post [dot] example")]), ("darina.v at mail dot sable dot invalid", [("EMAIL", "darina.v at mail dot sable dot invalid")]),
        ("remote: git@host.example:a/b.git", []), ("ssh deploy@10.1.2.3", []), ("ssh deploy@box.example", []), ("garnet@8.28.10", []), ("ping @kite-bot", []), ("Looked at core/anchor.go", []),
        ("тел. +7 973 832 83 63.", [("PHONE", "+7 973 832 83 63")]), ("Набрал 89466294887, тишина", [("PHONE", "89466294887")]), ("Call (503) 555-0161 now", [("PHONE", "(503) 555-0161")]),
        ("+7 972 195‑56‑69", [("PHONE", "+7 972 195‑56‑69")]), ("202.555.0135,", [("PHONE", "202.555.0135")]), ("+44 20 7946 0888", [("PHONE", "+44 20 7946 0888")]),
        ("счёт 89466294887 закрыт", []), ("range 147-66-2162 rows", []), ("ts=1734013262549", []), ("заявка 4136 064219", []), ("trace 339514413453", []), ("2026-04-27 16:17", []),
        ("ИНН 427594459014", [("ID", "427594459014")]), ("вбил свой СНИЛС, вот он 281-158-152 93, да", [("ID", "281-158-152 93")]), ("0601 994865 is the паспорт on file", [("ID", "0601 994865")]),
        ("паспорт 31 20 № 179663;", [("ID", "31 20 № 179663")]), ("typed my SSN by mistake, 935-40-2449.", [("ID", "935-40-2449")]), ("987 08 0501 is the SSN", [("ID", "987 08 0501")]),
        ("адрес ул. Маячная, д. 117, кв. 85.", [("ADDRESS", "ул. Маячная, д. 117, кв. 85")]), ("переехал на ул гончарная слобода 103 кв 136.", [("ADDRESS", "ул гончарная слобода 103 кв 136")]),
        ("Доставка: Осенний пер., д.163 к.2, кв.92", [("ADDRESS", "Осенний пер., д.163 к.2, кв.92")]), ("дома, Часовой переулок, 30-287.", [("ADDRESS", "Часовой переулок, 30-287")]),
        ("at пр-т Первых Зимовщиков, 50/2, оф. 184", [("ADDRESS", "пр-т Первых Зимовщиков, 50/2, оф. 184")]), ("to Flat 41, 62 Quarry Terrace now", [("ADDRESS", "Flat 41, 62 Quarry Terrace")]),
        ("home, 164 Old Ferry Ave., Apt 25.", [("ADDRESS", "164 Old Ferry Ave., Apt 25")]), ("fast lane 22", []), ("шаг 11 корпус тестов 7", []),
        ("отправил Марфе Тихоновой.", [("NAME", "Марфе Тихоновой")]), ("без Тихонова Л. Т. не мержим", [("NAME", "Тихонова Л. Т.")]), ("ask М. К. Тихонов first", [("NAME", "М. К. Тихонов")]),
        ("МАРФА ТИХОНОВА БЫЛА ТАМ С НАМИ", [("NAME", "МАРФА ТИХОНОВА")]), ("решил лавр тихонов и всё", [("NAME", "лавр тихонов")]), ("Oakvale, Alaric said", [("NAME", "Oakvale, Alaric")]),
        ("with Alaric K. O'Brackney there", [("NAME", "Alaric K. O'Brackney")]), ("Alaric Ashgrove-Lyle", [("NAME", "Alaric Ashgrove-Lyle")]), ("Марфа Лавровна в отпуске", [("NAME", "Марфа Лавровна")]),
        ("Спасибо, Марфа", []), ("the Alaric cluster", []), ("thanks, Alaric, Лавр Тихонов owns this", [("NAME", "Лавр Тихонов")]), ("", []), (" \n", []),
    ],
)
def test_spans(text, wanted, untaught):
    assert sorted((k, text[a:b]) for a, b, k in spans(text, untaught)) == sorted(wanted)


def test_placeholders_keep_the_rest(untaught):
    text = "Марфа Тихонова: a@b.example, +7 973 832 83 63"
    assert d.sanitise(text, spans(text, untaught)) == "[NAME]: [EMAIL], [PHONE]"


@pytest.mark.parametrize("forms", [("Ника", "Нике", "Никой", "Нику"), ("Лавр", "Лавра", "Лавром"), ("Тихонов", "Тихоновой", "Тихоновым", "Тихонову"), ("Савелий", "Савелия", "Савелию"), ("Oakvale", "OAKVALE")])
def test_stems_join_case_forms(forms):
    assert len({d.stem(f) for f in forms}) == 1


CORPUS = ["спросил с Игнатом Заозёрцевым сегодня", "ask Игнат Заозёрцев first", "жду ответа от Игната Заозёрцева", "with Merrin Vexley again", "by Merrin Vexley yes", "просто текст про порт", "the port is open", "no names here at all"]


def test_terms_are_learnt_from_the_corpus(spark):
    texts = spark.createDataFrame([(t,) for t in [*CORPUS, None, ""]], "text string")
    names = lambda df: {r.term for r in d.revealing_terms(df).where("type = 'NAME'").collect()}
    got = names(texts)
    assert {d.stem(x) for x in ("Игнат", "Заозёрцев", "Merrin", "Vexley")} <= got
    assert not got & {d.stem(x) for x in ("порт", "port", "ask", "текст")}
    assert not names(texts.where("false"))


@pytest.mark.parametrize("name", ["Łukasz Żółć", "José Núñez", "Jürgen Müller", "Ðorđe Šarić", "Αλέξης Νικολάου"])
def test_names_of_any_alphabet_with_cases(spark, name):
    texts = [f"they called {name} yesterday", f"we asked {name} again", "nobody was there"]
    df = spark.createDataFrame([("messages", i, t) for i, t in enumerate(texts)], "src string, rec_no long, text string")
    assert [[s.pii_value for s in r.spans] for r in d.detect(df, d.revealing_terms(df.select("text"))).orderBy("rec_no").collect()] == [[name], [name], []]


def corpus_of_numbers():
    """Phones with and without a plus after the same words, and numbers of the phones' very form after another word."""
    phones = [f"dial {p} now" for k in range(40) for p in (f"+1 415 555 {1000 + k}", f"415.555.{1000 + k}")]
    parcels = [f"parcel 907.555.{1000 + k} left" for k in range(40)]
    mails = [f"write to user{k}@post.example please" for k in range(40)] + [f"mount vol{k}@10.0.0.{k} first" for k in range(40)]
    cards = [f"СНИЛС {100 + k}-158-152 93" for k in range(40)] + [f"номер {100 + k}-58-1529 строк" for k in range(40)]
    streets = [f"live at {k + 1} Quarry Terrace now" for k in range(20)]
    return [*phones, *parcels, *mails, *cards, *streets, *CORPUS]


def found_at(spark, texts, least):
    df = spark.createDataFrame([("messages", i, t) for i, t in enumerate(texts)], "src string, rec_no long, text string")
    rows = d.detect(df, d.revealing_terms(df.select("text"), least), least).collect()
    return {(s.pii_type, s.pii_value) for r in rows for s in r.spans}


def test_what_stands_next_to_a_number_decides(spark):
    got = found_at(spark, corpus_of_numbers(), d.LEAST_BITS)
    phones = {v for k, v in got if k == "PHONE"}
    assert len(phones) == 80 and not any(v.startswith("907") for v in phones)  # "parcel" is in no list: the corpus tells
    assert len({v for k, v in got if k == "EMAIL"}) == 40 and len({v for k, v in got if k == "ID"}) == 40


def test_the_threshold_moves_the_rows_of_every_type(spark):
    at = {least: found_at(spark, corpus_of_numbers(), least) for least in (-30.0, d.LEAST_BITS, 3.0, 40.0)}
    sizes = [{k: sum(x[0] == k for x in found) for k in ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")} for found in at.values()]
    for kind in sizes[0]:
        low, usual, high, most = (s[kind] for s in sizes)
        assert low >= usual >= high >= most == 0 and usual > 0 and (low > usual or usual > high or kind in ("ADDRESS", "NAME"))
    assert sizes[0]["PHONE"] > sizes[1]["PHONE"] > sizes[2]["PHONE"] and sizes[0]["ID"] > sizes[1]["ID"]


def tables(spark, tmp_path, contents, statements):
    spark.createDataFrame(list(enumerate(contents)), "id long, content string").withColumn("spans", F.lit("clash")).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame(list(enumerate(statements)), "fact_no long, statement string").write.parquet(f"{tmp_path}/facts.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("broadcast", [True, False])
def test_queries(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(d, "BROADCAST_TERMS", 1)
    long = "слово " * 50_000 + "a@b.example"
    folder = tables(spark, tmp_path, [*CORPUS, None, "", long, "a@b.example и a@b.example"], ["Передай Игнату Заозёрцеву", None])
    got = {(r.src, r.rec_no, r.pii_type, r.pii_value) for r in d.p3_found(spark, folder).collect()}
    assert ("facts", 0, "NAME", "Игнату Заозёрцеву") in got and ("messages", 10, "EMAIL", "a@b.example") in got
    assert sum(r[1] == 11 and r[0] == "messages" for r in got) == 1
    clean = {(r.src, r.rec_no): r.clean_text for r in d.p3_sanitised(spark, folder).collect()}
    assert clean[("facts", 0)] == "Передай [NAME]" and clean[("messages", 8)] is None and clean[("messages", 9)] == "" and clean[("messages", 5)] == CORPUS[5]
    assert len(clean) == len(CORPUS) + 6


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "id long, content string").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([], "fact_no long, statement string").write.parquet(f"{tmp_path}/facts.parquet")
    assert d.p3_found(spark, str(tmp_path)).count() == 0
