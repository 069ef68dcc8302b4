"""The three-document golden set: what must be found, and what must not."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.analysis import exact_terms, number_terms, russian_stem
from quarrylight.operators import search as S

#: The golden rows: an act with its number in the title, spring news, an act whose number is written with blanks and a Latin letter.
ROWS = [
    ("a", "https://h/doc-512", "Постановление № 512-р о предоставлении субсидий", None, "Администрация города постановляет предоставить субсидии субъектам малого и среднего предпринимательства. Ёлочные мероприятия проводятся в декабре.", "512-р", "постановление", "legal", "pdf", True, "2024-03-14"),
    ("b", "https://h/news", "Новости города: весенние мероприятия", None, "В городе прошли весенние мероприятия. Елка была установлена на центральной площади.", None, None, "news", "page", False, "2024-04-01"),
    ("c", "https://h/doc-84", "Распоряжение о выделении помещения", "Распоряжение № 84-РС от 2 июня 2023 года", "Администрация города распоряжается выделить помещение для работы комиссии по вопросам благоустройства территории. Справка о составе семьи выдаётся заявителю.", "№ 84 – PC", "распоряжение", "legal", "pdf", True, "2023-06-02"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    schema = "chunk_id string, url string, title string, attachment_title string, text string, document_number string, document_kind string, content_category string, doc_type string, is_attachment boolean, sort_date string"
    folder = str(tmp_path_factory.mktemp("index"))
    S.publish(S.build_index(spark.createDataFrame(ROWS, schema).withColumn("chunk_number", F.lit(1))), folder, "v1")
    return S.current(spark, folder)


def urls(result):
    return [r.url.split("/")[-1] for r in result.items.collect()]


def test_golden_queries(index):
    find = lambda q, **how: urls(S.search(index, q, **how))
    assert "news" in find("ёлка")
    assert find("512-р")[0] == "doc-512" and find("84-рс")[0] == "doc-84"
    assert find("«справка о составе семьи»") == ["doc-84"]
    assert S.run_query(index, "«семьи составе о справка»").count() == 0
    assert S.run_query(index, "благоустройства").count() == 1 and S.run_query(index, "благоустройства -комиссии").count() == 0
    assert find("субсидии", category="legal") == ["doc-512"]
    assert find("мероприятия", category="news") == ["news"]
    assert find("", date_from="2024-03-01", date_to="2024-03-31") == ["doc-512"]
    assert find("", number="84-рс") == ["doc-84"] and find("", number="N512-P") == ["doc-512"]
    assert find("", kind=" Постановление ", category=None) == ["doc-512"]
    assert sorted(find("", attachment=True)) == ["doc-512", "doc-84"]


def test_lemmas_find_other_inflections(index):
    for q in ("благоустройство территорий", "постановления о предоставлении субсидии", "составом семьи"):
        assert S.run_query(index, q).count() == 1, q
    assert S.run_query(index, "«составу семьи»").count() == 1  # a quoted phrase may stand in its lemmas
    assert S.run_query(index, "и в на о").count() == 0
    near, far = (S.run_query(index, q).first().score for q in ("весенние мероприятия", "весенний мероприятие"))
    assert near > far  # exact phrases rank above lemmas


def test_a_phrase_reads_no_text(spark, index, tmp_path):
    S.publish(index, str(tmp_path), "v1")
    stored = S.current(spark, str(tmp_path))
    for part in (S.quoted(stored, "справка о составе"), S.match_terms(stored, "комиссии"), S.phrase_scores(stored, "вопросам благоустройства", "text", slop=2)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "/chunks" not in plan and "In(term" in plan or "EqualTo(term" in plan


def test_slop_is_one_budget(spark):
    rows = [("1", "one two three"), ("2", "one x two y three"), ("3", "two one three"), ("4", "one x x two x x three"), ("5", "one two")]
    tiny = S.build_index(spark.createDataFrame(rows, "chunk_id string, text string"))
    found = lambda slop: {r.chunk_id for r in S.phrase_scores(tiny, "one two three", "text", slop=slop).collect()}
    assert found(0) == {"1"} and found(1) == {"1"} and found(2) == {"1", "2", "3"} and found(4) == {"1", "2", "3", "4"}


def test_facets_ignore_the_category(index):
    r = S.search(index, "", category="news", doc_type="page")
    assert {x.category: x.n for x in r.facets.collect()} == {"all": 1, "legal": 0, "news": 1, "announcement": 0, "media": 0, "file": 0}
    assert r.total.first().total == 1


def test_misspelt_query_falls_back(index):
    r = S.search(index, "меропрыятия")
    assert r.mode == "fuzzy" and "news" in urls(r)


@pytest.mark.parametrize(
    ("raw", "text", "phrases", "excluded"),
    [("«состав семьи» справка", "справка", ("состав семьи",), ()), ("512-р", "512-р", (), ()), ("парк -елка", "парк", (), ("елка",)), ('"a b" "a b"', "", ("a b",), ()), ("-одно", "", (), ("одно",)), ('"незакрытая', '"незакрытая', (), ())],
)
def test_parse(raw, text, phrases, excluded):
    assert S.parse(raw) == S.Query(text, phrases, excluded)


def test_needed():
    assert [S.needed(n) for n in (1, 2, 3, 4, 5, 8)] == [1, 2, 3, 3, 3, 6]


def test_options():
    for how in ({"raw": "x"}, {"raw": ""}, {"raw": "ab", "sort": "up"}, {"raw": "ab", "limit": 51}, {"raw": "ab", "date_from": "2024-02-01", "date_to": "2024-01-01"}):
        with pytest.raises(ValueError):
            S.check_options(**how)


def test_analyzers(spark):
    r = spark.sql("SELECT '512-р Постановления ёлка' AS v").select(exact_terms(F.col("v")).alias("e"), number_terms(F.lit("512-р")).alias("n")).first()
    assert r.e == ["512", "р", "постановления", "елка"] and r.n == ["512", "р", "512р"]
    assert russian_stem("постановления") == russian_stem("постановление") == "постановлен"
    from quarrylight.functions.analysis import english_stem, lemma

    assert [english_stem(w) for w in ("caresses", "conflated", "hopping", "relational", "vietnamization", "adjustable", "controll", "sky", "by")] == ["caress", "conflat", "hop", "relat", "vietnam", "adjust", "control", "sky", "by"]
    assert lemma("на") is None and lemma("running") == "run"
    assert [russian_stem(w) for w in ("важный", "важная", "книги", "книга", "читать", "красивейший", "к")] == ["важн", "важн", "книг", "книг", "чита", "красив", "к"]


def test_published_versions(spark, index, tmp_path):
    S.publish(index, str(tmp_path), "v1")
    small = S.build_index(index.chunks.where("chunk_id = 'b'"))
    S.publish(small, str(tmp_path), "v2")
    assert S.current(spark, str(tmp_path)).chunks.count() == 1 and S.current(spark, str(tmp_path)).stats.count() == 8
    S.point_to(spark, str(tmp_path), "v1")
    assert urls(S.search(S.current(spark, str(tmp_path)), "субсидии")) == ["doc-512"]


def test_number_clauses_rank(spark):
    rows = [("n1", "u/n1", "Акт", "о парке 512-р", None), ("n2", "u/n2", "Акт", "512-р 512-р 512-р", "77-р"), ("n3", "u/n3", "Акт", "номер 512-р в длинном тексте о парке", "512-р"), ("n4", "u/n4", "Акт", "номер 512-р в тексте", "N 512 - Р")]
    numbered = S.build_index(spark.createDataFrame(rows, "chunk_id string, url string, title string, text string, document_number string"))
    plain = S.build_index(numbered.chunks.drop("document_number"))
    for raw in ("512-р", "№512-р"):
        base = {r.chunk_id: r.score for r in S.run_query(plain, raw).collect()}
        more = {r.chunk_id: round(r.score - base[r.chunk_id], 6) for r in S.run_query(numbered, raw).collect()}
        assert more["n1"] == more["n2"] == 0 and more["n3"] == 40 + 32 + 24 and more["n4"] >= 40
    same = lambda i: {r.chunk_id: r.score for r in S.run_query(i, "парке").collect()}
    assert same(numbered) == same(plain)


def test_an_index_that_is_not_published_makes_the_asked_postings_alone(spark):
    """Of both analyzers, with the statistics of all terms, and what they score is what the whole index scores."""
    rows = [("1", "u/1", "Running ships", "the ship runs and the ships run"), ("2", "u/2", "", "ёлка и ship yards"), ("3", "u/3", None, None)]
    whole = S.build_index(spark.createDataFrame(rows, "chunk_id string, url string, title string, text string"))
    some = S.asked(whole, {"exact": ["ship"], "lemma": ["run", "ship"]})
    keys = lambda df: sorted((r.kind, r.field, r.term, r.chunk_id, r.tf, r.len, tuple(r.positions)) for r in df.collect())
    want = [p for p in keys(whole.postings) if p[2] == "ship" or p[:1] + p[2:3] == ("lemma", "run")]
    assert keys(some.postings) == want and len(want) == 7
    assert sorted(map(tuple, some.stats.collect())) == sorted(map(tuple, whole.stats.collect()))
    begun = S.asked(whole, {}, ("text",), {"lemma": {"e"}}).postings.collect() + S.asked(whole, {}, ("text",), {"lemma": {"е"}}).postings.collect()
    assert [(r.term, r.chunk_id) for r in begun] == [("елк", "2")]
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert scans(S.term_scores(whole, ["ship"])) == 0 and scans(S.phrase_scores(whole, "the ship", "text")) == 1
