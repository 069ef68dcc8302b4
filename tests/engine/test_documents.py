"""Formats, chunks, snippets, state and streaming on literal documents."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import legal, repair
from quarrylight.functions.metrics import edit_distance
from quarrylight.operators import chunking, discovery, present, state
from quarrylight.sources import formats
from quarrylight.streaming import leases


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = archive(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
XLSX = archive(xl__workbook_xml='<workbook><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>word</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
ODT = archive(content_xml='<d xmlns:text="t"><text:h>Head</text:h><text:p>one<text:tab/>two</text:p></d>')
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\uc1 Hello\par \u1055?\'f0\'e8 \{x\}\tab end}"
HTML = "<html><head><title>T</title><script>no()</script></head><body><nav>menu</nav><main><h1>Head &amp; more</h1><p>Body  text</p><a href='/a.pdf'>Act</a><time class='detail-content-date' datetime='2024-03-14'>x</time></main></body></html>".encode()


def test_formats(spark):
    rows = [("u1.docx", "", DOCX), ("u2.xlsx", "", XLSX), ("u3.odt", "", ODT), ("u4.rtf", "", RTF), ("u5", "text/html; charset=x", HTML), ("u6.txt", "", "привет".encode("cp1251")), ("u7.pdf", "", b"%PDF"), ("u8.docx", "", b"broken"), ("u9.exe", "", b""), ("u10.txt", "text/plain", None)]
    files = spark.createDataFrame([("https://h/" + u, t, b) for u, t, b in rows], "url string, content_type string, content binary")
    got = {r.url[10:]: r for r in formats.extract(files).collect()}
    text = lambda k: [p.text for p in got[k].pages]
    assert text("u1.docx")[0].startswith("First") and text("u1.docx")[0].endswith("a | b")
    assert text("u2.xlsx") == ["Лист: One\nword | 7"] and text("u3.odt") == ["Head\none two"]
    assert text("u4.rtf") == ["Hello\nПри {x} end"]
    h = got["u5"]
    assert (h.title, h.published, [(x.url, x.title) for x in h.links]) == ("Head & more", "2024-03-14", [("/a.pdf", "Act")]) and "menu" not in text("u5")[0] and "no()" not in text("u5")[0]
    assert text("u6.txt") == ["привет"] and text("u10.txt") == [""]
    assert got["u7.pdf"].error.startswith("metadata only") and got["u7.pdf"].title == "u7.pdf" and got["u8.docx"].error and got["u9.exe"].error == "unsupported format"


def test_pages_by_ordered_selectors():
    from quarrylight.sources import page_html as P

    press = """<html><head><title>Администрация города Сочи - Новости</title></head><body><div class="breadcrumbs"><a>Главная</a><a>Пресс-служба</a><a>Заголовок</a></div>
    <main><h1>Чужой</h1></main><div id="ajax-page-content"><h2>Заголовок</h2><p>Текст <b>новости</b>.<p>Второй абзац<div class="social">лишнее</div><span>Поделиться</span>
    <a href="/f/akt.pdf#p">Акт</a><a href="x.doc">Скачать документ</a><a href="mailto:a@b">.pdf</a><time class="detail-content-date" datetime="2024-03-14T10:00">14</time></div></body></html>"""
    r = P.read(press, "https://h/press-sluzhba/novosti/1/2/")
    assert (r["title"], r["section"], r["published"]) == ("Заголовок", "Пресс-служба", "2024-03-14")
    assert r["pages"] == ["Текст новости.\nВторой абзац\nАкт\nСкачать документ\n.pdf".replace("\nАкт\nСкачать документ\n.pdf", "\nАктСкачать документ.pdf")]
    assert r["attachments"] == [("https://h/f/akt.pdf", "Акт"), ("https://h/press-sluzhba/novosti/1/2/x.doc", "Скачать документ")]
    legal = "<body><main>main<div id='maincontent' class='content'>act<nav>n</nav></div></main></body>"
    assert P.read(legal, "https://h/normativno-pravovyye-akty/?ELEMENT_ID=1")["pages"] == ["act"]
    assert P.read(legal, "https://h/other/")["pages"] == ["main\nact"] and P.read(legal, "https://h/normativno-pravovyye-akty/?ELEMENT_ID=1")["section"].startswith("Городская власть")
    assert P.read("<p>plain", "https://h/a%20b.html")["title"] == "a b.html" and P.read("", "")["pages"] == [""]
    root = P.parse("<div class='a b' id=x><p>1</p></div><div class='a'><p role='main'>2</p></div>")
    assert [n.text() for n in P.select(root, "div.a p")] == ["1", "2"] and [n.text() for n in P.select(root, ".a.b p")] == ["1"] and [n.text() for n in P.select(root, "p[role='main']")] == ["2"] and [n.text() for n in P.select(root, "[class*='b'] p")] == ["1"]


def test_robots_rules(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /"
    rows = spark.createDataFrame([("https://h/a",), ("https://h/private/b",), (None,)], "url string")
    assert [r.url for r in formats.allowed(rows, text).collect()] == ["https://h/a"]


def test_an_inflated_sitemap_is_bounded(monkeypatch):
    monkeypatch.setattr(formats, "MOST_INFLATED", 100)
    with pytest.raises(ValueError, match="bound"):
        formats.sitemap(gzip.compress(b"<urlset>" + b" " * 1000 + b"</urlset>"))


def test_results_and_csv(spark, tmp_path):
    from quarrylight.operators import present

    assert present.snippet_query('парк «состав семьи» -елка') == "состав семьи парк"
    long = "Слово. " * 60 + "Благоустройства парка <b> касается этот абзац. " + "Ещё слово. " * 60
    found = present.highlighted(long, frozenset({"благоустройств", "парк"}))
    assert len(found) == 1 and "<mark>Благоустройства</mark> <mark>парка</mark> &lt;b&gt;" in found[0] and len(found[0]) < 420
    assert present.highlighted("нет слов " * 60, frozenset({"x"}))[0].startswith("нет слов") and present.highlighted("", frozenset()) == []
    hits = spark.createDataFrame([("c1", "https://h/press-sluzhba/novosti/1/2", "Заголовок &amp; новость", "Ёлка стоит в парке и светит всем жителям города каждый вечер до конца января.", "news", 2.0, "page"), ("c2", "https://h/x.pdf", "pdf", "@#$%^&*()!~ " * 20, None, 1.0, "pdf")], "chunk_id string, url string, title string, text string, content_category string, score double, doc_type string")
    a, b = sorted(present.results(hits, "елка").collect(), key=lambda r: r.id)
    assert a.title == "Заголовок & новость" and "Ёлка" in a.snippet and a.content_category == "news" and len(a.asDict()) == 37
    assert b.snippet == present.GARBLED_PDF
    present.write_csv(spark.createDataFrame([("=1", 'a"b'), (None, "x;y")], "f string, g string").coalesce(1), str(tmp_path / "c"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*")))
    assert raw.decode("utf-8") == '\ufeff"f";"g"\r\n"\'=1";"a""b"\r\n"";"x;y"\r\n'


def test_sitemaps():
    body = b'<urlset xmlns="s"><url><loc>https://h/a</loc><lastmod>2024</lastmod></url><url><loc>https://h/b</loc></url></urlset>'
    assert formats.sitemap(gzip.compress(body)) == ([], [("https://h/a", "2024"), ("https://h/b", None)])
    assert formats.sitemap(b"<sitemapindex><sitemap><loc>https://h/m.xml</loc></sitemap></sitemapindex>") == (["https://h/m.xml"], [])
    assert formats.robots("User-agent: *\nSitemap: https://h/s.xml\n") == ["https://h/s.xml"]


@pytest.mark.parametrize("n", [0, 1, 499, 500, 3500, 3501, 20000])
def test_chunks_cover_the_text(n):
    text = ("word. " * 4000)[:n].strip()
    pieces = chunking.cut(text)
    assert all(len(p) <= chunking.SIZE for p in pieces)
    at = 0
    for p in pieces:
        found = text.find(p, max(0, at - chunking.OVERLAP - 2))
        assert 0 <= found <= at + 1
        at = found + len(p)
    assert at >= len(text) - 1 if text else pieces == []


def test_chunk_numbers_run_over_pages(spark):
    pages = spark.createDataFrame([("u", 1, "a " * 3000), ("u", 2, "b"), ("u", 3, ""), ("v", 1, None)], "url string, page_number int, text string")
    got = chunking.chunks(pages).orderBy("chunk_number").collect()
    assert [(r.page_number, r.chunk_number) for r in got] == [(1, 1), (1, 2), (2, 3)] and len({r.chunk_id for r in got}) == 3


def test_snippets(spark):
    text = "Начало. " + "Пустые слова здесь. " * 30 + "Нужный субсидии раздел находится тут. " + "Конец. " * 60
    s = present.snippet_of(text, "что субсидии раздел")
    assert "субсидии" in s and s.startswith("…") and s.endswith("…") and len(s) <= 521
    assert present.snippet_of("кратко", "нет") == "кратко"
    items = spark.createDataFrame([("u", "t", "one two", 2.0), ("v", "t", "one two", 1.0)], "url string, title string, text string, score double")
    a = present.answer(present.snippets(items, "two")).first()
    assert a.source_count == 2 and a.answer.count("•") == 1
    assert present.answer(present.snippets(items.limit(0), "two")).first().answer == present.NOTHING


def test_repair_and_acts(spark):
    cases = ["№ 512 – Р", "N512-P", "512—р", None]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cases], "v string").select(repair.document_number(F.col("v"))).collect()] == ["512-р", "512-р", "512-р", ""]
    assert repair.mixed_word("Cочи") == "Сочи" and repair.mixed_word("Zлово") == "Zлово"
    dates = ["14.03.2024", "2 июня 2023 года", "30.02.2024", "вчера", None]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in dates], "v string").select(legal.russian_date(F.col("v"))).collect()] == ["2024-03-14", "2023-06-02", None, None, None]
    assert edit_distance("kitten", "sitting") == 3 and edit_distance("ab".split(), []) == 1


def test_discovery(spark):
    known = spark.createDataFrame([("https://h/old/",)], "url string")
    sitemap = spark.createDataFrame([("https://h/old", "sitemap"), ("https://h/New/", "sitemap"), ("https://h/x.pdf", "sitemap")], "url string, source string")
    html = spark.createDataFrame([("https://h/new", "html")], "url string, source string")
    found = discovery.new_candidates(discovery.candidates(sitemap, html), known, 10).collect()
    assert [(r.url, r.source) for r in found] == [("https://h/new", "html"), ("https://h/x.pdf", "sitemap")]
    assert {r.url: r.doc_type for r in discovery.describe(sitemap, "s").collect()}["https://h/x.pdf"] == "pdf"


def test_claims_and_publication(spark):
    s = spark.createDataFrame([("a", "discovered", None, None), ("b", "indexed", None, None)], "url string, status string, locked_at string, locked_by string")
    got = {r.url: (r.status, r.locked_by) for r in state.claim(s, s.where("url = 'a'"), now="n", worker="w").collect()}
    assert got == {"a": ("processing", "w"), "b": ("indexed", None)}
    q = spark.createDataFrame([("a", "processing", 4), ("b", "processing", 0), ("c", "pending", 0)], "url string, status string, attempts int")
    e = spark.createDataFrame([("a", "failed"), ("b", "found")], "url string, event string")
    assert {r.url: (r.status, r.attempts) for r in state.publication_step(q, e).collect()} == {"a": ("failed", 5), "b": ("done", 1), "c": ("pending", 0)}
    with pytest.raises(Exception, match="no such event"):
        rows = spark.createDataFrame([("a", "processing", 0, 0, 0, 1, None)], "url string, status string, failure_count int, consecutive_missing int, attempt_count int, is_active int, next_check_at string")
        state.transition(rows, spark.createDataFrame([("a", "odd")], "url string, event string"), recheck="r", retry="t", missing="m").collect()


def test_stream_of_events_makes_snapshots(spark, tmp_path):
    first = spark.createDataFrame([("a", "processing", 0, 2, 0, 1, None), ("b", "processing", 4, 0, 0, 1, None)], "url string, status string, failure_count int, consecutive_missing int, attempt_count int, is_active int, next_check_at string")
    first.write.parquet(str(tmp_path / "s" / "v=0"))
    spark.createDataFrame([("a", "not_found", 1), ("b", "indexed", 1), ("b", "http_error", 2)], "url string, event string, at long").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("url string, event string, at long").parquet(str(tmp_path / "e"))
    last = leases.work_off(spark, events, str(tmp_path / "s"), str(tmp_path / "c"))
    assert last == 1 and {r.url: r.status for r in leases.snapshot(spark, str(tmp_path / "s"), last).collect()} == {"a": "gone", "b": "quarantined"}
    # A new checkpoint folder sees the same events again: it goes on after the last snapshot, the old ones stay.
    again = leases.work_off(spark, events, str(tmp_path / "s"), str(tmp_path / "c2"))
    assert again == 2 and {r.url: r.status for r in leases.snapshot(spark, str(tmp_path / "s"), 1).collect()} == {"a": "gone", "b": "quarantined"}
    assert leases.work_off(spark, events, str(tmp_path / "s"), str(tmp_path / "c2")) == 2
    spark.createDataFrame([("a", "indexed", 5)], "url string, event string, at long").write.mode("append").parquet(str(tmp_path / "e"))
    assert leases.work_off(spark, events, str(tmp_path / "s"), str(tmp_path / "c2"), deadline=-1.0) == 2
    assert leases.work_off(spark, events, str(tmp_path / "s"), str(tmp_path / "c2")) == 3


def test_titles_and_snippets(spark):
    from quarrylight.functions import titles as T

    lit = F.lit
    long_text = "Остальной текст документа достаточно длинный, чтобы остаться после заголовка и не пропасть совсем из выдачи поиска."
    row = spark.range(1).select(
        T.act_title(lit("Приказ"), lit("7"), lit(None)).alias("act"), T.act_title(lit(""), lit("7"), lit("x")).alias("none"),
        T.shown_title(lit("Файл"), lit("Отчёт за 2024"), lit(None), lit(None), lit(None), lit("t"), lit(None), lit(False)).alias("attachment"),
        T.shown_title(lit("pdf"), lit(""), lit("Приказ"), lit("7"), lit("2024-03-14"), lit("t"), lit(None), lit(False)).alias("by_act"),
        T.shown_title(lit(None), lit(None), lit(None), lit(None), lit(None), lit(""), lit(None), lit(True)).alias("untitled"),
        T.indexed_title(lit("pdf"), lit("028e97063df6b807dc50e5901603af2e"), lit(""), lit(None), lit(None), lit(None), F.array(lit("шум Постановление о парке"))).alias("indexed"),
        T.url_title(lit("https://h/a/%D0%BF%D0%BB%D0%B0%D0%BD+1.pdf")).alias("url_title"), T.url_title(lit("https://h/028e97063df6b807dc50e5901603af2e.pdf")).alias("machine"),
        T.clean_site_text(lit("Мэрия: <b>Текст</b> &amp; дело Действия: Поделиться ещё"), 100, ("Мэрия: ",)).alias("clean"),
        T.restore_start(lit("овости города сегодня"), lit("Новости города")).alias("restored"), T.drop_title(lit("Новости города. " + long_text), lit("Новости города")).alias("dropped"),
        T.result_snippet(lit("кратко"), lit("Новости города. " + long_text), lit("Новости города")).alias("snippet"),
    ).first()
    assert (row.act, row.none, row.attachment, row.by_act, row.untitled) == ("Приказ № 7", None, "Отчёт за 2024", "Приказ № 7 от 14 марта 2024", "Без названия")
    assert (row.indexed, row.url_title, row.machine) == ("Постановление о парке", "план+1.pdf", "")
    assert row.clean == "Текст & дело" and row.restored == "Новости города сегодня" and row.dropped == long_text and row.snippet == long_text


def test_chunk_documents(spark):
    pages = spark.createDataFrame([("u", 1, "page one"), ("u", 2, "page two")], "url string, page_number int, text string")
    docs = spark.createDataFrame([("u", "pdf", "T", "№ 84 – PC", None, None, None, None, None, "https://h/press-sluzhba/novosti/1", None, "2024-01-01", None, [2], [])], "url string, doc_type string, title string, document_number string, document_date string, document_kind string, row_document_number string, row_document_date string, row_document_kind string, parent_url string, page_url string, published_at string, content_category string, ocr_pages array<int>, unreadable_pages array<int>")
    got = chunking.chunk_documents(chunking.chunks(pages), docs).orderBy("chunk_number").collect()
    assert [(r.document_number_normalized, r.content_category, r.sort_date, r.is_attachment, r.text_extraction, r.ocr_page_count) for r in got] == [("84-рс", "news", "2024-01-01", True, "native", 1), ("84-рс", "news", "2024-01-01", True, "ocr", 1)]


def test_reports(spark):
    from quarrylight.operators import reports

    tasks = spark.createDataFrame([(1, [{"d": 1}])], "id int, slices array<struct<d:int>>")
    made = tasks.select("id", F.array(F.struct(F.lit(3).alias("done"), F.lit(5).alias("total")), F.lit(None)).alias("slices"))
    r = reports.slice_progress(made).first()
    assert (r.done, r.total) == (3, 5)
    dpi = spark.range(1).select(reports.render_dpi(F.lit(None).cast("int"), F.lit(595.0), F.lit(842.0)).alias("a"), reports.render_dpi(F.lit(600), F.lit(595.0), F.lit(842.0)).alias("b"), reports.render_dpi(F.lit(300), F.lit(5950.0), F.lit(8420.0)).alias("c")).first()
    assert (dpi.a, dpi.b) == (200, 287) and dpi.c < 200


def test_schema_gate(spark):
    from quarrylight import schema

    assert len(schema.CRAWL_URLS) == 36 and len(schema.CHUNKS) == 35
    df = spark.createDataFrame([("u", "3")], "url string, page_number string")
    got = schema.conform(df, schema.CHUNKS)
    assert got.schema == schema.CHUNKS and got.first().page_number == 3
    with pytest.raises(ValueError, match="unknown columns: x"):
        schema.conform(df.withColumn("x", F.lit(1)), schema.CHUNKS)
    assert schema.keywords(df.withColumn("url", F.repeat(F.lit("a"), 3000))).first().url_key is None


def test_sitemap_walk():
    site = {"a": b"<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>", "b": b"<urlset><url><loc>p</loc></url><url><loc>q</loc></url></urlset>"}
    pages, errors = discovery.sitemap_pages(["a"], site.__getitem__)
    assert pages == {"p": None, "q": None} and len(errors) == 1
    assert len(discovery.sitemap_pages(["a"], site.__getitem__, most_pages=1)[0]) == 1


def test_texts_pass_python_in_parts_of_bounded_size(spark):
    """A worker holds a part of a batch as strings, not the batch; a text above the bound is a part of its own, and no row is lost."""
    import pyarrow as pa

    from quarrylight.functions import batches

    texts = pa.array(["a" * 600, None, "я" * 300, "b" * 5000, "", "c"])
    assert list(batches.bounds(texts, 1200)) == [(0, 3), (3, 1), (4, 2)] and list(batches.bounds(texts.slice(3), 1200)) == [(0, 1), (1, 2)]
    assert batches.mapped(texts, lambda v: v and v[:1], 1200).to_pylist() == ["a", None, "я", "b", "", "c"] and len(batches.mapped(texts[:0], str)) == 0
    big = spark.range(40).selectExpr("id", "CASE WHEN id % 7 <> 3 THEN repeat(concat('Cочи. ', id, ' '), 30000) END AS text").coalesce(1)
    shown = present.snippets(big, "Cочи")
    sizes = shown.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"]) for b in bs), "n long, bytes long").collect()
    assert sum(r.n for r in sizes) == 40
    assert [r.id for r in shown.select("id").collect()] == list(range(40)) and shown.where("id = 3").first().snippet == ""
    got = {r.id: r.v for r in big.select("id", repair.repair(F.col("text")).alias("v")).collect()}
    assert got[3] == "" and got[5] == "Сочи. 5 " * 29999 + "Сочи. 5 "
