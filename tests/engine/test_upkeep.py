"""Upkeep steps that the catalogue's queries don't reach: publishing, backups, pages, clashing names."""

from pyspark.sql import functions as F

from quarrylight.operators import upkeep


def test_migrate_is_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "tables")
    state = spark.createDataFrame([("u/a.zip", 1, "discovered"), ("u/b.zip", 1, "indexed")], "url string, is_active int, status string")
    review = upkeep.unsupported_rows(state).where("review")
    assert upkeep.migrate(spark, folder, "v1", {"state": upkeep.finalize_unsupported(state)}, review) == 1
    assert upkeep.migrate(spark, folder, "v1", {"state": upkeep.finalize_unsupported(state)}, review.limit(0)) == 0
    assert upkeep.current_version(spark, folder) == "v1"
    once = spark.read.parquet(f"{folder}/v1/state")
    assert {r.url: r.status for r in once.collect()} == {"u/a.zip": "skipped_unsupported", "u/b.zip": "indexed"}
    assert sorted(upkeep.finalize_unsupported(once).collect()) == sorted(once.collect())


def test_backup_and_manifest(spark, tmp_path):
    folder = str(tmp_path / "copy")
    assert upkeep.backup(spark.range(100).selectExpr("id", "cast(id % 7 as string) AS s"), folder) == "ok"
    (tmp_path / "copy" / "MANIFEST.sha256").write_text("x")
    rows = upkeep.manifest(spark, folder).collect()
    assert rows and all(len(r.sha256) == 64 and r.path.startswith("part-") for r in rows)


def test_page_fold_counts_attempts_not_pages(spark):
    pages = [(1, n, n <= 3, n == 4, n == 1) for n in range(1, 9)]
    decided = upkeep.page_fold(spark.createDataFrame(pages, "doc int, page_number int, readable boolean, blank boolean, force boolean"), "doc", most=3)
    assert [(r.decision, r.attempt) for r in decided.orderBy("page_number").collect()] == [("ocr", 1), ("native", None), ("native", None), ("blank", None), ("ocr", 2), ("ocr", 3), ("skipped", None), ("skipped", None)]
    sets = upkeep.document_pages(decided, "doc").first()
    assert sets.ocr_pages == [1, 5, 6] and sets.skipped_pages == [7, 8] and sets.unreadable_pages == []
    assert upkeep.page_fold(decided.selectExpr("doc", "page_number", "false AS readable", "false AS blank", "false AS force"), "doc", most=3, enabled=False).where("decision = 'unreadable'").count() == 8


def test_steps_keep_other_columns(spark):
    state = spark.createDataFrame([("https://h/press-sluzhba/obyavleniya/5", 1, "gone", None, "keep"), ("x", 1, "processing", "w", "too")], "url string, is_active int, status string, locked_by string, _url string")
    queue = spark.createDataFrame([("q", "news", "pending", 0, "c", "u")], "url string, category string, status string, attempts int, created_at string, updated_at string")
    assert upkeep.seed_publications(queue, state, now="n").count() == 2
    assert upkeep.release_leases(state, now="n").where("_url = 'too' AND status = 'retry' AND locked_by IS NULL").count() == 1
    links = spark.createDataFrame([("https://h/press-sluzhba/obyavleniya/5", "t", "x")], "url string, title string, parent_url string")
    out = upkeep.upsert_attachments(state, links, now="n")
    assert out.columns == state.columns and out.where(F.col("status") == "discovered").count() == 1
