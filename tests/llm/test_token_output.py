import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrylight.llm import token_output
from quarrylight.llm.token_output import EliasFano, read_documents, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "plain words here.\nNext line, it's 42!", "  two  blanks\n\n lead", "a<|endoftext|>b", "tab\tand\r\nreturn", "é ñ 漢字 ²  x y \x1c z", "long " * 30000, " edge ", "\n", "x\n y", "don't we'll  \n"]


def test_round_trip(spark, tmp_path):
    rows = [(i * 7 % 13, t, 1) for i, t in enumerate(TEXTS)] + [(None, "last", 2), (3, "same id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    write_token_files(df, str(tmp_path / "t"), PATH)
    got = read_token_files(spark, str(tmp_path / "t")).collect()
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got), key=key) == sorted(want, key=key)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("values", [[1], [0, 0, 0], list(range(1, 5000)), np.cumsum(np.random.default_rng(3).integers(1, 9000, 3000)).tolist(), [1, 2, 10**6, 10**6]])
def test_select(values):
    ef = EliasFano.build(np.array(values))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:
        assert len(ef.low) + len(ef.high) < 8 * len(values) / 2


def test_remembered_words_give_the_library_ids(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_PIECES", 300)
    rng, tokenizer = np.random.default_rng(1), Tokenizer.from_file(PATH)
    pieces = ["the", "The", "größe", "naïve", "x", "42", "555-4063", "don't", "VIÊTION", "漢字", "a_b", "_", "²", "'s", "end.", "end,", "wow!!", "pay$$$", "b***", "c&&&,", "(see", "it's!", "\n", " ", "\t", "é."]
    encoder = token_output._Encoder(PATH)
    for _ in range(30):
        texts = [" ".join(rng.choice(pieces, rng.integers(0, 40)).tolist()) + (f" w{rng.integers(900)}." * 3) for _ in range(20)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_look_up_by_select(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "CHUNK_IDS", 50)
    rows = [(3 * i - 100, f"text number {i} " * (i % 9)) for i in range(300)] + [(50, "twice"), (None, "none")]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "t"), PATH)
    whole = {(r.doc_id, r.start): r.ids for r in read_token_files(spark, str(tmp_path / "t")).collect()}
    for r in read_documents(spark, str(tmp_path / "t"), [-100, 50, 500, 51, 797]).collect():
        assert whole.pop((r.doc_id, r.start)) == r.ids
    assert not {-100, 50, 500, 797} & {i for i, _ in whole}


def test_many_rows_of_one_id_and_a_long_document(spark, tmp_path):
    rows = [(None, "")] * 3000 + [(5, f"t{i % 50}") for i in range(2000)] + [(9, "w " * 1_100_000)]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), str(tmp_path / "t"), PATH)
    got = sorted(read_token_files(spark, str(tmp_path / "t"), with_ids=False).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == [5] * 2000 + [9] + [None] * 3000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[2000].n_tokens > 1 << 20
    assert spark.read.parquet(str(tmp_path / "t" / "chunks")).where("last > 9").count() > 1


def test_memory_of_what_is_encoded_together():
    import random
    import tracemalloc

    import public_tokenizers
    from quarrylight.llm import token_output
    from quarrylight.llm.queries import TOKENIZER

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(100_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(token_output.TOGETHER // 2600)]
    encoder = token_output._Encoder(public_tokenizers.path(TOKENIZER))
    tracemalloc.start()
    found = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and peak < 100e6
